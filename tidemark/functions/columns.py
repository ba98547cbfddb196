"""Column expressions for times and lenient numbers. Times are timestamps without zone, in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DoubleType, FloatType, IntegralType, NumericType, TimestampNTZType, TimestampType

NTZ = "timestamp_ntz"
#: A time of the day with an offset or a zone behind it.
ZONED = r"(?i):\d{2}(\.\d+)?\s*(z|utc|gmt|[+-]\d{1,2}(:?\d{2})?|[a-z]+(/[a-z_+-]+)+)\s*$"
#: What counts as a number: an optional sign, digits with an optional point, an optional exponent; or infinity.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"


def utc(c: Column | str, kind: DataType | None = None) -> Column:
    """A time as a timestamp without zone in UTC; null if it doesn't read.

    Text may carry an offset or zone of its own, value by value, and is UTC otherwise. Columns with a zone (``kind``
    timestamp) are instants. Whole numbers are nanoseconds since 1970, the long form of nanosecond columns.
    """
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(kind, IntegralType):
        micros_ = F.call_function("div", c - F.pmod(c, F.lit(1000)), F.lit(1000))
        return _in_utc(F.timestamp_micros(micros_))
    if isinstance(kind, TimestampType):
        return _in_utc(c)
    if isinstance(kind, TimestampNTZType | DateType):
        return c.cast(NTZ)
    text = c.cast("string")
    # Offsets without a colon aren't read by the cast.
    colon = F.regexp_replace(text, r"(:\d{2}(?:\.\d+)?\s*[+-]\d{2})(\d{2})\s*$", "$1:$2")
    return F.when(text.rlike(ZONED), _in_utc(colon.try_cast("timestamp"))).otherwise(text.try_cast(NTZ))


def utc_of(df: DataFrame, name: str) -> Column:
    """``utc`` of a column of ``df``, whatever its type."""
    return utc(name, df.schema[name].dataType)


def _in_utc(instant: Column) -> Column:
    """An instant's time in UTC, whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast(NTZ))


def number(c: Column | str) -> Column:
    """Text or number as a double; what isn't a number, and NaN, is null."""
    c = F.col(c) if isinstance(c, str) else c
    value = F.when(c.cast("string").rlike(NUMBER), F.trim(c.cast("string")).try_cast("double"))
    return F.when(~F.isnan(value), value)


def number_of(df: DataFrame, name: str) -> Column:
    """``number`` of a column of ``df``; one that is a number already isn't read as text."""
    kind = df.schema[name].dataType
    if not isinstance(kind, NumericType):
        return number(name)
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value) if isinstance(kind, FloatType | DoubleType) else value


def hour_floor(c: Column | str) -> Column:
    return F.date_trunc("HOUR", c).cast(NTZ)


def hour_ceiling(c: Column) -> Column:
    floor = hour_floor(c)
    return F.when(floor == c, floor).otherwise(floor + F.expr("INTERVAL '1' HOUR"))


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' HOUR")


def micros(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Hours from start to end, as a double."""
    return (micros(end) - micros(start)) / 3.6e9


def safe_name(text: str) -> str:
    return text.strip().replace(" ", "_")


def hashed(seed: int, *columns: str) -> Column:
    """A number of 32 bits from the seed and the columns as text; null counts as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
