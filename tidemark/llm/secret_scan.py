"""Secret scan with DataFrame functions only: fixed patterns, then a battery of randomness tests.

Base spans come from three patterns (an assignment to a secret's name, an access key, a long hex run).
The battery looks at what else could be a secret: runs of ``SHORTEST`` or more characters of the usual
alphabets. The encoding of a run is inferred from its characters (hex, base32, base36, base62, base64,
or letters only), and its characters are tested against randomness over that alphabet:

* chi-squared for a uniform use of the alphabet (as a z-score by the cube-root rule),
* the number of runs above and below the middle of the alphabet (Wald and Wolfowitz),
* the serial correlation of neighbouring characters.

A secret passes all three within ``TOLERANCE``. But short text passes too, so passing isn't evidence: the evidence is
how far the same statistics lie from what written text of that length would give. Of the chi-squared statistic
(which is the index of coincidence, but for a factor) the expectation and spread for a run of n characters follow
from the frequencies of the letters in all texts. Of the runs those of one character class (digits, small, capital
letters; separators left out) are taken, which text changes at ``TEXT_CHANGES`` of its characters at most. Serial
correlation lies at ``TEXT_SERIAL`` or more for text. Their z-scores are added up with the weights of the encoding
(Stouffer), so the p-value of "this is text" rests on the whole battery and knows the length. False discoveries are controlled
at ``FALSE_SHARE`` by the step-up rule of Benjamini and Hochberg, for each encoding and class of lengths apart, over
all runs of all documents. The ranks are read from counts of p-values in bins of a tenth of a power of ten, so
what comes to the driver is bounded.

Runs are looked for in what base spans leave, so the two never overlap. The scan reads the texts once: base spans, measured
runs and letter counts of each document are written to the shared folder, and all else works on those. Places
are running sums over blocks of ``BLOCK`` matches, so a text with many spans takes time in proportion. Positions
are code points, ends exclusive. A null text counts as empty: no spans. Repeated rows are scanned each, other columns may
have any names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unused

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of these two are maximal, so asking for the length in the pattern finds the same spans.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
SHORTEST = 20
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
TOLERANCE = 3.3
FALSE_SHARE = 0.05
#: How much wider than independent letters the index of coincidence of text spreads.
DISPERSION = 1.2
#: Share of neighbouring letters and digits of text that differ in class, in names made of many short words.
TEXT_CHANGES = 0.4
#: Size of the serial correlation of text, as a z-score.
TEXT_SERIAL = 1.4
PER_TEN = 10
LAST_BIN = 300
#: Matches whose places are summed up at a time.
BLOCK = 128
#: Characters of a text that are cut at a time.
CHUNK = 1024

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by the first pattern that fits, and their alphabets in order.
ENCODINGS = {
    "letters": (r"^(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)$", _LOWER),
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": (r"^[A-Z2-7]+$", _UPPER + "234567"),
    "base36": (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER),
    "base62": (r"^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    "base64": (r"^[0-9A-Za-z+/_-]+$", _DIGITS + _UPPER + _LOWER + "+/"),
}
#: Weights of chi-squared, runs and serial correlation: runs of classes tell nothing where there is one class or text has as many.
WEIGHTS = {"letters": (1.0, 0.0, 0.0), "hex": (1.0, 0.3, 0.3), "base32": (1.0, 0.0, 0.0), "base36": (1.0, 0.0, 0.0), "base62": (1.0, 1.0, 0.5), "base64": (1.0, 1.0, 0.5)}
_FOLDED = ("letters", "hex", "base36")
#: Letter statistics used where the corpus has hardly a letter: sums of squares and cubes of shares.
NO_TEXT = {"letters": (0.07, 0.006), "hex": (0.26, 0.09)}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array what ``combine`` makes of all before it, from 0 on: block by block."""

    def scan(own: Column, first: Column) -> Column:
        return F.aggregate(own, F.array(first), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda own: F.aggregate(own, F.lit(0), combine))
        return F.flatten(F.zip_with(blocks, F.slice(scan(totals, F.lit(0)), F.lit(1), F.size(blocks)), lambda own, first: F.slice(scan(own, first), F.lit(1), F.size(own))))

    def of_values(v: Column) -> Column:
        last = F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / BLOCK).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK))), of_blocks)

    return let(values, of_values)


KEPT = ("start", "end", "encoding", "n", "squares", "letters", "changes")


def found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost matches that don't overlap, as an array of (start, kind, end, token).

    ``split`` gives what stands between the matches, so the places are running sums of lengths.
    ``group`` of the match must have ``least`` characters.
    """
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>")

    def placed(rows: Column) -> Column:
        at = running(F.transform(rows, lambda x: F.length(x["b"]) + F.length(x["m"])), lambda a, n: a + n)

        def span(x: Column, a: Column) -> Column:
            start = a + F.length(x["b"])
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("end"), x["t"].alias("token"))

        return F.filter(F.zip_with(rows, at, span), lambda x: F.length(x["token"]) >= least)

    rows = let(matches, lambda m: F.arrays_zip(F.slice(between, F.lit(1), F.size(m)).alias("b"), m.alias("m"), tokens.alias("t")))
    return F.when(text.rlike(pattern), let(rows, placed)).otherwise(empty)


def filled(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """``text`` with each of the ordered ``spans`` replaced by ``fill`` of it and of where all before it end.

    The text is cut into chunks first, so a piece is read from its own chunks and not from the text's beginning.
    """

    def of_chunks(chunks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / CHUNK).cast("int")
            own = F.array_join(F.slice(chunks, first + 1, F.floor((b - 1) / CHUNK).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(own, a - first * CHUNK + 1, b - a)).otherwise("")

        def of_spans(s: Column) -> Column:
            before = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
            parts = F.zip_with(s, before, lambda x, e: F.concat(piece(e, x["start"]), fill(x, e)))
            return F.concat(F.array_join(parts, ""), piece(F.array_max(F.transform(s, lambda x: x["end"])), F.length(text)))

        return let(spans, of_spans)

    whole = let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0)), of_chunks)
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def base_spans(text: Column) -> Column:
    return F.concat(found(text, ASSIGN, 0, group=1, least=6), found(text, ACCESS, 1), found(text, HEX, 2))


def encoding_of(body: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (pattern, _) in reversed(ENCODINGS.items()):
        out = F.when(body.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(~body.rlike(r"^[0-9+/_-]+$"), out)  # numbers aren't tested


def by_encoding(encoding: Column, values: dict) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(encoding == name, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def characters(body: Column) -> Column:
    return F.filter(F.split(body, ""), lambda c: c != "")


def measured(runs: Column) -> Column:
    """For each run: start, end, encoding, n, squares (of character counts), z_runs, z_serial, letters (and digits) and changes of class between them."""

    def named(r: Column) -> Column:
        body = F.rtrim(r["token"], F.lit("="))
        encoding = encoding_of(body)
        folded = F.when(encoding.isin(*_FOLDED), F.lower(body)).otherwise(F.translate(body, "-_", "+/"))
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), encoding.alias("encoding"), folded.alias("body"), F.length(body).alias("n"))

    def counted(r: Column) -> Column:
        n = r["n"]
        squares = F.aggregate(F.array_distinct(characters(r["body"])), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(r["body"], c, F.lit(""))), F.lit(2)))
        sides = by_encoding(r["encoding"], {e: F.translate(r["body"], a, "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2)) for e, (_, a) in ENCODINGS.items()})
        alphabet = by_encoding(r["encoding"], {e: a for e, (_, a) in ENCODINGS.items()})
        values = F.transform(characters(r["body"]), lambda c: F.position(c, alphabet).cast("double"))
        plain = F.regexp_replace(r["body"], "[+/]+", "")
        changes = F.length(F.regexp_replace(plain, "[a-z]+|[A-Z]+|[0-9]+", "x")) - 1
        return F.struct(*(r[c].alias(c) for c in KEPT[:4]), squares.alias("squares"), F.length(plain).alias("letters"), changes.alias("changes"), sides.alias("sides"), values.alias("values"))

    def centred(r: Column) -> Column:
        mean = F.aggregate(r["values"], F.lit(0.0), lambda a, v: a + v) / r["n"]
        high = F.length(F.replace(r["sides"], F.lit("0"), F.lit(""))).cast("double")
        runs_ = F.length(F.regexp_replace(r["sides"], "0+|1+", "x")).cast("double")
        return F.struct(*(r[c].alias(c) for c in (*KEPT, "values")), mean.alias("mean"), (1 + 2 * high * (r["n"] - high) / r["n"]).alias("expected"), runs_.alias("runs"))

    def tested(r: Column) -> Column:
        n, mu, x, m = r["n"], r["expected"], r["values"], r["mean"]
        spread = F.sqrt((mu - 1) * (mu - 2) / (n - 1))
        around = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
        next_ = F.aggregate(F.zip_with(F.slice(x, F.lit(1), n - 1), F.slice(x, F.lit(2), n - 1), lambda a, b: (a - m) * (b - m)), F.lit(0.0), lambda a, v: a + v)
        return F.struct(
            *(r[c].alias(c) for c in KEPT),
            F.when(mu > 2, (r["runs"] - mu) / spread).otherwise(99.0).alias("z_runs"),
            F.when(around > 0, (next_ / around + 1.0 / n) * F.sqrt(n.cast("double"))).otherwise(99.0).alias("z_serial"),
        )

    known = F.filter(F.transform(runs, named), lambda r: r["encoding"].isNotNull())
    return F.transform(F.transform(F.transform(known, counted), centred), tested)


def judged(runs: Column, text: dict[str, tuple[float, float]]) -> Column:
    """For each measured run: start, end, stratum, and bin (tenths of a power of ten of 1/p; -1 if it fails a test)."""

    def step(r: Column) -> Column:
        n, size = r["n"].cast("double"), by_encoding(r["encoding"], {e: float(len(a)) for e, (_, a) in ENCODINGS.items()})
        chi = size * r["squares"] / n - n
        free = size - 1
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        b2 = F.when(r["encoding"] == "hex", F.lit(text["hex"][0])).otherwise(F.lit(text["letters"][0]))
        b3 = F.when(r["encoding"] == "hex", F.lit(text["hex"][1])).otherwise(F.lit(text["letters"][1]))
        coincidence = (r["squares"] - n) / (n * (n - 1))
        spread = DISPERSION * F.sqrt(F.greatest(4 * (b3 - b2 * b2), F.lit(0.0)) / n + 2 * (b2 - 2 * b3 + b2 * b2) / (n * n))
        pairs = F.greatest(r["letters"] - 1, F.lit(1)).cast("double")
        of_classes = (r["changes"] - TEXT_CHANGES * pairs) / F.sqrt(TEXT_CHANGES * (1 - TEXT_CHANGES) * pairs)
        evidence = ((b2 - coincidence) / spread, of_classes, TEXT_SERIAL - F.abs(r["z_serial"]))
        weights = [by_encoding(r["encoding"], {e: w[k] for e, w in WEIGHTS.items()}) for k in range(3)]
        x = sum((w * z for w, z in zip(weights, evidence, strict=True)), F.lit(0.0)) / F.sqrt(sum((w * w for w in weights), F.lit(0.0)))
        x = F.greatest(x, F.lit(0.0))
        powers = (x * x / 2 + F.log(math.sqrt(2 * math.pi) / 2 * (x + F.sqrt(x * x + 8 / math.pi)))) / math.log(10)
        passes = (z_chi < TOLERANCE) & (F.abs(r["z_runs"]) < TOLERANCE) & (F.abs(r["z_serial"]) < TOLERANCE)
        bin_ = F.least(F.floor(powers * PER_TEN).cast("int"), F.lit(LAST_BIN))
        lengths = F.when(n < 28, "20").when(n < 40, "28").when(n < 64, "40").otherwise("64")
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), F.concat_ws(":", r["encoding"], lengths).alias("stratum"), F.when(passes, bin_).otherwise(-1).alias("bin"))

    return F.transform(runs, step)


def letter_counts(text: Column) -> Column:
    """How often each letter stands in a text, in either case."""
    return let(F.lower(text), lambda t: F.array(*((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))) for c in _LOWER)))


def letter_statistics(counted: DataFrame) -> dict[str, tuple[float, float]]:
    """Sums of squares and cubes of the letters' shares in all texts, and of those of a to f."""
    row = counted.agg(*(F.sum(F.col("letters")[k].cast("long")).alias(c) for k, c in enumerate(_LOWER))).first()
    out = dict(NO_TEXT)
    for name, letters in (("letters", _LOWER), ("hex", "abcdef")):
        counts = [row[c] or 0 for c in letters]
        if sum(counts) > 1000:
            shares = [c / sum(counts) for c in counts]
            out[name] = (sum(s**2 for s in shares), sum(s**3 for s in shares))
    return out


def cutoffs(counts: dict[str, dict[int, int]], share: float = FALSE_SHARE) -> dict[str, int]:
    """The least bin of each stratum whose runs are discoveries: p <= share * (runs from there on) / (all runs)."""
    out = {}
    for stratum, bins in counts.items():
        total, above = sum(bins.values()), 0
        for b in sorted((b for b in bins if b >= 0), reverse=True):
            above += bins[b]
            if 10 ** (-b / PER_TEN) * total <= share * above:
                out[stratum] = b
    return out


def whole_text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def with_measures(docs: DataFrame, base: str, runs: str) -> DataFrame:
    """``docs`` with two more columns of these names: the base spans (start, kind, end) in order, and the measured runs beside them."""
    spans = F.array_sort(F.transform(base_spans(whole_text()), lambda s: F.struct(s["start"], s["kind"], s["end"])))

    def blank(s: Column, before: Column) -> Column:
        return F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], before), F.lit(0)))

    rest = filled(whole_text(), F.col(base), blank)
    return docs.withColumn(base, spans).withColumn(runs, let(rest, lambda t: measured(found(t, RUN, 3))))


def discoveries(analysed: DataFrame, text: dict[str, tuple[float, float]], runs: str) -> dict[str, int]:
    """The least bin of each stratum that is a discovery, over all ``runs``."""
    per_bin = analysed.where(F.size(runs) > 0).select(F.explode(judged(F.col(runs), text)).alias("r")).groupBy("r.stratum", "r.bin").count()
    counts: dict[str, dict[int, int]] = {}
    for row in per_bin.collect():
        counts.setdefault(row["stratum"], {})[row["bin"]] = row["count"]
    return cutoffs(counts)


def all_spans(base: Column, runs: Column, text: dict[str, tuple[float, float]], least: dict[str, int]) -> Column:
    """Base spans and the runs from the ``least`` bins on, (start, kind, end) in order; kind is a place in ``KINDS``."""
    if not least:
        return base

    def discovered(r: Column) -> Column:
        cut = F.lit(LAST_BIN + 1)
        for stratum, b in least.items():
            cut = F.when(r["stratum"] == stratum, F.lit(b)).otherwise(cut)
        return r["bin"] >= cut

    added = F.transform(F.filter(judged(runs, text), discovered), lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return F.when(F.size(runs) > 0, F.array_sort(F.concat(base, added))).otherwise(base)


def analysis(docs: DataFrame, *kept: str) -> DataFrame:
    """The ``kept`` columns of ``docs`` with base, runs and letters of each text, written to the shared folder."""
    rows = with_measures(docs.select(*kept, "text"), "_base", "_runs")
    return stored(rows.select(*kept, F.col("_base").alias("base"), F.col("_runs").alias("runs"), letter_counts(whole_text()).alias("letters")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for each document."""
    analysed = analysis(docs, "doc_id")
    text = letter_statistics(analysed)
    spans = all_spans(F.col("base"), F.col("runs"), text, discoveries(analysed, text, "runs"))
    rows = analysed.select("doc_id", spans.alias("_spans"))

    def number(kind: int) -> Column:
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("_spans", lambda s: s["kind"] < 3)
    return rows.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans"), number(3).alias("n_random")
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; overlapping spans become one mark.

    A column ``n_chars`` is brought up to date where a text changes. Null and empty texts and repeated rows stay as
    they are, and so do columns of any other name. An empty table gives no rows.
    """
    analysed = analysis(docs)
    text = letter_statistics(analysed)
    least = discoveries(analysed, text, "runs")
    base, runs, spans = (unused(docs, name) for name in ("base", "runs", "spans"))
    rows = with_measures(docs, base, runs).withColumn(spans, all_spans(F.col(base), F.col(runs), text, least))
    changed = F.size(spans) > 0
    clean = filled(F.col("text").cast("string"), F.col(spans), lambda s, before: F.when(s["start"] >= before, F.lit(mark)).otherwise(""))
    rows = rows.withColumn("text", F.when(changed, clean).otherwise(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(changed, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return rows.select(docs.columns)
