"""Mixing of sources to target weights, to exact budgets of words.

DataFrame functions only. Every document gets a random key, the hash of its id; all documents are range-sorted by source and
key, and the words before each in that order are a distributed prefix sum: sums within ranges, and running totals over
the ranges, of which there are as many as tasks. A source's budget then cuts it at a word: documents before the cut are taken
whole, the one that the cut meets up to it, and where a budget is more than the source has, whole epochs come before.

Sources are numbered and weighed by the same prefix sum, so there may be any number of them: in the order of their code
points, null last, the weights repeat. Together they get ``share`` of all words by weight, but none more than ``cap`` times
what it has; what is over goes to the others by weight until none is above. The sources that stop at the cap are the first in
the order of size by weight for as long as each one's share, with those before it stopped, isn't below its cap.
Budgets are whole words in exact integers; targets are the same as doubles, not rounded down.

A hot source is split over as many ranges as it fills, as ranges go by key, id, size and row. Rows that repeat an id are
documents of their own; rows with the same id, size and source are alike, so which one the cut meets can't be told apart and
results are the same at each run. A null text, or one without words, has the size 0 and is taken 0 times; a source without words has the
target 0. A null id is a key like any other. An empty table gives no rows. Other columns aren't read unless asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (3, 1, 2)
#: The words of the mix, as a fraction of all words.
SHARE = (3, 2)
#: Most times that a source's words are taken.
CAP = 2
SEED = "mix"
#: White space between words, as a class of a regular expression and as characters.
_SPACE, _SPACES = r"\x20\x09-\x0D", " \t\n\x0b\x0c\r"
#: Ranges for each task.
RANGES = 4


def n_words(text: Column) -> Column:
    """The number of words of a text; memory follows the text, not an array of its words."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{_SPACE}]++[{_SPACE}]*+", "w")
    return F.length(F.ltrim(marks, F.lit(_SPACES))).cast("long")


def running_totals(df: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """``df``, written, with ``<value>_before``: each value's sum over all rows before in ``order``, which must tell all rows apart.

    Rows are sorted into ranges of about the same number of rows; only one row for each range meets in one task.
    """
    ranges = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_range").agg(*(F.sum(v).alias(v) for v in values))
    offsets = totals.select("_range", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = {f"{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_{v}") for v in values}
    return placed.join(F.broadcast(offsets), "_range").withColumns(before).drop("_range", *(f"_{v}" for v in values))


def source_budgets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """From one row (source, source_size) for each source: source, source_size, words_before, weight, target (double) and budget (whole words); written."""
    by_name = F.col("source").asc_nulls_last()
    numbered = running_totals(sizes.withColumn("one", F.lit(1).cast("long")), [by_name], ["one", "source_size"])
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("one_before") % len(weights) + 1).cast("int"))
    weighed = numbered.select("source", "source_size", F.col("source_size_before").alias("words_before"), weight.alias("weight"))
    # The order of size by weight in integers.
    weighed = weighed.withColumns({"most": cap * F.col("source_size"), "_ratio": F.col("source_size") * (F.lit(math.lcm(*weights)) / F.col("weight")).cast("long")})
    ordered = running_totals(weighed, [F.col("_ratio").asc(), by_name], ["most", "weight"])
    whole = ordered.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, all_weight = whole["words"] or 0, whole["weight"] or 0
    asked, of = share[0] * words, share[1]  # the mix has asked / of words

    def exact(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    left_weight, left = F.lit(all_weight) - F.col("weight_before"), F.lit(asked) - of * F.col("most_before")
    stops = exact(of * F.col("most")) * exact(left_weight) <= exact(F.col("weight")) * exact(left)
    marked = stored(ordered.withColumn("stops", stops))
    stopped = marked.where("stops").agg(F.sum("most").alias("words"), F.sum("weight").alias("weight")).first()
    rest, rest_weight = asked - of * (stopped["words"] or 0), of * max(1, all_weight - (stopped["weight"] or 0))
    part = F.col("weight") * F.lit(rest)
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(part.cast("double") / F.lit(float(rest_weight)))
    budget = F.when(F.col("stops"), F.col("most")).otherwise(F.floor(exact(part) / exact(F.lit(rest_weight))).cast("long"))
    return stored(marked.select("source", "source_size", "words_before", "weight", target.alias("target"), budget.alias("budget")))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of each document, and the columns of ``keep``."""
    key = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 16)
    own = [F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)]
    sized = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row"), *own))
    budgets = source_budgets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    placed = running_totals(sized, [F.col("source").asc_nulls_last(), *(F.col(c).asc() for c in ("key", "doc_id", "size", "row"))], ["size"])
    b = budgets.withColumnRenamed("source", "_source")
    found = placed.join(b, F.col("source").eqNullSafe(F.col("_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    over = F.col("budget") - epochs * F.col("source_size") - (F.col("size_before") - F.col("words_before"))
    taken = epochs * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), over))
    return found.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)))


def copies(mixed: DataFrame) -> DataFrame:
    """The texts of a mix that kept ``text``: doc_id, copy (from 0) and text, once for each time a document is taken, the last one up to its cut."""
    n, rest = F.ceil(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    each = mixed.where("taken > 0").select("doc_id", "size", "text", rest.alias("_rest"), n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("copy"))
    words = F.filter(F.split("text", f"[{_SPACE}]+"), lambda w: w != "")
    cut = (F.col("copy") == F.col("_n") - 1) & (F.col("_rest") > 0)
    return each.select("doc_id", "copy", F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("_rest").cast("int")), " ")).otherwise(F.col("text")).alias("text"))


def oracle_sql() -> str:
    """DuckDB SQL for the rows of ``mix_documents`` with the defaults."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^{_SPACE}]+')), 0) AS BIGINT) AS size,
    substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, coalesce(sum(2 * source_size) OVER w, 0) AS most_before, coalesce(sum(weight) OVER w, 0) AS weight_before, sum(source_size) OVER () AS words, sum(weight) OVER () AS all_weight
  FROM sources WINDOW w AS (ORDER BY source_size * 6 // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, 4 * source_size * (all_weight - weight_before) <= weight * (3 * words - 2 * most_before) AS stops FROM ordered
), rest AS (
  SELECT max(3 * words) - 2 * coalesce(sum(2 * source_size) FILTER (stops), 0) AS part, 2 * greatest(1, sum(weight) - coalesce(sum(weight) FILTER (stops), 0)) AS of FROM marked
), budgets AS (
  SELECT source, source_size, CASE WHEN stops THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(weight * part AS DOUBLE) / CAST(of AS DOUBLE) END AS target,
    CASE WHEN stops THEN 2 * source_size ELSE CAST(weight * part // of AS BIGINT) END AS budget
  FROM marked, rest
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized
), cut AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs, budget, before
  FROM placed JOIN budgets ON placed.source IS NOT DISTINCT FROM budgets.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(0, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM cut
"""
