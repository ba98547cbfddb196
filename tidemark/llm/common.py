"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

__all__ = ["WORD", "crc_mod", "hash_below", "labelled_texts", "map_batches", "parts", "sampled_labels", "stored", "table", "unused"]

#: A word: what stands between ASCII white space (space and U+0009 to U+000D).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the fold of a document (null id: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sliced(batches: Iterator[pa.RecordBatch], size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, one row at least: a worker's memory doesn't follow Spark's batches."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(size, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``function`` over the rows of ``df`` in Arrow batches of a few MB; a batch may yield nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    name = "_" + name.lower()
    while name in taken:
        name += "_"
    return name


def hash_below(share: float, *columns: str) -> Column:
    """Whether the hash of these columns is in the lowest ``share`` of all 64-bit hashes."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*columns) < F.lit(int(share * 2.0**64) - 2**63)


def sampled_labels(labels: DataFrame, value: str, max_rows: int) -> DataFrame:
    """``max_rows`` labelled ids at most, one row for each id: ``doc_id`` and ``value``.

    The sample is the labels whose ids have the smallest hashes, so it's the same at each run and has no
    order of rows in it. An id with several labels keeps the largest. Of many labels a share of the hash
    range somewhat larger than needed is taken first, so that few rows meet where the smallest are chosen.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull()).select("doc_id", value)
    ids = usable.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]
    few = usable.where(hash_below(1.5 * max_rows / max(1, ids), "doc_id"))
    return few.groupBy("doc_id").agg(F.max(value).alias(value)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The texts of a sample's ids with its columns, one row for each id: of repeated ids the largest text."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    return texts.groupBy("doc_id").agg(F.max("text").alias("text")).join(F.broadcast(sample), "doc_id")


def parts(texts: list, size: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts (None counts as empty) of about ``size`` together, one at least."""
    start = total = 0
    for at, text in enumerate(texts):
        total += len(text or "")
        if total >= size:
            yield start, at + 1
            start, total = at + 1, 0
    if start < len(texts):
        yield start, len(texts)
