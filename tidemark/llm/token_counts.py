"""Exact token counts with a two-tier lookup of pre-token lengths, without a shuffle of pre-tokens.

The tokenizer splits a text into pre-tokens and encodes each on its own, so a text's count is the sum
of its pre-tokens' counts. Most pre-tokens of a corpus are a few frequent ones:

* tier one is a compact table of frequent pre-tokens and their lengths, broadcast to every task;
* tier two is a cache in each worker: what tier one misses is encoded there once and remembered. The
  cache starts anew beyond ``CACHE_ENTRIES``, so its memory is bounded; results don't depend on it.

Tier one comes from all documents: each task counts the words of its rows and passes on only those
that make up at least ``1 / HEAVY`` of them (so ``HEAVY`` rows a task at most). A word with that share
of the corpus has it in some task, so none is missed. The ``TABLE_WORDS`` most frequent are encoded.

The only shuffle is that of these candidates for tier one, already counted: ``HEAVY`` rows a task at most,
whatever the texts hold.

The special string of the tokenizer inside a text counts as one token, as its library has it by
default. Pre-tokens of any length are encoded as they are, without a second split, and long ones aren't kept. A null text counts as empty: no bytes, no tokens. An empty table gives no rows; repeated rows
are counted each.
"""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .packing import VOCABULARY, encoding, special_pattern

#: A word counts as frequent from this share of a task's words on: one in HEAVY.
HEAVY = 16_384
#: Most words in the broadcast table.
TABLE_WORDS = 32_768
#: Most pre-tokens in a worker's cache.
CACHE_ENTRIES = 400_000
LIMIT = 512
#: Longest pre-token that is kept in a cache.
KEPT_CHARS = 200

#: The tokenizer's own split, for any text.
FULL = regex.compile(public_tokenizers.PATTERN)
#: The same split in the standard library's terms, right (and twice as fast) for texts of PLAIN characters only.
FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\xa0-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]")


def pre_tokens(text: str) -> list[str]:
    return (FULL if NOT_PLAIN.search(text) else FAST).findall(text)


class Lengths(dict):
    """Tokens of each pre-token; a miss is encoded and kept, within ``CACHE_ENTRIES`` of ``KEPT_CHARS`` at most."""

    def __init__(self, vocabulary: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.encode, self.frequent = encoding(vocabulary)._encode_single_piece, frequent
        self.special = special_pattern(vocabulary)

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) <= KEPT_CHARS:
            if len(self) > CACHE_ENTRIES + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        """Special strings count one each; what stands between them is split as usual."""
        parts = self.special.split(text)
        return len(parts) // 2 + sum(sum(map(self.__getitem__, pre_tokens(part))) for part in parts[::2] if part)


_caches: dict[str, Lengths] = {}


def frequent_words(docs: DataFrame, heavy: int = HEAVY, table_words: int = TABLE_WORDS) -> list[str]:
    """The most frequent words of all texts, ``table_words`` at most."""

    def tallies(batches):
        seen: Counter[str] = Counter()
        total = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = (text or "").split()
                total += len(words)
                seen.update(words)
            if len(seen) > 50 * heavy:  # lossy counting: a word dropped here has less than its share so far
                seen = Counter({w: n for w, n in seen.items() if n * heavy >= total})
        kept = [(w, n) for w, n in seen.items() if n * heavy >= total]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tallies, "word string, n long")
    top = partial.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(table_words)
    return [row["word"] for row in top.collect()]


def frequent_lengths(words: list[str], vocabulary: str = VOCABULARY) -> dict[str, int]:
    """Lengths of the pre-tokens of each word, after a space and at a line's start."""
    pieces = {p for word in words for p in (*pre_tokens(" " + word), *pre_tokens(word))}
    return {p: len(encoding(vocabulary)._encode_single_piece(p)) for p in sorted(pieces)}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, frequent: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document."""
    if frequent is None:
        frequent = frequent_lengths(frequent_words(docs), vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths = _caches.get(vocabulary)
        if lengths is None or lengths.frequent is not shared.value:
            lengths = _caches[vocabulary] = Lengths(vocabulary, shared.value)
        texts = [text or "" for text in batch.column("text").to_pylist()]
        tokens = pa.array([lengths.count(text) for text in texts], pa.int64())
        sizes = pa.array([len(text.encode()) for text in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, tokens, pa.array([n > limit for n in tokens.to_pylist()], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(rows, count, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
