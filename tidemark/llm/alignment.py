"""Alignment of two tokenizers' tokens by the bytes they cover, and how often their tokens meet.

Both tokenizers cut the same bytes (a space, then the text). Where a token of each ends at the same byte, a
group ends: the smallest stretch that both cut without a rest. Two tokens are linked if their bytes overlap.

A stretch of a document's bytes is a *fragment*: the tokens that end in it. It has an open prefix up to its first common
end, closed groups up to its last, and an open suffix; without any common end all of it is open. Fragments compose:
what is open at their seam closes into groups when the right one has a common end. That is associative, so the
fragments of a long document (``CHUNK`` bytes each) are reduced as a tree, ``FAN`` at a time, in whichever tasks Spark
deals them to; closed groups are set aside where they close and never travel on. A text of up to ``CHUNK`` bytes is one
fragment that is closed at both ends. Texts of more than ``PART_CHARS`` characters are tokenised in parts in different
tasks: neither tokenizer's tokens reach over a single space between characters that aren't white space, so a
part ends at the first such place after its size (a text without one is one part).

Words between such places are encoded once for each batch. Tokens are written once to the shared folder, two bytes each.
The corpus-wide counts of id pairs are summed in tasks before they are shuffled. Pairs go to the workers as a table of
``TABLE`` entries at most: all of them if there are no more, otherwise those of at least one in ``TABLE`` links; the links of other
pairs, summed by document, are joined with the counts by pair (none of which is frequent then).

Null and empty texts, and those whose tokens don't give back the bytes (the second tokenizer reads U+2581 as a space), have no tokens:
zeros and an empty digest. Special strings in a text are ordinary text. Repeated rows are documents of their own and
count as often as they occur; a null id is kept. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, sliced, stored
from .packing import LONG_RUN, _long_run, long_runs

#: The tokenizers: A's ranks and B's model.
A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k", "piece_bpe_32k"
#: Bytes of a fragment.
CHUNK = 1 << 15
#: Characters that a task tokenises at once, about.
PART_CHARS = 1 << 18
#: Fragments that one step of the tree composes.
FAN = 16
#: Most pairs in the workers' table.
TABLE = 1 << 22
#: Pairs that a task sums before it passes them on.
SUMMED = 1 << 20
#: A pair of ids as one number: A's above B's bits.
B_BITS = 15
#: A single space that tokens of neither side reach over.
safe_space = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")


class Tokenizers(NamedTuple):
    a: tiktoken.Encoding
    b: sentencepiece.SentencePieceProcessor
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    a_len: np.ndarray
    b_len: np.ndarray

    def encode_a(self, text: str) -> list[int]:
        if len(text) < LONG_RUN or not _long_run.search(text):
            return self.a.encode_ordinary(text)
        parts = (self.a._encode_single_piece(x) if whole else self.a.encode_ordinary(x) for x, whole in long_runs(text) if x)
        return list(itertools.chain.from_iterable(parts))


def piece_bytes(model: sentencepiece.SentencePieceProcessor, token: int) -> bytes:
    piece = model.id_to_piece(token)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(token) else piece.replace("▁", " ").encode()


@lru_cache(maxsize=2)
def tokenizers(a: str = A_VOCABULARY, b: str = B_VOCABULARY) -> Tokenizers:
    with open(public_tokenizers.path(a + ".tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    a_bytes = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        a_bytes[rank] = token
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b + ".model"))
    b_bytes = [piece_bytes(model, k) for k in range(model.get_piece_size())]
    own = tiktoken.Encoding(a + "-plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizers(own, model, a_bytes, b_bytes, np.array([len(x) for x in a_bytes], np.int64), np.array([len(x) for x in b_bytes], np.int64))


# Tokens


def ragged(ids: list[list[int]], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists that ``codes`` names, one after the other, and how long each is."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint16, int(size.sum()))
    start, n = np.cumsum(size) - size, size[codes]
    return flat[np.repeat(start[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def encoded(texts: list[str], use: Tokenizers) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """A's ids, B's ids and whether both give back the bytes, for a space and each text (none is empty)."""
    split = [safe_space.split(text) for text in texts]
    words = np.fromiter(map(len, split), np.int64, len(split))
    codes, unique = pd.factorize(np.array(list(itertools.chain.from_iterable(split)), object))
    a, b = [use.encode_a(" " + word) for word in unique], use.b.encode(list(unique), num_threads=1)
    right = np.ones(len(unique), bool)
    if b"".join(map(use.b_bytes.__getitem__, itertools.chain.from_iterable(b))) != (" " + " ".join(unique)).encode():
        right = np.array([b"".join(map(use.b_bytes.__getitem__, ids)) == (" " + word).encode() for word, ids in zip(unique, b, strict=True)])
    (a_flat, a_n), (b_flat, b_n) = ragged(a, codes), ragged(b, codes)
    ends = np.cumsum(words)
    a_to, b_to, wrong = (np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends])] for n in (a_n, b_n, ~right[codes]))
    for k in range(len(texts)):
        yield a_flat[a_to[k] : a_to[k + 1]], b_flat[b_to[k] : b_to[k + 1]], wrong[k + 1] == wrong[k]


def text_parts(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters; the single spaces between them are left out."""
    at = 0
    while len(text) - at > size and (found := safe_space.search(text, at + size)):
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


TOKENS = "row long, doc_id {kind}, whole boolean, at long, a binary, b binary, a_from long, b_from long, right boolean, text string"


def chunked(a: np.ndarray, b: np.ndarray, begin: int, use: Tokenizers, size: int) -> Iterator[tuple]:
    """(at, a, b, a_from, b_from): the tokens that end in each stretch of ``size`` bytes, and where the first of them begin."""
    a_end, b_end = np.cumsum(use.a_len[a]), np.cumsum(use.b_len[b])
    bounds = np.arange(size, max(a_end[-1], b_end[-1]) + size, size)
    a_to, b_to = np.searchsorted(a_end, bounds, "right"), np.searchsorted(b_end, bounds, "right")
    for k, (i, j) in enumerate(zip(a_to, b_to, strict=True)):
        i0, j0 = (a_to[k - 1], b_to[k - 1]) if k else (0, 0)
        yield begin + k * size, a[i0:i], b[j0:j], begin + (a_end[i0 - 1] if i0 else 0), begin + (b_end[j0 - 1] if j0 else 0)


def tokens(docs: DataFrame, chunk: int = CHUNK, part_chars: int = PART_CHARS) -> tuple[DataFrame, DataFrame]:
    """The documents, tokenised if they are one fragment, and the fragments of the others; both written."""
    schema = TOKENS.format(kind=dict(docs.dtypes)["doc_id"])

    def rows_of(texts: list[str], begin: list[int], short: bool) -> Iterator[tuple]:
        """(number of the text, whole, at, a, b, a_from, b_from, right)."""
        use = tokenizers()
        for k, (a, b, right) in enumerate(encoded(texts, use) if texts else ()):
            if short and (not right or use.a_len[a].sum() <= chunk):
                yield k, True, 0, *((a, b) if right else (a[:0], b[:0])), 0, 0, True
            elif not right:
                yield k, False, begin[k], a[:0], b[:0], 0, 0, False
            else:
                yield from ((k, False, *x, True) for x in chunked(a, b, begin[k], use, chunk))

    def batch_of(row: list, doc: pa.Array, found: list[tuple], raw: list[tuple]) -> pa.RecordBatch:
        """``raw`` are (number of the document, at, text); of every document that isn't whole there is a row without tokens too."""
        columns = [[], [], [], [], [], [], [], [], []]
        for k, whole, at, a, b, a_from, b_from, right in found:
            for column, x in zip(columns, (k, whole, at, a.tobytes(), b.tobytes(), int(a_from), int(b_from), right, None), strict=True):
                column.append(x)
        for k, at, text in raw:
            for column, x in zip(columns, (k, text is None, at, b"", b"", 0, 0, True, text), strict=True):
                column.append(x)
        kinds = [pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        place = pa.array(columns[0], pa.int64())
        arrays = [pa.array(row, pa.int64()).take(place), doc.take(place), *(pa.array(c, kind) for c, kind in zip(columns[1:], kinds, strict=True))]
        return pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "whole", "at", "a", "b", "a_from", "b_from", "right", "text"])

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text or "" for text in batch.column("text").to_pylist()]
        short = [k for k, text in enumerate(texts) if 0 < len(text) <= part_chars]
        found = [(short[x[0]], *x[1:]) for x in rows_of([texts[k] for k in short], [0] * len(short), True)]
        raw = [(k, 0, None) for k in sorted(set(range(len(texts))) - {x[0] for x in found if x[1]})]
        for k, text in enumerate(texts):
            if len(text) > part_chars:
                begin = 0
                for part in text_parts(text, part_chars):
                    raw.append((k, begin, part))
                    begin += 1 + len(part.encode())
        return batch_of(batch.column("row").to_pylist(), batch.column("doc_id"), found, raw)

    def later(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(rows_of(batch.column("text").to_pylist(), batch.column("at").to_pylist(), False))
        return batch_of(batch.column("row").to_pylist(), batch.column("doc_id"), found, [])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    made = stored(map_batches(numbered, first, schema), "zstd")
    long = made.where("NOT whole")
    parts = long.where("text IS NOT NULL").repartition(F.xxhash64("row", "at"))
    fragments = stored(long.where("text IS NULL").unionByName(map_batches(parts, later, schema)).drop("text", "whole"), "zstd")
    return made.where("whole").select("row", "doc_id", "a", "b"), fragments


# Fragments

OPEN = ["pa", "pb", "sa", "sb"]
FRAGMENT = "row long, at long, place long, cut boolean, p_at long, pa binary, pb binary, sa binary, sb binary, a binary, b binary"


class Fragment(NamedTuple):
    """What is open of a stretch: ids as bytes before its first common end, which lies in the fragment at ``p_at``, and after its last."""

    cut: bool
    p_at: int
    pa: bytes
    pb: bytes
    sa: bytes = b""
    sb: bytes = b""

    def then(self, right: Fragment) -> tuple[Fragment, tuple[int, bytes, bytes] | None]:
        """This and the next stretch as one, and the groups that their seam closes: where, A's and B's ids."""
        if self.cut:
            a, b = self.sa + right.pa, self.sb + right.pb
            if right.cut:
                return self._replace(sa=right.sa, sb=right.sb), (right.p_at, a, b)
            return self._replace(sa=a, sb=b), None
        return right._replace(pa=self.pa + right.pa, pb=self.pb + right.pb), None


def fragment_of(at: int, a: np.ndarray, b: np.ndarray, a_from: int, b_from: int, use: Tokenizers) -> tuple[Fragment, tuple[bytes, bytes]]:
    """The open ends of one stretch's tokens and its closed groups."""
    a_end, b_end = a_from + np.cumsum(use.a_len[a]), b_from + np.cumsum(use.b_len[b])
    common = np.intersect1d(a_end, b_end, assume_unique=True)
    if not len(common):
        return Fragment(False, at, a.tobytes(), b.tobytes()), (b"", b"")
    (i, k), (j, m) = (np.searchsorted(ends, common[[0, -1]]) + 1 for ends in (a_end, b_end))
    return Fragment(True, at, a[:i].tobytes(), b[:j].tobytes(), a[k:].tobytes(), b[m:].tobytes()), (a[i:k].tobytes(), b[j:m].tobytes())


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[field.split()[0] for field in FRAGMENT.split(", ")], dtype=object)


def closed_groups(fragments: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """row, place, a, b: the groups of each document's fragments, closed, in the order of ``place``."""
    spark = fragments.sparkSession
    wrong = fragments.where("NOT right").select("row").distinct()
    fragments = fragments.join(wrong, "row", "left_anti")

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = tokenizers()
        for frame in frames:
            out = []
            for x in frame.itertuples():
                own, (a, b) = fragment_of(x.at, np.frombuffer(x.a, np.uint16), np.frombuffer(x.b, np.uint16), x.a_from, x.b_from, use)
                out.append((x.row, x.at, None, *own, None, None))
                if a:
                    out.append((x.row, x.at, 2 * x.at + 1, *[None] * 6, a, b))
            yield _frame(out)

    def composed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out, whole = [], None
        for x in group.sort_values("at").itertuples():
            own = Fragment(bool(x.cut), int(x.p_at), x.pa, x.pb, x.sa, x.sb)
            whole, seam = (own, None) if whole is None else whole.then(own)
            if seam:
                out.append((key[0], None, 2 * seam[0], *[None] * 6, *seam[1:]))
        return _frame([*out, (key[0], int(group["at"].min()), None, *whole, None, None)])

    last = fragments.agg(F.max("at")).first()[0]
    if last is None:
        return spark.createDataFrame([], "row long, place long, a binary, b binary")
    step = stored(fragments.mapInPandas(local, FRAGMENT))
    closed, width, tasks = [step.where("a IS NOT NULL")], chunk, int(spark.conf.get("spark.sql.shuffle.partitions"))
    while width <= last:
        width *= fan
        # Open ends are few bytes but work, so they are dealt to all tasks rather than by their size.
        dealt = step.where("a IS NULL").withColumn("_stretch", F.floor(F.col("at") / width)).repartition(tasks, "row", "_stretch")
        step = stored(dealt.groupBy("row", "_stretch").applyInPandas(composed, FRAGMENT))
        closed.append(step.where("a IS NOT NULL"))
    # A document begins at a common end, so what is open before its first one is closed too; after its last nothing is open.
    closed.append(step.where("a IS NULL").withColumns({"place": 2 * F.col("p_at"), "a": F.col("pa"), "b": F.col("pb")}))
    found = closed[0]
    for more in closed[1:]:
        found = found.unionByName(more)
    return found.select("row", "place", "a", "b")


# Links


class Links(NamedTuple):
    """The links of closed groups that follow each other: first those at A's ends, then those at B's ends that aren't A's."""

    a: np.ndarray
    b: np.ndarray
    pairs: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    common: np.ndarray


def links_of(a: np.ndarray, b: np.ndarray, use: Tokenizers) -> Links:
    """``of_a`` and ``of_b`` are the places of A's and B's tokens up to which links were made; ``common`` tells which A tokens end a group.

    The ends of both cut the bytes into intervals, each in one token of either side: one link each.
    """
    a_end, b_end = np.cumsum(use.a_len[a]), np.cumsum(use.b_len[b])
    in_b, in_a = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
    alone = np.flatnonzero(a_end[in_a] != b_end)
    pairs = np.concatenate([(a.astype(np.int32) << B_BITS) | b[in_b], (a[in_a[alone]].astype(np.int32) << B_BITS) | b[alone]])
    return Links(a, b, pairs, np.arange(len(a)), alone, b_end[in_b] == a_end)


def joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A's and B's ids of all rows, and where each row's begin (one more entry: the end)."""
    found = []
    for name in "ab":
        values = batch.column(name).to_pylist()
        found.append(np.frombuffer(b"".join(values), np.uint16))
        found.append(np.concatenate([[0], np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) // 2)]))
    return found[0], found[2], found[1], found[3]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], np.add.reduceat(count, starts)


def pair_counts(pieces: DataFrame) -> DataFrame:
    """pair, n, best: the links of each id pair in the whole corpus, and whether no pair of its B id has more; written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, keys, counts, held = tokenizers(), [], [], 0

        def out():
            key, n = summed(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(n, pa.int64())], ["pair", "n"])

        for batch in sliced(batches):
            a, b, _, _ = joined(batch)
            if not len(a):
                continue
            key, n = np.unique(links_of(a, b, use).pairs, return_counts=True)
            keys, counts, held = [*keys, key], [*counts, n], held + len(key)
            if held > SUMMED:
                key, n = summed(keys, counts)
                keys, counts, held = [key], [n], len(key)
                if held > SUMMED // 2:
                    yield out()
                    keys, counts, held = [], [], 0
        if keys:
            yield out()

    found = stored(pieces.select("a", "b").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b")
    most = found.groupBy(b).agg(F.max("n").alias("most"))  # an entry for each id of B at most
    return stored(found.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _names(width: int) -> np.ndarray:
    """Decimal numbers below ``width`` as rows of bytes: a place for a separator, the digits, zeros."""
    found = np.zeros((width, 6), np.uint8)
    digits = np.char.encode(np.arange(width).astype(str)).astype("S5")
    found[:, 1:] = digits.view(np.uint8).reshape(width, 5)
    return found


@lru_cache(maxsize=1)
def names() -> np.ndarray:
    return _names(1 << 16)


def written(links: Links, a_from: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of all tokens as bytes, and the places in it of each row's begin and end (``a_from`` has one row at least)."""
    ends = links.common
    starts = np.concatenate([[True], ends[:-1]])
    group_a = np.cumsum(starts) - 1
    n_a = np.bincount(group_a)
    a_before = np.cumsum(n_a)  # A's tokens up to and with each group
    b_ends = np.ones(len(links.b), bool)
    b_ends[links.of_b] = False
    b_starts = np.concatenate([[True], b_ends[:-1]])
    group_b = np.cumsum(b_starts) - 1
    b_before = np.cumsum(np.bincount(group_b)) - np.bincount(group_b)
    place_a, place_b = np.arange(len(links.a)) + b_before[group_a], np.arange(len(links.b)) + a_before[group_b]
    out = np.empty((len(links.a) + len(links.b), 6), np.uint8)
    own = names()[links.a]
    own[:, 0] = np.where(starts, ord(";"), ord(","))
    own[a_from[:-1][a_from[:-1] < len(own)], 0] = 0  # a row's first token has nothing before it
    out[place_a] = own
    own = names()[links.b]
    own[:, 0] = np.where(b_starts, ord("|"), ord(","))
    out[place_b] = own
    full = out != 0
    begins = np.concatenate([place_a, [len(out)]])[a_from]
    return out[full], np.concatenate([[0], np.cumsum(full.sum(1))])[begins]


MEASURED = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, missed array<struct<pair int, n long>>"


def alignment(docs: DataFrame, chunk: int = CHUNK, part_chars: int = PART_CHARS, table: int = TABLE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    whole, fragments = tokens(docs, chunk, part_chars)
    closed = stored(closed_groups(fragments, chunk), "zstd")
    pieces = whole.select("row", "doc_id", F.lit(None).cast("long").alias("place"), "a", "b").unionByName(closed.withColumn("doc_id", F.lit(None).cast(kind)))
    counts = pair_counts(pieces)
    size = counts.agg(F.count("*").alias("pairs"), F.sum("n").alias("links")).first()
    frequent = counts if size["pairs"] <= table else counts.where(F.col("n") * table >= F.lit(size["links"]))
    known = frequent.sort("pair").toArrow()
    shared = spark.sparkContext.broadcast((known["pair"].to_numpy(), known["n"].to_numpy(), known["best"].to_numpy().astype(bool)))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        use, (keys, amounts, bests) = tokenizers(), shared.value
        a, b, a_from, b_from = joined(batch)
        rows = batch.num_rows
        zero = np.zeros(rows, np.int64)
        n_groups = n_links = n_best = count_sum = zero
        digests, missed = [""] * rows, [None] * rows
        if len(a):
            links = links_of(a, b, use)
            unique, inverse = np.unique(links.pairs, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, unique), max(0, len(keys) - 1))
            hit = keys[at] == unique if len(keys) else np.zeros(len(unique), bool)
            amount, best = (np.where(hit, x[at] if len(keys) else 0, 0)[inverse] for x in (amounts, bests))
            b_at = np.searchsorted(links.of_b, b_from)  # where each row's links at B's own ends begin

            def by_row(values: np.ndarray) -> np.ndarray:
                first, second = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (values[: len(a)], values[len(a) :]))
                return np.diff(first[a_from]) + np.diff(second[b_at])

            n_links, n_best, count_sum, n_groups = by_row(np.ones(len(links.pairs), np.int64)), by_row(best), by_row(amount), np.diff(np.concatenate([[0], np.cumsum(links.common)])[a_from])
            if not hit.all():
                lost = np.flatnonzero(~hit[inverse])
                row = np.where(lost < len(a), np.searchsorted(a_from, lost, "right"), np.searchsorted(b_at, lost - len(a), "right")) - 1
                pairs, n = np.unique((row.astype(np.int64) << 32) | links.pairs[lost], return_counts=True)
                for r, some in itertools.groupby(zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), n.tolist(), strict=True), lambda x: x[0]):
                    missed[r] = [{"pair": pair, "n": k} for _, pair, k in some]
            text, begin = written(links, a_from)
            places = batch.column("place").to_pylist()
            for k in range(rows):
                if places[k] is None and a_from[k + 1] > a_from[k]:
                    digests[k] = hashlib.sha256(text[begin[k] : begin[k + 1]]).hexdigest()
        numbers = [np.diff(a_from), np.diff(b_from), n_groups, n_links, n_best, count_sum]
        arrays = [batch.column("row"), batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in numbers), pa.array(digests, pa.string()), pa.array(missed, pa.list_(pa.struct([("pair", pa.int32()), ("n", pa.int64())])))]
        return pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "missed"])

    measured = map_batches(pieces, measure, f"row long, doc_id {kind}, {MEASURED}")
    if size["pairs"] > table:
        measured = stored(measured)
        tail = measured.select("row", F.explode("missed").alias("m")).select("row", "m.pair", F.col("m.n").alias("k")).join(counts, "pair")
        more = tail.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
        measured = measured.drop("missed").unionByName(more, allowMissingColumns=True)
    long = long_digests(closed)
    found = measured.drop("missed").unionByName(long, allowMissingColumns=True)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    # Only one row of each document carries its id, and only one a digest.
    each = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in numbers), F.max("groups_sha256").alias("groups_sha256"))
    return each.select("doc_id", *numbers, "groups_sha256")


def long_digests(closed: DataFrame) -> DataFrame:
    """row, groups_sha256 of documents of several pieces, which stream through a task one after the other."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, current, digest = tokenizers(), None, None
        for batch in sliced(batches):
            rows, digests = [], []
            for row, a, b in zip(*(batch.column(c).to_pylist() for c in ("row", "a", "b")), strict=True):
                if row != current:
                    if digest is not None:
                        rows, digests = [*rows, current], [*digests, digest.hexdigest()]
                    current, digest = row, hashlib.sha256()
                else:
                    digest.update(b";")
                ids = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
                digest.update(written(links_of(*ids, use), np.array([0, len(ids[0])]))[0])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(digests, pa.string())], ["row", "groups_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["row", "groups_sha256"])

    return closed.repartition("row").sortWithinPartitions("row", "place").mapInArrow(stream, "row long, groups_sha256 string")
