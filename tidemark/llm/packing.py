"""Packing of tokenised documents into training sequences by sums of squares.

Every document becomes its token ids and one end id. Only a document longer than a sequence is cut:
into whole sequences, and a first piece for what is left over. The pieces are dealt by a hash into
groups of some thousands, and each group is packed on its own, longest piece first: a piece goes to
the open sequence for which the sum of the squared counts of open sequences per residual gap becomes
smallest; a new sequence is opened only if the piece fits in none. Groups are small enough for one
task and large enough that a group ends with few sequences that aren't full, so no piece has to meet
all others, and the number of groups grows with the input.

Texts are tokenised once, map-side, and the pieces are written to the shared folder: their number gives the
number of groups, and only a few numbers for each piece are shuffled (its ids too, where they are asked for). The
hash that deals takes in a row's place, so repeated rows, null ids and the pieces of one very long text spread over
all groups like any others. A null or empty text is one end id. Repeated rows are packed as often as they occur. Of
pieces of equal length the smaller id, piece and checksum is placed first. An empty table gives no rows.

The library splits white space at a text's long runs by backtracking, which overflows its stack from about a million
characters. Such runs are cut out first, exactly where its pattern would, and encoded as the single pre-token they are.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, unused

CAPACITY = 1024
END_ID = 2
#: The tokenizer: the name of its files without their endings.
VOCABULARY = "byte_bpe_50k"
#: Pieces for each packing group, about.
GROUP_PIECES = 4000
#: Groups for each task, about.
GROUPS_AT_ONCE = 4
#: Runs of white space from this length on are cut out before encoding.
LONG_RUN = 10_000
_long_run = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_RUN)


@lru_cache(maxsize=2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    """The byte-level BPE whose ranks file is ``vocabulary``.tiktoken, with the special strings that ``vocabulary``.json declares: the same ids."""
    with open(public_tokenizers.path(vocabulary + ".tiktoken"), "rb") as lines:
        ranked = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    with open(public_tokenizers.path(vocabulary + ".json"), encoding="utf-8") as file:
        special = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranked, special_tokens=special)


def long_runs(text: str) -> Iterator[tuple[str, bool]]:
    """``text``, which holds no special string, in parts; true for a long run of white space that is one pre-token.

    The split takes a run of white space up to its last character if something follows, which then begins the
    next pre-token, and all of it at the end of the text.
    """
    at = 0
    for run in _long_run.finditer(text):
        end = run.end() - (run.end() < len(text))
        yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    yield text[at:], False


@lru_cache(maxsize=2)
def special_pattern(vocabulary: str) -> re.Pattern:
    return re.compile("(" + "|".join(map(re.escape, sorted(encoding(vocabulary).special_tokens_set))) + ")")


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    """The ids of a text of any length and any runs."""
    own = encoding(vocabulary)
    if len(text) < LONG_RUN or not _long_run.search(text):
        return own.encode_to_numpy(text, allowed_special="all")
    found = []
    for k, part in enumerate(special_pattern(vocabulary).split(text)):
        if k % 2:
            found.append(own.encode_to_numpy(part, allowed_special="all"))
        else:
            found += (np.array(own._encode_single_piece(x), np.uint32) if whole else own.encode_to_numpy(x, disallowed_special=()) for x, whole in long_runs(part) if x)
    return np.concatenate(found)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(start, capacity) for start in range(first, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document; with_ids adds its ids."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in range(6)]
        for at, text in enumerate(batch.column("text").to_pylist()):
            ids = np.append(token_ids(text or "", vocabulary), END_ID).astype("<u4").tobytes()
            for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                own = ids[4 * start : 4 * (start + length)]
                for column, value in zip(rows, (at, piece, start, length, zlib.crc32(own), own), strict=True):
                    column.append(value)
        doc = batch.column("doc_id").take(pa.array(rows[0], pa.int64()))
        arrays = [doc, pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            arrays, names = [*arrays, pa.array(rows[5], pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names)

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), pieces, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset in it of each piece, in the order given; lengths are 1 to capacity."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by residual gap
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened, never = 0, np.iinfo(np.int64).max // 2
    for at, s in enumerate(lengths.tolist()):
        # Taking one from the count n of gap g changes its square by 1 - 2n, adding one to gap g - s by 2n + 1.
        change = np.where(count[s:capacity] > 0, 1 - 2 * count[s:capacity], never)
        change[1:] += 2 * count[1 : capacity - s] + 1
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] < never:
            gap = s + best
            count[gap] -= 1
            bin_ = gaps[gap].pop()
        else:
            gap, bin_, opened = capacity, opened, opened + 1
        place[at], offset[at] = bin_, capacity - gap
        if gap > s:
            count[gap - s] += 1
            gaps[gap - s].append(bin_)
    return place, offset


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``groups`` groups are packed apart from each other."""
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    kinds, key = dict(pieces.dtypes), unused(pieces, "group")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id long, offset long"

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        inside, offset = sum_of_squares(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(group[key].to_numpy(np.int64) << 32) + inside, offset=offset)[[*columns, "sequence_id", "offset"]]

    row = F.monotonically_increasing_id()
    dealt = pieces.select(*columns).withColumn(key, F.pmod(F.xxhash64(row, "piece", "ids_crc32"), F.lit(max(1, groups))))
    parts = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // GROUPS_AT_ONCE))
    return dealt.repartition(parts, key).groupBy(key).applyInPandas(place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: sequence_id, and a gapless offset there."""
    pieces = stored(token_pieces(docs, capacity, with_ids=with_ids))
    return pack(pieces, -(-pieces.count() // group_pieces), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences of ``pack_documents(..., with_ids=True)``: sequence_id, doc_ids, length, ids.

    ids is the little-endian unsigned 32-bit form; a sequence holds ``capacity`` ids at most.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"),
        F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"),
        F.expr("unhex(array_join(transform(p, x -> hex(x.ids)), ''))").alias("ids"),
    )
