"""Byte-level BPE encoding with a hierarchical-bitmap rank queue, and decoding.

Merging one pre-token: its bytes form a doubly linked list. Every adjacent pair that is in the vocabulary has a
rank; the queue keeps, per rank, a bucket of list positions, and a two-level bitmap (256 bits a word) over the ranks whose
buckets are not empty. Find-first-set on each level gives the lowest rank, whatever the length of the pre-token.
Entries whose pair has changed since they were queued are stale and skipped. Positions of a bucket leave in ascending
order, which is the order in which the reference tokenizer of the rank file takes equal ranks. Cost: O(n) queue
operations for a pre-token of n bytes, against O(n^2) for repeated scans.

Rows are independent: no shuffle, and each Python worker holds the vocabulary plus a bounded cache of short pre-tokens.

Defined results: a null text counts as empty and gives no ids; texts of any length are encoded whole; special tokens
do not exist, their strings are ordinary text; other columns, whatever their names, stay in the struct ``row``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .caches import worker_cache

#: Pre-tokens of up to this many characters are remembered; at most CACHE_ENTRIES of them, then the cache starts anew.
CACHED_LENGTH = 48
CACHE_ENTRIES = 600_000
#: Bytes of text that are encoded between two output batches.
BATCH_BYTES = 4 << 20


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token, by repeatedly merging the adjacent pair of lowest rank, leftmost first.

    The queue is written out here, as Python calls would cost more than the work: ``buckets`` holds a heap of
    positions per rank, ``words`` a 256-bit word per group of ranks with buckets, ``top`` one bit per group.
    A part is named by its first byte; ``end`` and ``before`` link the parts.
    """
    whole = ranks.get(token)
    if whole is not None:
        return [whole]
    n, rank_of = len(token), ranks.get
    end, before = list(range(1, n + 2)), list(range(-1, n))
    queued = [-1] * (n + 1)  # the rank under which the pair that starts here waits; other entries are stale
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    fresh = [(i, i + 2) for i in range(n - 1)]
    while True:
        for i, stop in fresh:
            rank = rank_of(token[i:stop])
            if rank is None:
                queued[i] = -1
                continue
            queued[i] = rank
            if rank in buckets:
                heappush(buckets[rank], i)
                continue
            buckets[rank] = [i]
            group = rank >> 8
            if group in words:
                words[group] |= 1 << (rank & 255)
            else:
                words[group] = 1 << (rank & 255)
                top |= 1 << group
        if not top:
            break
        group = (top & -top).bit_length() - 1
        bits = words[group]
        lowest = bits & -bits
        rank = group << 8 | lowest.bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            if bits == lowest:
                del words[group]
                top ^= 1 << group
            else:
                words[group] = bits ^ lowest
        fresh = []
        if queued[i] != rank:
            continue
        middle = end[i]
        stop = end[i] = end[middle]
        queued[middle] = queued[i] = -1
        before[stop] = i
        if stop < n:
            fresh.append((i, end[stop]))
        if before[i] >= 0:
            fresh.append((before[i], stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[token[i : end[i]]])
        i = end[i]
    return ids


class _Cache(dict):
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), np.uint32).tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class ByteBPE:
    """The vocabulary of one rank file."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.find = regex.compile(pattern).findall
        self.cache = _Cache(ranks)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.bytes_of = Gather(tokens)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.cache.__getitem__, self.find(text))), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes_of(ids)


class Gather:
    """Concatenates one byte string per id, for many ids at a time."""

    def __init__(self, strings: list[bytes]) -> None:
        self.length = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(strings), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        end = np.cumsum(length)
        if not len(end):
            return b""
        index = np.arange(end[-1]) + np.repeat(self.start[ids] - (end - length), length)
        return self.pool[index].tobytes()


def bpe(rank_file: str, pattern: str) -> ByteBPE:
    """One per Python worker, as long as no other operator uses the worker."""
    return worker_cache("byte_bpe", (rank_file, pattern), lambda: ByteBPE(rank_file, pattern))


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of the batch with about ``most`` bytes in the column, and the column's values."""
    values = batch.column(column)
    lengths = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)] if len(batch) else [0]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a), values.slice(a, b - a).to_pylist()


def with_field(batch: pa.RecordBatch, column: str, at: int, name: str) -> pa.RecordBatch:
    """The batch, and one field of its struct column as another column; so that no text is sent to Python twice."""
    return pa.RecordBatch.from_arrays([*batch.columns, batch.column(column).field(at)], [*batch.schema.names, name])


def encoded(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text") -> DataFrame:
    """row (the input as a struct) and ids (array of int)."""
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index(text_col)
    schema = T.StructType([source.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(rank_file, pattern)
        for batch in batches:
            for part, texts in slices(with_field(batch, "row", at, "text"), "text"):
                ids = [model.encode(t or "") for t in texts]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("row"), column], ["row", "ids"])

    return source.mapInArrow(run, schema)


def decoded(rows: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Adds bytes (binary), decoded from the column ids."""
    schema = T.StructType([*rows.schema.fields, T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(rank_file, pattern)
        for batch in batches:
            values = [model.decode(x) for x in id_arrays(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], [*batch.schema.names, "bytes"])

    return rows.mapInArrow(run, schema)


def id_arrays(column: pa.Array) -> list[np.ndarray]:
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
