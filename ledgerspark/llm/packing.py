"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

Documents of more than a window are cut into full windows and a rest. Each rest goes, in arrival order, to the fill level
that keeps the sum over levels of (number of open windows at that level)^2 smallest; the counts are one array indexed
by level. Placing an item of length s on a window at level h changes that sum by 2*(N[h+s] - N[h]) + 2, or by
1 - 2*N[h] if the window is then full, or by 2*N[s] + 1 for a new window; ties go to the fullest window.

Each partition of the input is packed by itself, so nothing is shuffled, state is one level array and the open windows,
and a task that runs again gives the same windows. At the end of the partition, and whenever more than ``MOST_OPEN`` windows are
open, windows are closed: the emptiest one is dissolved and its pieces are placed again by the same rule, now with levels
allowed on which a piece doesn't fit whole. There it is cut, fills the window (a change of 1 - 2*N[h]), and what is left is placed next. So at
most one window per partition is padded. Documents may be cut freely, and each id lies in exactly one piece.

Ids are those of the tokenizers library without added special tokens; the strings of special tokens inside a text become their ids, as
in the library. Defined results: a null or empty text is a document of the end id alone; texts of any length are tokenized whole;
repeated rows are packed as often as they occur; other columns, whatever their names, do not take part.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_bpe import slices
from .caches import worker_cache

WINDOW = 2048
END_ID = 1
#: Open windows per task; each holds less than one window of ids.
MOST_OPEN = 4096
BATCH_BYTES = 4 << 20
#: Runs, and words, that a worker remembers. 42 MB of text hold 595,000 distinct runs: fewer entries are dropped and learned again over and over.
CACHE_ENTRIES = 800_000
CACHED_LENGTH = 48
#: Bytes of text that are tokenized together.
SLICE_BYTES = 2 << 20

SCHEMA = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Texts in this range need no normal form, and all libraries agree on its letters, digits, spaces and lower case.
_PLAIN = re.compile(r"[\t\n\v\f\r\x20-\x7E¡-¬®-įĲ-ſ]*")
#: Strings of special tokens begin so; texts with it go through the library whole.
_SPECIAL = "<|"
#: The pre-token pattern of the vocabulary file, and the mark of tokens that end a pre-token.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_WORD_END = "</w>"
#: Single pre-tokens at the end of a run of letters.
_MARKS = frozenset(".,;:!?")


def _pre_tokens(run: str) -> list[str]:
    """The pre-tokens of a run of non-space characters; words, and words with a mark after them, need no pattern."""
    if run.isalpha():
        return [run]
    if run[-1] in _MARKS and run[:-1].isalpha():
        return [run[:-1], run[-1]]
    return _WORDS.findall(run)


class WordTokenizer:
    """Ids by the tokenizers library, which sees each distinct pre-token once while it is remembered.

    The file's pre-tokens hold no space and are encoded independently, so the ids of a plain text are those of its pre-tokens in order;
    runs of non-space characters are remembered too, so that most of a text needs no pattern. Other texts go through the library whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Encodes many pre-tokens in one call; the last token of each says that it is."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.int32)
        edge, flat = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
        for word, a, b in zip(words, [0, *edge], edge, strict=False):
            self.words[word] = flat[a:b]

    def _learn_runs(self, runs: list[str]) -> None:
        split = list(map(_pre_tokens, runs))
        words = set(chain.from_iterable(split))
        new = list(words.difference(self.words))
        if len(self.words) + len(new) > CACHE_ENTRIES:
            self.words.clear()
            new = list(words)
        for at in range(0, len(new), 1_000):
            self._learn(new[at : at + 1_000])
        known = self.words.__getitem__
        for run, parts in zip(runs, split, strict=True):
            self.runs[run] = b"".join(map(known, parts)) if len(parts) > 1 else known(parts[0])
        for word in new:
            if len(word) > CACHED_LENGTH:
                del self.words[word]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        # Many short-lived lists and no cycle among them: the cycle collector would walk all of them many times.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode_all(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_all(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.lower().split() if _PLAIN.fullmatch(t) and _SPECIAL not in t else None for t in texts]
        runs = set().union(*(x for x in split if x))
        new = list(runs.difference(self.runs))
        if len(self.runs) + len(new) > CACHE_ENTRIES:
            self.runs.clear()
            new = list(runs)
        self._learn_runs(new)
        known = self.runs.__getitem__
        out = [
            np.frombuffer(b"".join(map(known, x)), np.int32) if x is not None else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32)
            for t, x in zip(texts, split, strict=True)
        ]
        for run in new:
            if len(run) > CACHED_LENGTH:
                del self.runs[run]
        return out


def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, as long as no other operator uses the worker."""
    return worker_cache("packing", path, lambda: WordTokenizer(path))


class Window:
    """Pieces (doc_id, start, ids, doc_tokens) and their total length."""

    __slots__ = ("pieces", "level")

    def __init__(self) -> None:
        self.pieces: list[tuple] = []
        self.level = 0

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.level += len(piece[2])


class SumOfSquares:
    """Online packer; add() and close() return the windows that are finished."""

    def __init__(self, capacity: int = WINDOW, most_open: int = MOST_OPEN) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.count = np.zeros(capacity + 1, np.int64)  # open windows by level; [0] and [capacity] stay 0
        self.open: list[list[Window]] = [[] for _ in range(capacity)]
        self.total = 0

    def level_for(self, size: int, cut: bool = False) -> int:
        """The level to place an item of this size on; 0 is a new window. ``cut``: open levels only, also those where it doesn't fit whole."""
        count, room, never = self.count, self.capacity - size, np.iinfo(np.int64).max
        change = 2 * (count[size : self.capacity + 1] - count[: room + 1]) + 2
        change[room] -= 1  # a full window leaves the count
        change[0] = 2 * count[size] + 1 if room else 0
        change[1:][count[1 : room + 1] == 0] = never
        if cut:
            change[0] = never
            filled = np.where(count[room + 1 : self.capacity] > 0, 1 - 2 * count[room + 1 : self.capacity], never)
            change = np.concatenate([change, filled])
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[Window]:
        n, cut = len(ids), len(ids) - len(ids) % self.capacity
        for start in range(0, cut, self.capacity):
            window = Window()
            window.add((doc_id, start, ids[start : start + self.capacity], n))
            yield window
        if cut == n:
            return
        window = self._place((doc_id, cut, ids[cut:].copy(), n), self.level_for(n - cut))
        if window:
            yield window
        if self.total > self.most_open:
            yield from self.close(self.most_open // 2)

    def _place(self, piece: tuple, level: int) -> Window | None:
        """Adds the piece to a window of this level; the window, if it is then full."""
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        else:
            window = Window()
            self.total += 1
        window.add(piece)
        if window.level == self.capacity:
            self.total -= 1
            return window
        self.open[window.level].append(window)
        self.count[window.level] += 1
        return None

    def close(self, most: int = 0) -> Iterator[Window]:
        """Closes windows until at most ``most`` are open; the last one is given as it is."""
        while self.total > max(most, 1):
            at = 1 + int(np.argmax(self.count[1 : self.capacity] > 0))
            emptiest = self.open[at].pop()
            self.count[at] -= 1
            self.total -= 1
            for doc_id, start, ids, n in emptiest.pieces:
                while len(ids):
                    level = self.level_for(len(ids), cut=True) if self.total else 0
                    head = ids[: self.capacity - level]
                    window = self._place((doc_id, start, head, n), level)
                    if window:
                        yield window
                    start, ids = start + len(head), ids[len(head) :]
        if most < 1:
            for level in self.open:
                yield from level
                level.clear()
            self.count[:] = 0
            self.total = 0


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32 (of the little-endian 32-bit ids), doc_tokens, sequence_id, offset."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer_path).encode_all
        packer, first = SumOfSquares(), TaskContext.get().partitionId() << 32
        ready: list[tuple] = []
        size = made = 0

        def finish(windows: Iterator[Window]) -> None:
            nonlocal size, made
            for window in windows:
                offset = 0
                for doc_id, start, ids, n in window.pieces:
                    ready.append((doc_id, start, ids, n, first + made, offset))
                    offset += len(ids)
                made += 1
                size += 4 * offset

        for batch in batches:
            for part, texts in slices(batch, "text", SLICE_BYTES):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in texts]), strict=True):
                    finish(packer.add(doc_id, np.append(ids, np.int32(END_ID))))
                    if size >= BATCH_BYTES:
                        yield _table(ready)
                        ready, size = [], 0
        finish(packer.close())
        yield _table(ready)

    return source.mapInArrow(run, SCHEMA)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, ids, n, sequence, offset = zip(*rows, strict=True) if rows else ([],) * 6
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int32)
    crc = [zlib.crc32(np.ascontiguousarray(x, "<i4")) for x in ids]
    columns = [pa.array(x, pa.int64()) for x in (doc_id, start, np.diff(ends), crc, n, sequence, offset)]
    columns.insert(3, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
