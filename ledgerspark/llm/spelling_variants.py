"""Grouping of spelling variants: words one edit apart, by dynamic programming over sorted vocabularies.

A vocabulary is scanned in sorted order for each word that is looked up. Rows of the edit matrix (only the band of three cells about
the diagonal can hold values up to one) belong to prefixes, so the rows of the prefix that a word shares with the one before
it are used again, and where every cell of a prefix's row exceeds one edit, the whole range of words with that prefix is skipped.

To spread the work, a word and its near word share either their first half or their last half: with one edit, common
prefix and common suffix together have all code points but one of the longer word. So the vocabulary is sorted twice, by word and by
reversed word; entries of length L are looked up by words of length L and L - 1 with the same first L // 2 code points. Sorting is by
range, so one key may lie in many partitions; each partition cuts its keys' entries and questions into blocks of at most ``BLOCK``
words. Blocks meet by key, except pairs whose shared prefixes are too unlike for any member pair. A task therefore holds two
blocks, however frequent a key is; only the numbers of pairs (count, best) leave it.

Defined results: a null text holds no words; a null id counts as the empty string in the noise rule; words shorter than ``LEAST_CHARS``
or rarer than ``LEAST_COUNT`` take no part; of near words equally frequent the smallest in code-point order is the form; an empty
table gives an empty one; texts are read whole; repeated rows count each; other columns do not matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_COUNT = 5, 3
#: Words of a block, at most.
BLOCK = 2048
_LAST = "\U0010ffff"


def vocabulary(docs: DataFrame, noise: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n. With ``noise``, a run whose crc32 with its document's id that number divides loses the code point at crc32 % length."""
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    word = F.col("run")
    if noise:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % noise == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length("run")))).otherwise(word)
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _next_rows() -> list[list[int]]:
    """Band rows by number (three cells of 0, 1 or 2 = more, as base-3 digits): the row below for each pattern of matches.

    Cell d of row i is the edit distance of the entry's first i and the word's first i + d - 1 code points. A cell depends on
    the one above it to the left (up[d]), on the one above (up[d + 1]) and on the one to the left (row[d - 1]).
    """
    table = []
    for number in range(27):
        up = [number // 9, number // 3 % 3, number % 3, 2]
        below = []
        for pattern in range(8):
            row = [2]
            for d in range(3):
                row.append(min(up[d] + 1 - (pattern >> d & 1), up[d + 1] + 1, row[-1] + 1, 2))
            below.append(row[1] * 9 + row[2] * 3 + row[3])
        table.append(below)
    return table


_BELOW = _next_rows()
_FIRST, _DEAD = 2 * 9 + 0 * 3 + 1, 26
#: The digit of a cell.
_CELL = (9, 3, 1)


def near_in_block(word: str, entries: list[str], shared: list[int], common: int = 0) -> Iterator[int]:
    """Places of the sorted entries exactly one edit from word. shared[i]: the common prefix of entries i - 1 and i; common: of all."""
    m = len(word)
    around = f"\0{word}\0\0"  # cells beyond the word never reach those within
    rows = [_FIRST] * (m + 3)
    i, n, depth = 0, len(entries), 0
    while i < n:
        entry = entries[i]
        size = len(entry)
        if size - m > 1 or m - size > 1:
            i += 1
            if i < n and shared[i] < depth:
                depth = shared[i]
            continue
        row = rows[depth]
        while depth < size:
            c = entry[depth]
            row = _BELOW[row][(around[depth] == c) + 2 * (around[depth + 1] == c) + 4 * (around[depth + 2] == c)]
            depth += 1
            rows[depth] = row
            if row == _DEAD:
                break
        if row == _DEAD:  # no word with this prefix is near
            i = bisect_left(entries, entry[:depth] + _LAST, i + 1)
            if i < n:
                other, k = entries[i], common
                while k < depth - 1 and other[k] == entry[k]:  # they differ before depth
                    k += 1
                depth = k
            continue
        if row // _CELL[m - size + 1] % 3 == 1:
            yield i
        i += 1
        if i < n:
            depth = shared[i]


def _common(a: str, b: str) -> int:
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    return k


_BLOCKS = pa.schema([
    ("backward", pa.bool_()), ("length", pa.int32()), ("half", pa.string()), ("asked", pa.bool_()), ("shared", pa.string()),
    ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
])
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])
#: Words, or found rows, of one Arrow batch.
_BATCH = 20_000


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (backward, length, half, asked, spelled, n) as blocks of one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, counts, blocks, held = None, [], [], [], 0
        for batch in batches:
            for *own, word, n in zip(*(batch.column(c).to_pylist() for c in ("backward", "length", "half", "asked", "spelled", "n")), strict=True):
                if words and (own != key or len(words) == size):
                    blocks.append((*key, words[0][: _common(words[0], words[-1])], words, counts))
                    held += len(words)
                    words, counts = [], []
                    if held >= _BATCH:
                        yield _batch(blocks, _BLOCKS)
                        blocks, held = [], 0
                key = own
                words.append(word)
                counts.append(n)
        if words:
            blocks.append((*key, words[0][: _common(words[0], words[-1])], words, counts))
            yield _batch(blocks, _BLOCKS)

    return run


def _found(x: dict) -> Iterator[tuple]:
    """Of a pair of blocks: word, n_near, and n and spelling of the best near word."""
    entries, counts, back, cut = x["words"], x["counts"], x["backward"], x["length"] // 2
    shared = [0, *map(_common, entries, entries[1:])]
    found: dict[str, tuple] = {}

    def meet(word: str, n: int, other: str) -> None:
        many, order, best = found.get(word, (0, 0, ""))
        found[word] = (many + 1, *min((order, best), (-n, other)))

    for asked, n in zip(x["asked_words"], x["asked_counts"], strict=True):
        for i in near_in_block(asked, entries, shared, cut):
            a, b = asked, entries[i]
            if back:
                a, b = a[::-1], b[::-1]
                if a[:cut] == b[:cut]:
                    continue  # met in the forward list
            meet(a, counts[i], b)
            if len(a) != len(b):  # of equal lengths, the other one asks as well
                meet(b, n, a)
    return ((word, many, -order, best) for word, (many, order, best) in found.items())


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for k in range(batch.num_rows):
            rows += _found(batch.slice(k, 1).to_pylist()[0])
            if len(rows) >= _BATCH:
                yield _batch(rows, _NEAR)
                rows = []
    if rows:
        yield _batch(rows, _NEAR)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, near_n, near: of words with a near word, how many there are, and the most frequent of them."""
    ways = F.explode(F.array(F.struct(F.lit(False).alias("backward"), F.col("word").alias("spelled")), F.struct(F.lit(True).alias("backward"), F.reverse("word").alias("spelled"))))
    length = F.length("word")
    roles = F.explode(F.array(*[F.struct((length + more).alias("length"), F.lit(asked).alias("asked")) for more, asked in ((0, False), (0, True), (1, True))]))
    rows = words.select("word", "n", ways.alias("way")).select("word", "n", "way.*", roles.alias("role")).select("backward", "role.length", "role.asked", "spelled", "n")
    rows = rows.withColumn("half", F.substring("spelled", F.lit(1), (F.col("length") / 2).cast("int")))
    order = ["backward", "length", "half", "asked", "spelled"]
    blocks = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(block), "backward boolean, length int, half string, asked boolean, shared string, words array<string>, counts array<long>"), "blocks")
    entries = blocks.where("NOT asked").select("backward", "length", "half", "shared", "words", "counts")
    asked = blocks.where("asked").select("backward", "length", "half", F.col("shared").alias("asked_shared"), F.col("words").alias("asked_words"), F.col("counts").alias("asked_counts"))
    # Cut to one length, two prefixes of near words are at most two edits apart.
    most = F.least(F.length("shared"), F.length("asked_shared"))
    like = F.levenshtein(F.substring("shared", F.lit(1), most), F.substring("asked_shared", F.lit(1), most)) <= 2
    pairs = entries.join(asked, ["backward", "length", "half"]).where(like).select("backward", "length", "words", "counts", "asked_words", "asked_counts")
    near = pairs.mapInArrow(_near, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    found = staged(near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.order")).alias("near_n"), "best.near"), "near")
    discard(blocks)
    return found


def grouped(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n, root. A form is at least twice as frequent as its word, so forms lead to an end."""
    words = staged(words, "vocabulary")
    is_form = F.col("near_n") >= 2 * F.col("n")
    rows = words.join(near_words(words, block), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")
    )
    rows = staged(rows, "forms")
    return rows.join(_roots(rows), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(rows: DataFrame) -> DataFrame:
    """word, root of words with a form. Each round doubles the way followed; counts double per step, so there are few rounds."""
    up = staged(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ends = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = staged(up.join(ends, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(up)
        up = longer.drop("moved")
        up.staged_path = longer.staged_path
        if longer.where("moved").isEmpty():
            return up


def oracle_sql(noise: int = 97) -> str:
    """crc32 is computed byte by byte from a table that follows from its polynomial."""
    step = "list_reduce([x] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = "xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295)"
    return rf"""
WITH RECURSIVE tab AS (SELECT list({step} ORDER BY x) AS tab FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS x)),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
d AS (SELECT id, run, count(*) AS n FROM r GROUP BY ALL),
e AS (SELECT *, hex(encode(id || ':' || run)) AS hex FROM d),
b AS (SELECT run, n, [CAST(('0x' || hex[i:i + 1]) AS BIGINT) FOR i IN range(1, length(hex), 2)] AS b FROM e),
h AS (SELECT run, n, {crc} AS h FROM b, tab),
v AS (SELECT CASE WHEN h % {noise} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
g AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS gap FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
    SELECT a.word, b.word AS near FROM g a JOIN g b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word
    UNION SELECT g.word, w.word FROM g JOIN w ON g.gap = w.word
    UNION SELECT w.word, g.word FROM g JOIN w ON g.gap = w.word
),
q AS (SELECT p.word, count(*) AS n_near, min({{'o': -w.n, 'near': near}}) AS best FROM p JOIN w ON w.word = near GROUP BY p.word),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.o >= 2 * n THEN best.near END AS form, CASE WHEN -best.o >= 2 * n THEN -best.o END AS form_n FROM w LEFT JOIN q USING (word)),
way AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL),
last AS (SELECT word, root FROM way WHERE root IN (SELECT word FROM f WHERE form IS NULL))
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN last USING (word)"""
