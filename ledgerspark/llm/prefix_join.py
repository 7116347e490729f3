"""N-gram Jaccard self join of documents by grouped prefixes, and the components of its links.

A document is the set of its distinct 5-word shingles (64-bit hashes). A prefix is the first n - ceil(0.8 n) + L shingles of a set
(``COMMON`` = L; all of a shorter set) in an order that is the same for all: rare shingles first, by a count sketch of fixed
size over all documents, then by hash. Two sets of n and m shingles with Jaccard similarity of at least 0.8 share at least
o = ceil((n + m) 0.8 / 1.8) shingles, and at least o - ceil(0.8 max(n, m)) + L of them lie in both prefixes (``needed``).

1. ``prefixes``, one pass over the texts: documents with equal sets are one node (128-bit hash), named by its smallest
   doc_id; nodes with the same size and the same prefix are one group. Postings (shingle, group) are made once per group.
2. Shingles with one group only are dropped; what is left is written as a table.
3. Star rounds: for every shingle a centre is named, first the group whose set has the most common shingles (of near copies
   that is the original, or close to it), then one by hash. A group is paired with the centre that it shares most
   prefix shingles with, if these are enough; pairs are expanded to nodes and verified. Verified links are merged into
   components, and shingles whose groups are all in one component are dropped. Rows stay in proportion to the postings.
4. Every pair of groups from different components that can still be similar is found by a second prefix filter, now with exact
   counts: for each class of partner sizes a group posts its rarest open shingles, all but as many as every partner of that class must
   share less one. Shared open shingles of a pair are then counted, and enough of them lead to verification. Nothing is left
   out: pairs not looked at lie in one component already, or share too few shingles.

Links are verified by integer arithmetic on whole sets. Nothing is collected but the sketch (fixed size; the more it is filled, the
less rare shingles differ in it, which costs candidates, never links).

Defined results: every row gives a row; rows without an id have no component and no links; null and empty texts have an empty set,
no links, and are their own component; under five words the whole sequence is one shingle; rows that repeat an id are
rows of one document, its links those of any of its texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import slices
from .common import discard, staged
from .components import components
from .shingles import shingle_sequence, shingle_set, split_words, word_hashes

#: Jaccard similarity as a percentage.
PERCENT = 80
#: Slots of the count sketch: its size, and that of the broadcast order (one byte a slot), whatever the input.
SKETCH_BITS = 22
STAR_ROUNDS = 2
#: Shingles that two prefixes must share; every prefix is longer by COMMON - 1 for it.
COMMON = 3
#: Sizes of one class differ by less than this factor.
SIZE_STEP = 1.05
_PART = 1 << 12


def sketch(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """How often a shingle occurs in all documents, by slot, on a logarithmic scale of 8 steps an octave; one byte per slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                found = [shingle_sequence(word_hashes(split_words(t))) for t in texts]
                if found:
                    total += np.bincount((np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        parts = np.minimum(total, 255).astype(np.uint8).reshape(-1, _PART)  # a slot over 255 in one task is frequent anyway
        at = np.flatnonzero(parts.any(axis=1))
        task = TaskContext.get().partitionId() % lanes_of
        for some in np.array_split(at, max(1, len(at) // 64)):
            raw = [parts[i].tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.full(len(some), task), pa.int64()), pa.array(raw, pa.binary())], ["part", "lane", "counts"])

    def add(kind: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(_PART, np.uint32)
            for raw in pdf["counts"]:
                total += np.frombuffer(raw, kind)
            return pd.DataFrame({"part": [pdf["part"].iloc[0]], "lane": [0], "counts": [total.tobytes()]})

        return run

    schema = "part long, lane long, counts binary"
    texts = docs.select("text")
    lanes_of = max(1, math.isqrt(texts.rdd.getNumPartitions()))  # two levels of sums, so that no group has more than the root of all tasks
    lanes = texts.mapInArrow(count, schema)
    summed = lanes.groupBy("part", "lane").applyInPandas(add("u1"), schema).groupBy("part").applyInPandas(add("<u4"), schema)
    total = np.zeros((1 << bits) // _PART * _PART, np.uint32).reshape(-1, _PART)
    for row in summed.select("part", "counts").collect():  # fixed size: one row per part of the sketch
        total[row["part"]] = np.frombuffer(row["counts"], "<u4")
    return np.minimum(8 * np.log2(1.0 + total.reshape(-1)), 255).astype(np.uint8)


def prefix(found: np.ndarray, order: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first n - ceil(n * percent / 100) + COMMON shingles of a set, rare ones first; returned in hash order."""
    n = len(found)
    length = min(n, n - -(-n * percent // 100) + COMMON)
    bits = len(order).bit_length() - 1
    rank = order[(found >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | found >> np.uint64(8)
    return found[np.sort(np.argpartition(rank, length - 1)[:length])]


def _key(*arrays: np.ndarray) -> int:
    h = xxhash.xxh3_64(b"")
    for a in arrays:
        h.update(a.tobytes())
        h.update(len(a).to_bytes(8, "little"))
    return h.intdigest() - (1 << 63)


def prefixes(docs: DataFrame, order) -> DataFrame:
    """doc_id, text_key, n (set size), high and low (128 bits of the set), grp (one per size and prefix), common (how frequent the set's
    shingles are on average), tokens (the prefix; null if the same batch of documents has given this group's prefix already)."""
    names = ["doc_id", "text_key", "n", "high", "low", "grp", "common", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - (len(order.value).bit_length() - 1))
        for batch in batches:
            for part, texts in slices(batch, "text"):
                size, whole, group, common, tokens, given = [], [], [], [], [], set()
                for text, named in zip(texts, part.column("doc_id").is_valid().to_pylist(), strict=True):
                    found = shingle_set(text)
                    size.append(len(found))
                    whole.append(xxhash.xxh3_128_digest(found.tobytes()))
                    if not len(found) or not named:
                        group.append(None), common.append(None), tokens.append(None)
                        continue
                    common.append(int(16 * order.value[(found >> shift).astype(np.int64)].mean()))
                    first = prefix(found, order.value)
                    group.append(_key(first, np.array([len(found)])))
                    tokens.append(first.view(np.int64) if group[-1] not in given else None)
                    given.add(group[-1])
                halves = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
                long = pa.int64()
                columns = [pa.array(x, long) for x in (size, halves[:, 0], halves[:, 1], group, common)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), *columns, pa.array(tokens, pa.list_(long))], names)

    schema = "doc_id long, text_key long, n long, high long, low long, grp long, common long, tokens array<long>"
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, schema)


def _ceil(number: Column, divisor: int) -> Column:
    return F.floor((number + (divisor - 1)) / divisor)


def needed(n: str, m: str, percent: int = PERCENT) -> Column:
    """How many shingles the prefixes of similar sets with n and m shingles share at least."""
    overlap = _ceil((F.col(n) + F.col(m)) * percent, 100 + percent)
    return F.least(overlap, overlap - _ceil(F.greatest(n, m) * percent, 100) + COMMON)


def _sizes_fit(n: str, m: str, percent: int) -> Column:
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.col(n) > 0)


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough; texts: node, text."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last = None, None
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                other = tb.as_py()
                if other != seen:  # mostly sorted by b: the set of a star's centre is made once
                    seen, last = other, shingle_set(other)
                own = shingle_set(ta.as_py())
                shared = len(np.intersect1d(own, last, assume_unique=True))
                keep.append(100 * shared >= percent * (len(own) + len(last) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = docs.sparkSession.sparkContext.broadcast(sketch(docs))
    found = staged(prefixes(docs, order), "prefixes")
    table = found.drop("tokens", "common")
    some = found.where("n > 0 and doc_id is not null")
    sets = some.groupBy("high", "low").agg(*[F.min(c).alias(a) for c, a in (("doc_id", "node"), ("n", "n"), ("grp", "grp"), ("common", "common"))])
    sets = staged(sets, "sets")
    node = F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")
    rows = staged(table.join(sets.select("high", "low", "node"), ["high", "low"], "left").select("doc_id", "text_key", "n", node), "rows")

    listed = some.select(F.explode("tokens").alias("token"), "grp", "n", "common")
    often = listed.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high").select("token")
    shared = staged(listed.join(often, "token").groupBy("token", "grp").agg(F.min("n").alias("n"), F.min("common").alias("common")), "postings")
    discard(found)

    # Texts of nodes that can have links: their group shares enough shingles with others, or has several nodes.
    live = shared.groupBy("grp").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("times")).where(F.col("times") >= F.least(F.lit(COMMON), "n"))
    live = live.select("grp").union(sets.groupBy("grp").count().where("count > 1").select("grp")).distinct()
    wanted = sets.join(live, "grp", "left_semi").select("node").distinct()
    first = rows.where("doc_id = node").join(wanted, "node", "left_semi").select("node", "text_key").distinct()
    texts = docs.select(F.col("doc_id").alias("node"), F.xxhash64("text").alias("text_key"), "text").join(first, ["node", "text_key"])
    texts = staged(texts.dropDuplicates(["node", "text_key"]).select("node", "text"), "texts")

    label = sets.select("node", "grp", "n", F.col("node").alias("component")).distinct()
    # One document's nodes are linked; and the members of one group with its smallest node, if similar.
    low = rows.where("n > 0").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last")
    own = rows.join(low, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")
    least = label.groupBy("grp").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last").select("grp", "b")
    label = _merged(label, own.union(verified(least.join(label, "grp").where("node <> b").select(F.col("node").alias("a"), "b"), texts, percent)))
    for pairs in [*[partial(_stars, turn=turn) for turn in range(star_rounds)], _rest]:
        still_open = _open(shared, label)
        label = _merged(label, verified(pairs(still_open, label, percent=percent), texts, percent))
        discard(still_open)

    of_node = staged(label.select("node", "component").distinct(), "ends")
    for done in (sets, shared, texts):
        discard(done)
    lowest = of_node.groupBy("component").agg(F.min("node").alias("component_id"))
    ends = of_node.join(lowest, "component").select("node", "component_id")
    return rows.join(ends, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id")
    )


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label with the components that the links connect made one."""
    links = staged(links, "verified")
    if links.isEmpty():
        return label
    of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component")).distinct()
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_component").alias("a"), F.col("b_component").alias("b"))
    joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("end"))
    return staged(label.join(joined, "component", "left").select("node", "grp", "n", F.coalesce("end", "component").alias("component")), "labels")


def _open(shared: DataFrame, label: DataFrame) -> DataFrame:
    """token, grp, n, common, first and last (component of the group's nodes) of the shingles whose groups lie in several components."""
    of_group = label.groupBy("grp").agg(F.min("component").alias("first"), F.max("component").alias("last"))
    rows = shared.join(of_group, "grp")
    several = rows.groupBy("token").agg(F.min("first").alias("low"), F.max("last").alias("high")).where("low < high").select("token")
    return staged(rows.join(several, "token"), "open")


def _stars(rows: DataFrame, label: DataFrame, turn: int, percent: int) -> DataFrame:
    """A pair of nodes for each node of a group: with the centre that the group shares most shingles with."""
    rank = F.xxhash64(F.lit(turn), "grp") if turn else F.col("common")
    centre = rows.groupBy("token").agg(F.max(F.struct(rank.alias("rank"), "grp", "n", "first", "last")).alias("c"))
    centre = centre.select("token", F.col("c.grp").alias("centre"), F.col("c.n").alias("m"), F.col("c.first").alias("low"), F.col("c.last").alias("high"))
    apart = (F.col("grp") != F.col("centre")) & ~((F.col("first") == F.col("high")) & (F.col("last") == F.col("low")))
    near = rows.join(centre, "token").where(apart & _sizes_fit("n", "m", percent))
    counted = near.groupBy("grp", "centre", "n", "m").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= needed("n", "m", percent))
    chosen = counted.groupBy("grp").agg(F.max_by("centre", F.struct("times", "centre")).alias("centre"))
    centre_node = label.groupBy("grp").agg(F.min("node").alias("b")).withColumnRenamed("grp", "centre")
    return chosen.join(centre_node, "centre").join(label.select("grp", F.col("node").alias("a")), "grp").select("a", "b")


def _classes(rows: DataFrame, percent: int) -> DataFrame:
    """rows for each class of partner sizes that fit, with own and other (classes) and ``share``, which the prefixes of any such pair share at least."""
    step, reach = math.log(SIZE_STEP), math.ceil(math.log(100 / percent) / math.log(SIZE_STEP))
    own = F.floor(F.log("n") / step + 1e-9).cast("int")
    spread = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.col("own") - reach, F.col("own") + reach)))
    low = F.greatest(F.exp(F.col("other") * step) * (1 - 1e-6), F.col("n") * percent / 100)
    high = F.least(F.exp((F.col("other") + 1) * step) * (1 + 1e-6), F.col("n") * 100 / percent)
    share = lambda m: (F.col("n") + m) * percent / (100 + percent) - F.greatest(F.col("n"), m) * percent / 100 - 1 + COMMON
    least = F.greatest(F.ceil(F.least(share(low), share(high)) - 1e-6), F.lit(1))
    return spread.withColumn("share", least).where(low <= high)


def _rest(rows: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Every pair of nodes of different components whose groups share enough open shingles and whose sizes fit."""
    counted = rows.join(rows.groupBy("token").agg(F.count(F.lit(1)).alias("often")), "token")
    order, group = Window.partitionBy("grp").orderBy("often", "token"), Window.partitionBy("grp")
    ranked = counted.withColumns({"nth": F.row_number().over(order), "of": F.count(F.lit(1)).over(group)})
    posted = _classes(ranked.select("token", "grp", "n", "first", "last", "nth", "of"), percent).where(F.col("nth") <= F.col("of") - F.col("share") + 1)
    posted = posted.withColumns({"small": F.least("own", "other"), "large": F.greatest("own", "other")})
    keys = ["token", "small", "large"]
    posted = staged(posted.select(*keys, "own", "grp", "n", "first", "last", (F.col("of") - F.col("nth") + 1).alias("left")), "posted")
    several = posted.groupBy(*keys).agg(F.min("first").alias("low"), F.max("last").alias("high")).where("low < high").select(*keys)
    posted = staged(posted.join(several, keys), "posted")
    side = lambda c, at: posted.where(F.col("own") == F.col(at)).select(*keys, *[F.col(x).alias(f"{x}_{c}") for x in ("grp", "n", "first", "last", "left")])
    apart = (F.col("grp_a") != F.col("grp_b")) & ((F.col("small") < F.col("large")) | (F.col("grp_a") < F.col("grp_b")))
    apart &= ~((F.col("first_a") == F.col("last_b")) & (F.col("last_a") == F.col("first_b"))) & _sizes_fit("n_a", "n_b", percent)
    apart &= F.least("left_a", "left_b") >= needed("n_a", "n_b", percent)  # holds for the first shingle that a pair shares
    groups = side("a", "small").join(side("b", "large"), keys).where(apart).select("grp_a", "n_a", "grp_b", "n_b").distinct()
    groups = staged(groups, "pairs")
    held = rows.groupBy("grp").agg(F.collect_list("token").alias("tokens"))  # at most one document's prefix
    of = lambda c: held.select(F.col("grp").alias(f"grp_{c}"), F.col("tokens").alias(f"tokens_{c}"))
    both = groups.join(of("a"), "grp_a").join(of("b"), "grp_b").where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= needed("n_a", "n_b", percent))
    node = lambda c: label.select(F.col("grp").alias(f"grp_{c}"), F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    across = both.select("grp_a", "grp_b").join(node("a"), "grp_a").join(node("b"), "grp_b").where("of_a <> of_b").select("a", "b")
    within = label.join(label.select("grp", F.col("node").alias("b"), F.col("component").alias("of_b")), "grp")
    within = within.where("component < of_b").select(F.col("node").alias("a"), "b")
    return across.union(within).distinct()
