"""Two-pass external shuffle into shards. Native DataFrame code only.

Pass 1 scatters records into memory-sized buckets by a seeded hash of id and text. Pass 2 loads one bucket at a time,
puts it in a fixed order and applies Spark's seeded ``shuffle`` (a Fisher-Yates shuffle of one array) to it. A record's
global position is its bucket's offset plus its place in the shuffled bucket; position modulo the shard count gives the
shard, the quotient the slot. So shard sizes differ by one row at most (law ``rows``) and slots have no gaps.

The number of buckets follows from the exact total of bytes. Only the table of bucket sizes (one small row per bucket)
is joined to the data. Each bucket goes to the partition named by its hash and partitions are put in bucket order
before they are shuffled, so a task that runs again after a lost executor gives the same permutation.

Defined results: a null text has size 1 (no bytes, plus 1) and is scattered by its id; rows that are alike in id and
text are interchangeable and fall into the same bucket; an empty table gives an empty result; all columns
(whatever their names) are carried in the struct ``row`` and must be orderable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

LAW = "rows"
#: A partition holds one bucket, or a few one after the other when there are more buckets than this.
MOST_PARTITIONS = 50_000


def record_size(text: Column) -> Column:
    """UTF-8 bytes plus 1."""
    return (F.octet_length(text) + 1).cast("long")


def external_shuffle(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 20240607,
    bucket_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows of docs in random order: row (the input as a struct), bucket, shard, slot.

    Buckets hold about ``bucket_bytes`` of text; there are at least four per shard, so small inputs use all cores.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = text_or_empty(F.col("row").getField(text_col))
    rows = rows.select(
        "row", F.xxhash64(F.lit(seed), F.col("row").getField(id_col), text).alias("h"), record_size(text).alias("size")
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    buckets = max(-(-total // bucket_bytes), 4 * shards)
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("long"))

    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    loaded = (
        rows.select("bucket", F.struct("h", "row").alias("record"))
        .repartition(min(buckets, MOST_PARTITIONS), "bucket")
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list("record")).alias("records"))
        .sortWithinPartitions("bucket")
    )
    shuffled = loaded.select("bucket", F.shuffle("records", seed).alias("records")).select(
        "bucket", F.posexplode("records").alias("place", "record")
    )
    position = F.col("first") + F.col("place")
    return shuffled.join(offsets, "bucket").select(
        F.col("record.row").alias("row"),
        "bucket",
        F.pmod(position, F.lit(shards)).cast("int").alias("shard"),
        ((position - F.pmod(position, F.lit(shards))) / shards).cast("long").alias("slot"),
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write the shards as parquet folders ``shard=N``, each file in slot order.

    Columns of the input that are named shard or slot are written with ``_in`` added to their names.
    """
    fields = shuffled.schema["row"].dataType.names
    names = [f"{c}_in" if c.lower() in ("shard", "slot") else c for c in fields]
    spread = shuffled.select(*[F.col("row").getField(c).alias(n) for c, n in zip(fields, names, strict=True)], "shard", "slot")
    spread.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
