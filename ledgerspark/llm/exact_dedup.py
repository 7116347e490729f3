"""Exact deduplication by 128-bit content hash, with bytes compared inside each hash group.

Native DataFrame code only. Two passes over the input:

1. ``classes``: group by (content hash, normalised text). Spark's hash aggregate finds the group by hash and then
   compares the whole key bytes, so two texts that collide in the hash stay apart. Map tasks combine copies before
   the shuffle: a text with a billion copies sends one row per map task.
2. every row is joined to its class by (content hash, SHA-256). Those keys are small (no text is shuffled here) and a
   hot class is one row on the other side, so adaptive execution can split a hot key at will.

Defined results: a null text counts as empty; null ids sort after all others; rows that repeat both the id and the
text are one document and share the decision; an empty table gives an empty result; extra columns, whatever
their names, are carried through by ``deduplicated`` and ignored by ``exact_duplicates``.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, text_or_empty

_LAST_ID = 2**63 - 1
_STEP = Decimal(2**64)


def strip_space(text: Column) -> Column:
    """The text without any of ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_replace(text, f"{ASCII_SPACE}+", "")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = strip_space,
    content_hash: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per input row: row (the input as a struct), keep_id, group_size, kept, text_sha256.

    The row kept of a group has the most code points in its original text, then the smallest id. ``content_hash`` may
    be any function of the normalised text: collisions are resolved by bytes, never merged.
    """
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = text_or_empty(F.col("row").getField(text_col))
    rows = source.select(
        "row",
        F.col("row").getField(id_col).cast("long").alias("id"),
        F.length(text).alias("points"),
        normalise(text).alias("norm"),
    ).withColumn("content_hash", content_hash(F.col("norm")))

    # (points, -id) as one fixed-width number, so that the aggregate on text keys stays a hash aggregate.
    order = F.col("points").cast("decimal(38,0)") * F.lit(_STEP) - F.coalesce("id", F.lit(_LAST_ID))
    keep = F.col("most").cast("decimal(38,0)") * F.lit(_STEP) - F.col("best")
    classes = (
        rows.groupBy("content_hash", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("points").alias("most"), F.max(order).alias("best"))
        .select(
            "content_hash",
            F.sha2("norm", 256).alias("text_sha256"),
            "group_size",
            "most",
            F.nullif(keep.cast("long"), F.lit(_LAST_ID)).alias("keep_id"),
        )
    )
    return (
        rows.select("row", "id", "points", "content_hash", F.sha2("norm", 256).alias("text_sha256"))
        .join(classes, ["content_hash", "text_sha256"])
        .select(
            "row",
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))).alias("kept"),
            "text_sha256",
        )
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of docs, with the columns of docs."""
    return exact_duplicates(docs, id_col, text_col).where("kept").select("row.*")
