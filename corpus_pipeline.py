"""The corpus pipeline: toxicity, exact dedup, near-duplicate documents, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. Stages but the last return the
columns of documents. In every stage: a null text counts as empty; rows without an id are judged by their text where a stage
looks at texts alone (toxicity, exact dedup, packing) and otherwise left as they are; texts are read whole, whatever their length;
other columns are carried, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import compact_windows, exact_dedup, packing, prefix_join, toxicity
from ledgerspark.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go. Repeated rows are scored each; a score equal to the threshold goes; without
    labels of both classes all stay."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one row stays: the longest text, then the smallest id. Rows alike in id and text
    are one row's repeats and stay together."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; empty texts, and rows without an id, stay. All rows of an id
    share its fate."""
    found = prefix_join.similar_documents(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(staged(found, "near-copies"), "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds are cut; n_chars follows; a document of which nothing is left goes. Uncut rows, rows
    without an id among them, stay as they are, null texts included; rows that repeat an id are cut each by its own text."""
    rows = compact_windows.without_repeats(docs)
    own = [c for c in docs.columns if c not in ("text", "n_chars")]
    text = F.when(F.col("cut"), F.col("text")).otherwise(F.col("row.text"))
    n_chars = F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    changed = rows.where(~F.col("cut") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return changed.select(*[F.col("row").getField(c).alias(c) for c in own], text.alias("text"), n_chars.alias("n_chars")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence. An empty or null text is its end id alone; repeated rows are packed as often."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
