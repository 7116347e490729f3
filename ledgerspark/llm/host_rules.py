"""Quality rules judged by host: rule failures aggregated per host, shrunk by an empirical beta prior, joined back to documents.

1. ``measures``: one row per document with its counts; whole texts go to Python once, in Arrow batches, and only numbers come back.
2. ``host_rates``: documents and failures per host, combined in the map tasks, so a host may hold any share of the rows. The prior
   is the beta distribution whose mean and spread the hosts' own counts show (moments, weighted by documents); a host's
   rate is its posterior mean, so that a host of few documents is judged mostly by what is usual.
3. ``judged``: the verdict on a host joined back by its name. The host side has one row per host; the document side has small rows,
   and adaptive execution splits a hot host.

Defined results: a null text counts as no text and fails (it has fewer than ten words), as does an empty one; a null host is no
host: such documents are judged alone and take no part in rates; rows that repeat an id are judged, and counted at their host, each;
texts of any length are measured whole; an empty table gives an empty one; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Rules on one document.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A host whose shrunk failure rate is above this is rejected with all its documents.
MOST_FAILING = 0.5
#: Bounds of the correlation of documents of one host, from which the prior's weight (1 / rho - 1 documents) follows.
RHO = (0.001, 0.5)

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_SPACE = b" \t\n\x0b\x0c\r"
MEASURES = "id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that are found at least twice, first ones included; exact."""
    if len(words) < WINDOW + 1:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    runs = ids
    for have in range(1, WINDOW):  # the number of a run of have words, and of the word after it, give that of the longer run
        pairs = runs[:-1] * len(number) + ids[have:]
        runs = np.unique(pairs, return_inverse=True)[1]
    starts = np.flatnonzero(np.bincount(runs)[runs] > 1)
    if not len(starts):
        return 0
    steps = np.zeros(len(words) + 1, np.int64)
    steps[starts] += 1  # starts differ
    steps[starts + WINDOW] -= 1
    return int((np.cumsum(steps[:-1]) > 0).sum())


def text_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at ASCII white space alone
    bare = raw.translate(None, _SPACE)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(bare.decode("utf-8", "surrogatepass")), len(_SYMBOLS.findall(raw)), len(lines) - len(set(lines)), repeated_words(words)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_measures(x.as_py()) for x in batch.column("text")]
        counts = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), *(pa.array(list(c), pa.int64()) for c in counts)], names=[x.split()[0] for x in MEASURES.split(", ")])


def measures(docs: DataFrame, host: Column | str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, the five counts and base_failed, one row per row of docs."""
    name = F.col(host) if isinstance(host, str) else host
    rows = docs.select(F.col(id_col).cast("long").alias("id"), name.cast("string").alias("host"), F.col(text_col).alias("text")).mapInArrow(_measured, MEASURES)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumnRenamed("id", "doc_id").withColumn("base_failed", failed)


def host_rates(measured: DataFrame, flag: str = "base_failed") -> DataFrame:
    """host, documents, failures, rate: the posterior mean of the host's failure rate."""
    hosts = measured.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col(flag).cast("long")).alias("failures"))
    n, k = F.col("documents").cast("double"), F.col("failures").cast("double")
    all_hosts = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(k * k / n).alias("kk"), F.sum(n * n).alias("nn"))
    mean = F.col("k") / F.col("n")
    spread = (F.col("kk") - F.col("n") * mean * mean) / (mean * (1 - mean))
    free = F.col("h") - 1
    room = F.col("n") - F.col("nn") / F.col("n") - free
    rho = F.when((mean > 0) & (mean < 1) & (room > 0), F.least(F.greatest((spread - free) / F.nullif(room, F.lit(0.0)), F.lit(RHO[0])), F.lit(RHO[1]))).otherwise(RHO[0])
    prior = all_hosts.where("n > 0").select(mean.alias("mean"), (1 / rho - 1).alias("weight"))
    rate = (k + F.col("mean") * F.col("weight")) / (n + F.col("weight"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "documents", "failures", rate.alias("rate"))  # one row


def judged(docs: DataFrame, host: Column | str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measures, with rate (null without a host) and kept: false if the document or its host failed."""
    measured = staged(measures(docs, host, id_col, text_col), "measures")
    rates = staged(host_rates(measured), "hosts")
    both = measured.join(rates.select("host", "rate"), "host", "left")
    return both.withColumn("kept", ~F.col("base_failed") & (F.coalesce("rate", F.lit(0.0)) <= MOST_FAILING))


def oracle_sql(host: str = "source") -> str:
    low, high = RHO
    return rf"""
WITH t AS (SELECT row_number() OVER () AS i, doc_id, {host} AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
win AS (SELECT i, unnest(range(1, len(w) - 3)) AS pos, unnest([w[x:x + 4] FOR x IN range(1, len(w) - 3)]) AS five FROM w),
rep AS (SELECT i, unnest(pos) AS pos FROM (SELECT i, list(pos) AS pos FROM win GROUP BY i, five HAVING count(*) > 1)),
cov AS (SELECT i, count(DISTINCT p) AS n FROM (SELECT i, unnest(range(pos, pos + 5)) AS p FROM rep) GROUP BY i),
lin AS (SELECT i, count(*) - count(DISTINCT line) AS n FROM (SELECT i, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY i),
m AS (SELECT i, doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(lin.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN lin USING (i) LEFT JOIN cov USING (i)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS k FROM f WHERE host IS NOT NULL GROUP BY host),
a AS (SELECT count(*) - 1 AS free, sum(n) AS n, sum(k) / sum(n) AS mean, sum(k * k / n) AS kk, sum(n * n) AS nn FROM h),
p AS (SELECT mean, CASE WHEN mean > 0 AND mean < 1 AND n - nn / n - free > 0 THEN least(greatest(((kk - n * mean * mean) / (mean * (1 - mean)) - free) / nullif(n - nn / n - free, 0), {low}), {high}) ELSE {low} END AS rho FROM a),
r AS (SELECT host, (k + mean * (1 / rho - 1)) / (n + 1 / rho - 1) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate, 0) <= {MOST_FAILING} AS kept
FROM f LEFT JOIN r USING (host)"""
