"""Toxicity by class-conditional Kneser-Ney language models.

Model: words, order 2, one model for toxic and one for ordinary text:

    P_c(w | v) = max(n_c(vw) - D, 0) / n_c(v) + b_c(v) P_c(w)        bigrams of class c
    P_c(w)     = max(N_c(w) - D, 0) / N_c     + b_c P(w)             N_c(w): distinct words before w in class c
    P(w)       = (N(w) + 1) / (N + V)                                counts of all documents, labelled or not

Each class backs off to its own continuation counts and those to the counts of the whole corpus, which both classes share,
so an expression that is rare everywhere gets nearly the same likelihood from both. Discounts follow the numbers of n-grams seen once
and twice. A text is compared by the difference of its log-likelihoods per word: over the whole text, and, by the
continuation models alone (which copies of a passage don't sway), over its best window of ``WINDOW`` words and its ``TOP``
most telling distinct words. A logistic regression turns these three into a score in 0..1.

Training rows are those whose crc32(doc_id as text) mod 3 is not ``HELD_OUT``, at most ``TRAIN_ROWS`` of them in hash order (a
bounded sample, so that it can be broadcast to the documents and no text is shuffled). The regression is fitted on those of
remainder 2, compared by models of remainder 0 that have not seen them; the models used for scoring are then counted
over all training rows. Shared counts cover all documents and are summed by Spark. The model that is broadcast holds every
word and context of the training rows and the bigrams that a class has ``LEAST`` times, so the sample bounds it; nothing else is cut.
Words are hashed to 32 bits.

Defined results: null and empty texts get the score of a text without evidence; without rows of both classes in
remainder 0 (and in 2) every score is 0.0; conflicting labels of one id count as toxic; repeated rows are scored each; other columns are
never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import slices, with_field
from .caches import worker_cache
from .common import discard, staged

HELD_OUT = 1
THRESHOLD = 0.7
TRAIN_ROWS = 40_000
#: A class has an opinion of words that it saw after so many different words, and of bigrams that it saw so often; of others it only
#: has the shared counts. The same for both classes.
LEAST = 2
WINDOW = 16
#: Distinct words in the last feature.
TOP = 2
CACHE_ENTRIES = 200_000
_WORD = re.compile(r"\w+")


def fold(id_column: str | Column) -> Column:
    return F.crc32(F.col(id_column).cast("string") if isinstance(id_column, str) else id_column.cast("string")) % 3


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value


def word_hashes(text: str | None) -> np.ndarray:
    found = _WORD.findall((text or "").lower())
    return np.fromiter(map(worker_cache("toxicity", "words", _Hashes).__getitem__, found), np.uint32, len(found))


def bigram_keys(words: np.ndarray) -> np.ndarray:
    """word << 32 | word before it; the first word has no bigram."""
    return (words[1:].astype(np.int64) << 32) | words[:-1].astype(np.int64)


def bigram_counts(rows: DataFrame) -> DataFrame:
    """key, toxic, ordinary: occurrences of each bigram in texts of either label (columns text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                label = part.column("toxic").to_pylist()
                keys = [bigram_keys(word_hashes(t)) for t in texts]
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                toxic = np.repeat(np.array(label, np.int64), [len(k) for k in keys])
                key, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
                bad = np.bincount(inverse, weights=toxic, minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(bad), pa.array(n - bad)], ["key", "toxic", "ordinary"])

    counted = rows.select("text", "toxic").mapInArrow(count, "key long, toxic long, ordinary long")
    return counted.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _discount(once: float, twice: float) -> float:
    """The usual estimate, kept inside 0.1 .. 0.95."""
    return float(min(max(once / (once + 2 * twice), 0.1), 0.95)) if once + twice else 0.5


class Model:
    """Log-likelihood ratios: of words (backed off), of contexts (ratio of backoff weights), and of bigrams.

    telling: the words that toxic texts hold after at least LEAST different words, with the same ratios; all others count
    there by the mass that the classes leave to them together (``others``).
    """

    def __init__(self, words, contexts, bigrams, default: float, telling, others: float, weights=None) -> None:
        self.words, self.contexts, self.bigrams, self.telling = (self._sorted(*x) for x in (words, contexts, bigrams, telling))
        self.default, self.others, self.weights = default, others, weights

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        return keys[order], values[order].astype(np.float32)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: np.ndarray | float) -> np.ndarray:
        known, values = table
        if not len(known):
            return np.full(len(keys), default, np.float64) if np.isscalar(default) else default
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], default)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """One row per text: log P_toxic - log P_ordinary per word of the text, of its best window, of its most telling words."""
        words = [word_hashes(t) for t in texts]
        out = np.zeros((len(texts), 3))
        end = np.cumsum([len(w) for w in words])
        if not len(end) or not end[-1]:
            return out
        flat = np.concatenate(words)
        ratio = self._find(self.words, flat.astype(np.int64), self.default)
        alone = self._find(self.telling, flat.astype(np.int64), self.others)
        single = ratio.copy()
        backed = ratio[1:] + self._find(self.contexts, flat[:-1].astype(np.int64), 0.0)
        ratio[1:] = self._find(self.bigrams, bigram_keys(flat), backed)
        total = np.concatenate([[0.0], np.cumsum(alone)])
        for i, w in enumerate(words):
            n = len(w)
            if not n:
                continue
            stop, start = int(end[i]), int(end[i]) - n
            ratio[start] = single[start]  # no word before it
            width = min(WINDOW, n)
            window = (total[start + width : stop + 1] - total[start : stop - width + 1]).max() / WINDOW
            own, top = alone[start:stop], 0.0
            left = np.ones(n, bool)
            for _ in range(TOP):
                at = int(np.argmax(np.where(left, own, -np.inf)))
                if not left[at]:
                    break
                top += own[at]
                left &= w != w[at]
            out[i] = ratio[start:stop].sum() / n, window, top / TOP
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        mean, deviation, weight, bias = self.weights
        z = ((self.features(texts) - mean) / deviation) @ weight + bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: occurrences over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text"):
                word, n = np.unique(np.concatenate([word_hashes(t) for t in texts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic, fold of at most ``most`` labelled rows that are not held out."""
    marked = labels.select("doc_id", F.col("toxic").cast("long").alias("toxic")).where("doc_id is not null and toxic is not null")
    marked = marked.where(fold("doc_id") != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.withColumn("order", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    share = min(1.0, 1.05 * most / max(1, marked.count()))
    sample = marked.where(F.col("order") < int(share * (1 << 40))).orderBy("order", "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id").select("text", "toxic", fold("doc_id").alias("fold"))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Held-out rows are never read for labels."""
    rows = staged(training_rows(docs, labels, train_rows), "training")  # bounded; read several times
    corpus = staged(word_counts(docs), "words")
    half = language_models(rows.where("fold = 0"), corpus)
    if half is None:
        return Model(*[(np.zeros(0, np.int64), np.zeros(0))] * 3, 0.0, (np.zeros(0, np.int64), np.zeros(0)), 0.0)
    model = language_models(rows, corpus)
    shared = docs.sparkSession.sparkContext.broadcast(half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                found = shared.value.features(texts)
                yield pa.RecordBatch.from_arrays([*[pa.array(found[:, i]) for i in range(3)], part.column("toxic")], ["a", "b", "c", "toxic"])

    fitted = rows.where("fold <> 0").select("text", "toxic").mapInArrow(run, "a double, b double, c double, toxic long")
    model.weights = logistic(fitted.toPandas())  # at most train_rows rows of four numbers
    for done in (rows, corpus):
        discard(done)
    return model


def language_models(rows: DataFrame, corpus: DataFrame) -> Model | None:
    """Both models' ratios from text and toxic, and the corpus' word counts; None without words of both classes.

    All n-grams of the training rows are counted and smoothed on Spark; what is collected, a key and a ratio for each word and context
    and for each bigram that one class has ``LEAST`` times, is bounded by the training rows.
    """
    counts = staged(bigram_counts(rows.select("text", "toxic")), "bigrams")
    word, before = F.shiftright("key", 32).bitwiseAND(F.lit(0xFFFFFFFF)), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    several = lambda c: F.sum((F.col(c) > 0).cast("long"))
    words = staged(counts.groupBy(word.alias("word")).agg(several("toxic").alias("t"), several("ordinary").alias("o")), "word-counts")
    marks = lambda df, columns: df.agg(*[F.sum(c).alias(c) for c in columns], *[F.sum((F.col(c) == n).cast("long")).alias(f"{c}{n}") for c in columns for n in (1, 2)]).first()
    w, g = marks(words, ("t", "o")), marks(counts, ("toxic", "ordinary"))  # one row each
    if not w["t"] or not w["o"]:
        return None
    d_word = [_discount(w[f"{c}1"], w[f"{c}2"]) for c in ("t", "o")]
    d_pair = [_discount(g[f"{c}1"], g[f"{c}2"]) for c in ("toxic", "ordinary")]

    # Words: discounted continuation counts, and the shared counts of all documents by what the discounts leave.
    everything = corpus.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    direct = lambda c, d, total: F.greatest(F.col(c) - d, F.lit(0.0)) / total
    rest = words.agg(*[F.sum(direct(c, d_word[i], w[c])).alias(c) for i, c in enumerate(("t", "o"))]).first()
    spare = [max(1 - rest[c], 1e-9) for c in ("t", "o")]
    common = (F.coalesce("n", F.lit(0)) + 1) / float(everything["n"] + everything["v"])
    p = [direct(c, d_word[i], w[c]) + spare[i] * common for i, c in enumerate(("t", "o"))]
    smooth = staged(words.join(corpus, "word", "left").select("word", "t", p[0].alias("p_t"), p[1].alias("p_o")), "smoothed")

    # Contexts: what the listed bigrams of a context leave; bigrams that both classes have less than LEAST times back off.
    listed = (F.col("toxic") >= LEAST) | (F.col("ordinary") >= LEAST)
    kept = lambda c, d: F.sum(F.when(listed, F.greatest(F.col(c) - d, F.lit(0.0))).otherwise(0.0))
    contexts = counts.groupBy(before.alias("context")).agg(
        F.sum("toxic").alias("n_t"), F.sum("ordinary").alias("n_o"), kept("toxic", d_pair[0]).alias("k_t"), kept("ordinary", d_pair[1]).alias("k_o")
    )
    back = lambda n, k: F.when(F.col(n) > 0, F.greatest(1 - F.col(k) / F.col(n), F.lit(1e-3))).otherwise(1.0)
    contexts = staged(contexts.select("context", "n_t", "n_o", back("n_t", "k_t").alias("b_t"), back("n_o", "k_o").alias("b_o")), "contexts")
    pairs = counts.where(listed).select(word.alias("word"), before.alias("context"), "key", "toxic", "ordinary").join(smooth, "word").join(contexts, "context")
    of = lambda c, d, n, b, q: F.greatest(F.col(c) - d, F.lit(0.0)) / F.greatest(F.col(n), F.lit(1)) + F.col(b) * F.col(q)
    ratio = F.log(of("toxic", d_pair[0], "n_t", "b_t", "p_t")) - F.log(of("ordinary", d_pair[1], "n_o", "b_o", "p_o"))

    def collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        table = df.toArrow()
        return table.column(0).to_numpy(), table.column(1).to_numpy()

    float_ratio = lambda x: x.cast("float").alias("ratio")
    telling = smooth.where(F.col("t") >= LEAST)
    told = telling.agg(F.sum("p_t").alias("t"), F.sum("p_o").alias("o")).first()
    others = [max(1 - (told[c] or 0.0), 1e-9) for c in ("t", "o")]
    model = Model(
        collected(smooth.select("word", float_ratio(F.log("p_t") - F.log("p_o")))),
        collected(contexts.where("b_t <> b_o").select("context", float_ratio(F.log("b_t") - F.log("b_o")))),
        collected(pairs.select("key", float_ratio(ratio))),
        float(np.log(spare[0]) - np.log(spare[1])),
        collected(telling.select("word", float_ratio(F.log("p_t") - F.log("p_o")))),
        float(np.log(others[0]) - np.log(others[1])),
    )
    for done in (counts, words, smooth, contexts):
        discard(done)
    return model


def logistic(rows, steps: int = 50, ridge: float = 1e-2):
    """Weights of a ridge-penalised logistic regression by Newton steps; None if a class is missing."""
    x, y = rows[["a", "b", "c"]].to_numpy(), rows["toxic"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
    weight = np.zeros(4)
    penalty = np.diag([ridge * len(y)] * 3 + [1e-6]) * 0.01
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ weight, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + penalty
        step = np.linalg.solve(hessian, z.T @ (y - p) - penalty @ weight)
        weight += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return mean, deviation, weight[:3], weight[3]


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (the input as a struct) and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = source.select("row", F.lit(0.0).alias("score")).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(with_field(batch, "row", at, "text"), "text"):
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(shared.value.scores(texts))], ["row", "score"])

    return source.mapInArrow(run, schema)
