"""Models on feature rows: vectors, boosted trees, calibration, isolation forest, embeddings, explanations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import forget, written
from .graph import undirected
from .metrics import ranking_metrics


def feature_vector(df: DataFrame, names: list[str], output: str = "features") -> DataFrame:
    """Nulls become 0; a missing column is 0 everywhere."""
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in names})
    return VectorAssembler(inputCols=names, outputCol=output).transform(df)


def train_classifier(df: DataFrame, label: str, trees: int = 10, depth: int = 4) -> GBTClassificationModel:
    """Boosted trees; positives weigh as much as negatives together. df has features, label and valid (bool)."""
    n = df.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()  # two rows
    count = {r["y"]: r["n"] for r in n}
    weight = F.when(F.col(label) == 1, count.get(0, 1) / max(count.get(1, 1), 1)).otherwise(1.0)
    gbt = GBTClassifier(labelCol=label, weightCol="weight", validationIndicatorCol="valid", maxIter=trees, maxDepth=depth, seed=7)
    return gbt.fit(df.withColumn("weight", weight).withColumn(label, F.col(label).cast("double")))


def predict(model: GBTClassificationModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("probability", vector_to_array("probability")[1]).drop("rawPrediction", "prediction")


def calibrated(scored: DataFrame, score: str, label: str) -> DataFrame:
    """A one-feature logistic regression on the score."""
    df = VectorAssembler(inputCols=[score], outputCol="one").transform(scored)
    model = LogisticRegression(featuresCol="one", labelCol=label, regParam=0.01, probabilityCol="p", rawPredictionCol="r", predictionCol="q").fit(df)
    return model.transform(df).withColumn("calibrated", vector_to_array("p")[1]).drop("one", "p", "r", "q")


def importance(model: GBTClassificationModel, names: list[str], df: DataFrame) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def explain_rows(model: GBTClassificationModel, df: DataFrame, key: str, names: list[str], k: int = 5) -> DataFrame:
    """The k features whose replacement by their mean changes a row's probability most."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    means = df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}__mean") for c in names])  # one row
    scored = df.select(key, *[value(c).alias(c) for c in names]).join(F.broadcast(means))
    # A row keeps all its probabilities: nothing is exploded, joined back or sorted, so a task needs memory for a batch of rows only.
    for i, changed in enumerate([None, *names]):
        vector = VectorAssembler(inputCols=[f"{c}__mean" if c == changed else c for c in names], outputCol="_v")
        model_i = model.copy().setFeaturesCol("_v").setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("")
        scored = model_i.transform(vector.transform(scored)).withColumn(f"_p{i}", vector_to_array("_p")[1]).drop("_v", "_p")
    impact = [F.struct((-F.abs(F.col("_p0") - F.col(f"_p{i}"))).alias("least"), F.lit(c).alias("feature"), (F.col("_p0") - F.col(f"_p{i}")).alias("impact")) for i, c in enumerate(names, 1)]
    largest = F.slice(F.array_sort(F.array(*impact)), 1, k)
    return scored.select(key, F.posexplode(largest).alias("place", "r")).select(key, "r.feature", "r.impact", (F.col("place") + 1).alias("place"))


# Isolation forest: each tree is grown from a hashed sample of at most ``SAMPLE`` rows; trees are a small table.
TREES, SAMPLE = 300, 256
_HASHES = 1 << 30


def _point(names: list[str]) -> Column:
    """The features as an array; null, NaN and infinite values count as 0."""
    return F.array(*[F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(0.0) for c in names])


def isolation_forest(df: DataFrame, key: str, names: list[str], trees: int = TREES, sample: int = SAMPLE) -> list[np.ndarray]:
    """Trees as arrays of (feature, threshold, left, right, size); bounded by trees x sample, so they may be broadcast."""
    rows = df.select(F.col(key).alias("k"), _point(names).alias("x"))
    share = min(1.0, 4 * sample / max(df.count(), 1))  # a hash cut first, then the smallest hashes
    # One hash of a row serves as many trees as shares fit into its range: on a large table a row is given to one tree at most.
    width = max(1, int(share * _HASHES))
    served = _HASHES // width
    numbered = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(-(-trees // served) - 1))))
    dealt = numbered.withColumn("h", F.pmod(F.xxhash64("k", "turn"), F.lit(_HASHES))).withColumn("slot", F.floor(F.col("h") / width))
    dealt = dealt.withColumn("tree", (F.col("turn") * served + F.col("slot")).cast("int")).where((F.col("slot") < served) & (F.col("tree") < trees))
    place = Window.partitionBy("tree").orderBy("h", "k")
    picked = dealt.withColumn("i", F.row_number().over(place)).where(F.col("i") <= sample).select("x", "tree", "k")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_numpy())
        random = np.random.default_rng(int(pdf["tree"].iloc[0]))
        nodes: list[list[float]] = []

        def node(at: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([-1.0, 0.0, -1.0, -1.0, float(len(at))])
            low, high = x[at].min(axis=0), x[at].max(axis=0)
            free = np.flatnonzero(high > low)
            if len(at) > 1 and depth < _DEPTH and len(free):
                f = int(random.choice(free))
                cut = random.uniform(low[f], high[f])
                below = x[at, f] <= cut
                nodes[me][:4] = [float(f), float(cut), float(node(at[below], depth + 1)), float(node(at[~below], depth + 1))]
            return me

        node(np.arange(len(x)), 0)
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "nodes": [[v for n in nodes for v in n]]})

    grown = picked.groupBy("tree").applyInPandas(grow, "tree int, nodes array<double>").collect()  # at most trees rows
    return [np.array(r["nodes"]).reshape(-1, 5) for r in sorted(grown, key=lambda r: r["tree"])]


def _usual_depth(n: np.ndarray) -> np.ndarray:
    n = np.maximum(n, 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


#: Levels below a tree's root.
_DEPTH = 8


def _laid_out(tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """feature, threshold and path length by place in a full tree (children of i: 2i+1, 2i+2), so that a step needs no look at children;
    below a leaf every step goes to the left, and the path length of its leftmost place is the leaf's."""
    size = 2 ** (_DEPTH + 1) - 1
    feature, threshold, length = np.zeros(size, np.intp), np.full(size, np.inf), np.zeros(size)
    todo = [(0, 0, 0)]
    while todo:
        node, place, depth = todo.pop()
        f, cut, left, right, n = tree[node]
        if f >= 0:
            feature[place], threshold[place] = int(f), cut
            todo += [(int(left), 2 * place + 1, depth + 1), (int(right), 2 * place + 2, depth + 1)]
        else:
            lowest = (place + 1) * 2 ** (_DEPTH - depth) - 1
            length[lowest] = depth + float(_usual_depth(np.array([n]))[0])
    return feature, threshold, length


def isolation_scores(df: DataFrame, forest: list[np.ndarray], names: list[str], sample: int = SAMPLE) -> DataFrame:
    """Adds anomaly in 0..1 by mean path length."""
    shared = df.sparkSession.sparkContext.broadcast([_laid_out(tree) for tree in forest])
    usual = float(_usual_depth(np.array([float(sample)]))[0])
    source = df.withColumn("x", _point(names))
    block = 4096  # rows whose features and places stay in a core's cache over all trees

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        depth = np.zeros(len(x))
        for begin in range(0, len(x), block):
            rows = np.stack(x.iloc[begin : begin + block].to_numpy())
            flat, base = rows.reshape(-1), np.arange(len(rows), dtype=np.intp) * rows.shape[1]
            total = np.zeros(len(rows))
            for feature, threshold, length in shared.value:
                at = np.zeros(len(rows), np.intp)
                for _ in range(_DEPTH):
                    above = flat.take(base + feature.take(at)) > threshold.take(at)
                    at += at
                    at += 1
                    at += above
                total += length.take(at)
            depth[begin : begin + block] = total
        return pd.Series(2.0 ** (-depth / max(len(shared.value), 1) / usual))

    return source.withColumn("anomaly", score("x")).drop("x")


def node_embeddings(pairs: DataFrame, size: int = 64, weights: tuple[float, ...] = (0.3, 1.0, 1.0)) -> DataFrame:
    """node, embedding: random signs of each node, averaged over neighbours again and again, and the averages added up by weight.

    Nodes with like neighbourhoods get like vectors (a random projection of the powers of the transition matrix). Signs come from a hash,
    so nothing is stored for them and results repeat exactly; an average is combined in the map tasks, whatever a node's degree.
    """
    both = written(undirected(pairs), "both")
    signs = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.pmod(F.xxhash64("node", i), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    now = written(ends.select("node", signs.alias("v"), F.array_repeat(F.lit(0.0), size).alias("embedding")), "embedding")
    for weight in weights:
        means = both.join(now.select(F.col("node").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("node")).agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(size)])
        mean = unit(F.array(*[F.coalesce(f"m{i}", F.lit(0.0)) for i in range(size)]))  # nodes without neighbours keep zeros
        step = now.select("node", "embedding").join(means, "node", "left").select("node", "embedding", mean.alias("v"))
        new = written(step.select("node", "v", F.zip_with("embedding", "v", lambda a, b: a + weight * b).alias("embedding")), "embedding")
        forget(now)
        now = new
    return now.select("node", unit(F.col("embedding")).alias("embedding"))


def unit(v: Column) -> Column:
    """A vector of length one; zeros stay."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(0.0))


def link_auc(embeddings: DataFrame, links: DataFrame, others: DataFrame) -> float:
    """How often a link's ends are more alike than those of another pair (ties count half); links and others: src, dst."""
    pairs = links.select("src", "dst", F.lit(1).alias("label")).unionByName(others.select("src", "dst", F.lit(0).alias("label")))
    for end in ("src", "dst"):
        pairs = pairs.join(embeddings.select(F.col("node").alias(end), F.col("embedding").alias(f"{end}_v")), end)
    alike = F.aggregate(F.zip_with("src_v", "dst_v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return ranking_metrics(pairs.select(F.round(alike, 9).alias("score"), "label"), "score", "label").first()["roc_auc"]
