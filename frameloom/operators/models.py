"""Models per key, trained in groups: logistic regression and random forests."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.runtime import task_count

#: Models are fitted on at most so many rows of each key and class, drawn by a hash.
MOST_ROWS = 5000


def bounded(df: DataFrame, key: str, target: str, record: str, most: int = MOST_ROWS) -> DataFrame:
    """At most ``most`` labelled rows per key and class. The rank limit is pushed below the shuffle, so a hot key stays cheap."""
    order = Window.partitionBy(key, target).orderBy(F.xxhash64(record), record)
    return df.where(F.col(target).isNotNull()).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most).drop("__r")


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the intercept last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (p - y) / len(y) + ridge * w)
    return w


def logistic_models(df: DataFrame, key: str, features: str, target: str, record: str, least: int = 301) -> DataFrame:
    """(key, weights): one logistic model per key with at least ``least`` rows and both classes (O-135)."""
    kind = df.schema[key].dataType.simpleString()

    def fit(table: pa.Table) -> pa.Table:
        y = table["y"].to_numpy().astype(float)
        known = len(y) >= least and y.min() != y.max()
        weights = [fit_logistic(np.array(table["x"].to_pylist(), float), y).tolist()] if known else []
        return pa.table({"key": table["key"].combine_chunks()[: int(known)], "weights": pa.array(weights, pa.list_(pa.float64()))})

    rows = bounded(df, key, target, record).select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x"), F.col(target).cast("int").alias("y")).repartition(task_count(df), "key")
    return rows.groupBy("key").applyInArrow(fit, f"key {kind}, weights array<double>").withColumnRenamed("key", key)


def logistic_score(features, weights):
    """2p - 1 of a row under a model, as a column."""
    z = F.aggregate(F.zip_with(features, weights, lambda a, b: F.coalesce(a, F.lit(1.0)) * b), F.lit(0.0), lambda s, t: s + t)
    return 2 / (1 + F.exp(-z)) - 1


class Forest:
    """A random forest on numeric features (missing: -9999), grown on bootstrap samples with random splits."""

    def __init__(self, trees: list):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 8, seed: int = 3) -> Forest:
        rng = np.random.default_rng(seed)
        width = max(1, int(np.sqrt(x.shape[1])))

        def grow(rows: np.ndarray, level: int):
            p = y[rows].mean()
            if level == depth or p in (0.0, 1.0) or len(rows) < 4:
                return float(p)
            best = None
            for f in rng.choice(x.shape[1], width, replace=False):
                values = np.unique(x[rows, f])
                for cut in rng.choice(values[:-1], min(8, len(values) - 1), replace=False) if len(values) > 1 else []:
                    left = x[rows, f] <= cut
                    a, b = y[rows][left], y[rows][~left]
                    gini = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                    if best is None or gini < best[0]:
                        best = gini, f, cut, left
            if best is None:
                return float(p)
            return int(best[1]), float(best[2]), grow(rows[best[3]], level + 1), grow(rows[~best[3]], level + 1)

        return cls([grow(rng.integers(0, len(x), len(x)), 0) for _ in range(trees)])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees; all rows go down a tree together, a share of them to each side."""
        total = np.zeros(len(x))
        for tree in self.trees:
            todo = [(tree, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if not isinstance(node, tuple):
                    total[rows] += node
                elif len(rows):
                    low = x[rows, node[0]] <= node[1]
                    todo += [(node[2], rows[low]), (node[3], rows[~low])]
        return total / len(self.trees)


#: Rows that are scored in one group beside a copy of the model.
SCORED_ROWS = 100_000


def forest_scores(df: DataFrame, key: str, features: str, target: str, record: str, least: int = 50, trees: int = 25, bucket_rows: int = SCORED_ROWS) -> DataFrame:
    """(key, record, prob): every row scored by its key's forest (O-137, O-138); keys with fewer than ``least`` rows of
    either class have none. Models are trained from bounded rows, then each bucket of about ``bucket_rows`` rows is scored beside its key's model."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, record)}

    def fit(table: pa.Table) -> pa.Table:
        y = table["y"].to_numpy().astype(float)
        known = y.sum() >= least and (1 - y).sum() >= least
        model = [pickle.dumps(Forest.fit(np.array(table["x"].to_pylist(), float), y, trees))] if known else []
        return pa.table({"key": table["key"].combine_chunks()[: int(known)], "model": pa.array(model, pa.binary())})

    rows = df.select(F.col(key).alias("key"), F.col(record).alias("record"), F.transform(F.col(features).cast("array<double>"), lambda v: F.coalesce(v, F.lit(-9999.0))).alias("x"), F.col(target).cast("int").alias("y"))
    models = bounded(rows, "key", "y", "record").repartition(task_count(df), "key").groupBy("key").applyInArrow(fit, f"key {kinds[key]}, model binary")

    def score(part: pa.Table, model: pa.Table) -> pa.Table:
        if not part.num_rows or not model.num_rows:
            part = part.slice(0, 0)
            prob = np.zeros(0)
        else:
            prob = pickle.loads(model["model"][0].as_py()).predict(np.array(part["x"].to_pylist(), float))
        return pa.table({"key": part["key"], "record": part["record"], "prob": pa.array(prob)})

    # a model travels once per bucket of rows, not with every row; the more rows a key has, the more buckets
    wide = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("buckets"))
    copies = models.join(wide, "key").select("key", "model", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    spread = rows.join(wide.where("buckets > 1"), "key", "left").withColumn("bucket", F.pmod(F.xxhash64("record"), F.coalesce("buckets", F.lit(1).cast("long")))).drop("buckets")
    n = task_count(df)
    scored = spread.repartition(n, "key", "bucket").groupBy("key", "bucket").cogroup(copies.repartition(n, "key", "bucket").groupBy("key", "bucket"))
    return scored.applyInArrow(score, f"key {kinds[key]}, record {kinds[record]}, prob double").withColumnsRenamed({"key": key, "record": record})
