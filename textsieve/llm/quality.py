"""Quality classifier: regularised quadratic discriminant analysis.

Documents become statistics of their whole text (shares of letter kinds, symbols and separators,
word shapes, repetition), transformed to be roughly normal. For each class the mean and the
covariance are taken from sums over all training rows in one aggregation, the covariance is shrunk
towards the pooled diagonal, and its Cholesky factor is computed once. A score is the logistic of the
difference of the two log-densities: ``-(|L1^-1 (x - m1)|^2 - |L0^-1 (x - m0)|^2) / 2 - log|L1| + log|L0|``
plus the log odds of the classes (``prior``), divided by ``temper``.

The statistics and the scores are column expressions; what reaches the driver is one row of sums for
each class (about ``d * (d + 3) / 2 + 1`` numbers).

Defined results: null and empty texts have all statistics at their values for no characters and are
scored like any text; rows without a label are scored but not learnt from; repeated rows and labels
count as often as they occur. If a class has no training row, every score is 0.5. Extra columns stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

FEATURES = ("chars", "upper", "digit", "symbol", "pipe", "exclaim", "stop", "space", "word_len", "distinct", "line_words", "run")
SHRINK, RIDGE, ACCEPT = 0.15, 1e-3, 0.7


def _share(text: Column, cls: str, n: Column) -> Column:
    """The share of characters in a class, as log(share + 1e-3)."""
    return F.log((n - F.length(F.regexp_replace(text, cls, ""))) / F.greatest(n, F.lit(1)) + 1e-3)


def let(value: Column, body) -> Column:
    """body(value), where value is computed once: whatever is pushed down or merged, the optimizer copies no part of it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def features(text: Column) -> Column:
    """The statistics of a text (not null), an array of doubles in the order of FEATURES."""
    words = F.filter(F.split(F.lower(text), r"[\s|]+"), lambda w: w != "")
    return let(F.struct(text.alias("t"), F.length(text).alias("n"), words.alias("w")), lambda s: _statistics(s["t"], s["n"], s["w"]))


def _statistics(t: Column, n: Column, w: Column) -> Column:
    k = F.greatest(F.size(w), F.lit(1))
    lines = n - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    pairs = F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1))))
    return F.array(*[F.coalesce(c, F.lit(0.0)).cast("double") for c in (
        F.log1p(n),
        _share(t, r"\p{Lu}+", n),
        _share(t, r"[0-9]+", n),
        _share(t, r"[#$%&*@^~=+<>\\{}\[\]_]+", n),
        _share(t, r"[|\t]+", n),
        _share(t, r"!+", n),
        _share(t, r"[.,;:?]+", n),
        _share(t, r"\s+", n),
        F.log(n / k + 1e-3),
        F.size(F.array_distinct(w)) / k,
        F.log(k / lines),
        F.log(pairs / k + 1e-3),
    )])


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _x, the features."""
    return docs.withColumn("_x", features(text_or_empty(text)))


@dataclass
class Model:
    """Means, inverse Cholesky factors and log-determinants of both classes; log odds of class 1."""

    mean: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray
    odds: float
    temper: float = 1.0


def _sums(train: DataFrame, label: str, d: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    x = [F.col("_x")[i] for i in range(d)]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(d)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]]
    out = {}
    for r in train.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("c")).agg(*aggs).collect():
        second = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                second[i, j] = second[j, i] = r[f"p{i}_{j}"]
        out[r["c"]] = (r["n"], np.array([r[f"s{i}"] for i in range(d)]), second)
    return out


def fit(train: DataFrame, label: str = "quality", shrink: float = SHRINK, temper: float = 2.0) -> Model | None:
    """train has _x and the label; all its rows are used."""
    d = len(FEATURES)
    sums = _sums(train, label, d)
    if set(sums) != {0, 1}:
        return None
    total = sum(s[0] for s in sums.values())
    means, covs = [], []
    for c in (0, 1):
        n, s, q = sums[c]
        means.append(s / n)
        covs.append(q / n - np.outer(s / n, s / n))
    pooled = np.diag(sum(sums[c][0] * np.diag(covs[c]) for c in (0, 1)) / total)
    inverse, logdet = [], []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - shrink) * covs[c] + shrink * pooled + RIDGE * np.eye(d))
        inverse.append(np.linalg.solve(factor, np.eye(d)))
        logdet.append(np.log(np.diag(factor)).sum())
    return Model(np.array(means), np.array(inverse), np.array(logdet), math.log(sums[1][0] / sums[0][0]), temper)


def score(model: Model | None, x: str | Column = "_x") -> Column:
    """The probability of class 1."""
    if model is None:
        return F.lit(0.5)
    d = len(FEATURES)
    x = F.col(x) if isinstance(x, str) else x

    def mahalanobis(c: int) -> Column:
        total = F.lit(0.0)
        for i in range(d):
            row = model.inverse[c][i]
            z = F.lit(float(-(row @ model.mean[c])))
            for j in range(i + 1):
                z = z + F.lit(float(row[j])) * x[j]
            total = total + z * z
        return total

    gap = (mahalanobis(0) - mahalanobis(1)) / 2 + float(model.logdet[0] - model.logdet[1]) + model.odds
    return 1 / (1 + F.exp(F.greatest(F.least(-gap / model.temper, F.lit(500.0)), F.lit(-500.0))))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model | None:
    """The model of all labelled rows outside the held-out fold."""
    train = labels.select(F.col(key).alias("_k"), "quality").where(F.col("quality").isNotNull())
    # the statistics, not the texts, are what the join with the labels shuffles
    own = with_features(docs.select(F.col(key), "text").where(~held_out(key))).select(key, "_x")
    return fit(own.join(train, F.col(key) == F.col("_k")).select("_x", "quality"))


def text_score(model: Model | None, text: str = "text") -> Column:
    """The score of a text, from its statistics, which are computed once wherever the column ends up."""
    return F.lit(0.5) if model is None else let(features(text_or_empty(text)), lambda x: score(model, x))


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, key: str = "doc_id") -> DataFrame:
    """Adds score, predicted and held_out; columns of these names are replaced."""
    made = docs.withColumn("score", text_score(learn(docs, labels, key)))
    return made.withColumn("predicted", (F.col("score") >= accept).cast("int")).withColumn("held_out", held_out(key))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, key: str = "doc_id") -> DataFrame:
    """docs that the classifier accepts, with their columns as they are; all of them if a class has no training row."""
    model = learn(docs, labels, key)
    return docs if model is None else docs.where(text_score(model) >= accept)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
