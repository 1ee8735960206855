"""Logistic regression by Newton steps, each one aggregation of a small matrix; a model is a few numbers a feature."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvara.operators.ranking import quantiles, running_totals
from solvara.storage import staged

#: Newton steps at most, and the largest change of a coefficient at which they stop.
STEPS, TOLERANCE = 50, 1e-10


@dataclass(frozen=True)
class Logistic:
    """Features with the medians that stand for missing values, their standardisation, coefficients and intercept."""

    features: list[str]
    medians: list[float]
    means: list[float]
    deviations: list[float]
    coefficients: list[float]
    intercept: float
    steps: int = 0

    def standardised(self) -> list[Column]:
        return [(F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(m)), F.lit(m)) - F.lit(a)) / F.lit(d) for f, m, a, d in zip(self.features, self.medians, self.means, self.deviations)]

    def scored(self, df: DataFrame, name: str = "score") -> DataFrame:
        """``df`` with the probability of label 1, as one column expression."""
        z = F.lit(self.intercept)
        for x, b in zip(self.standardised(), self.coefficients):
            z = z + x * F.lit(b)
        return df.select(*[c for c in df.columns if c != name], (1 / (1 + F.exp(-z))).alias(name))

    def table(self, df: DataFrame) -> DataFrame:
        """(feature, coefficient) on standardised features, greatest first; a row a feature."""
        rows = list(zip(self.features, self.coefficients))
        return df.sparkSession.createDataFrame(rows, "feature string, coefficient double").orderBy(F.desc("coefficient"), "feature")


def preparation(train: DataFrame, features: list[str]) -> tuple[list[float], list[float], list[float]]:
    """Exact medians, and mean and sample deviation of each feature with medians for missing values.

    A feature without values counts as 0, one without deviation stays as it is.
    """
    items = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)])
    counts = train.select(F.inline(items)).where("value is not null and not isnan(value)").groupBy("feature", "value").agg(F.count("*").alias("n"))
    found = {r.feature: r.cuts[0] for r in quantiles(running_totals(counts, ["feature"], "value", ["n"]), ["feature"], "value", "n", [0.5]).collect()}  # a row a feature
    medians = [found.get(i, 0.0) for i in range(len(features))]
    filled = train.select([F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(m)), F.lit(m)).alias(f) for f, m in zip(features, medians)])
    one = filled.agg(*[F.avg(f).alias(f"a{i}") for i, f in enumerate(features)], *[F.stddev_samp(f).alias(f"d{i}") for i, f in enumerate(features)]).first()
    means = [one[f"a{i}"] or 0.0 for i in range(len(features))]
    return medians, means, [d if (d := one[f"d{i}"]) else 1.0 for i in range(len(features))]


def fit(train: DataFrame, features: list[str], label: str, penalty: float = 1.0) -> Logistic:
    """Median imputation, standardisation, and the logistic model of least weighted loss plus ``penalty`` / 2 * squared coefficients.

    A row weighs n / (2 * rows of its class); the intercept isn't penalised. Each step is one aggregation of the gradient
    and the matrix of second derivatives, features by features, which the driver solves; half steps follow one that the
    loss rose by. Rows without a label take no part. With one class alone the intercept would run off: an error.
    """
    rows = train.where(F.col(label).isNotNull())
    medians, means, deviations = preparation(rows, features)
    plain = Logistic(features, medians, means, deviations, [0.0] * len(features), 0.0)
    classes = {int(r[0]): r[1] for r in rows.groupBy(F.col(label).cast("int")).count().collect()}
    if set(classes) != {0, 1}:
        raise ValueError(f"a logistic fit needs both classes: {classes}")
    n, d = sum(classes.values()), len(features) + 1
    weight = F.when(F.col(label) == 1, n / (2 * classes[1])).otherwise(n / (2 * classes[0]))
    x = [F.lit(1.0), *plain.standardised()]
    data = staged(rows.select(F.col(label).cast("double").alias("y"), weight.alias("w"), *[c.alias(f"x{i}") for i, c in enumerate(x)]))
    shrink = np.diag([0.0] + [penalty] * (d - 1))

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and second derivatives at ``beta``: each task adds up its own, one aggregation all tasks'."""

        def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + d + d * d)
            for batch in batches:
                y, w, *columns = (c.to_numpy() for c in batch.columns)
                rows = np.stack(columns, axis=1)
                z = rows @ beta
                p = 1 / (1 + np.exp(-z))
                loss = (w * (np.maximum(z, 0) - y * z + np.log1p(np.exp(-np.abs(z))))).sum()
                total += np.concatenate([[loss], rows.T @ (w * (p - y)), (rows.T @ (rows * (w * p * (1 - p))[:, None])).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["place", "part"])

        added = data.mapInArrow(partial, "place int, part double").groupBy("place").agg(F.sum("part")).collect()  # d * d numbers, about
        row = np.array([value for _, value in sorted(added)])
        return row[0] + penalty / 2 * float(beta[1:] @ beta[1:]), row[1 : 1 + d] + shrink @ beta, row[1 + d :].reshape(d, d) + shrink

    beta, step, size = np.zeros(d), np.zeros(d), 1.0
    loss = np.inf
    for done in range(1, STEPS + 1):
        trial = beta + size * step
        value, gradient, second = sums(trial)
        if value > loss * (1 + 1e-12) + 1e-12:
            size /= 2
            continue
        moved, beta, loss, size = float(np.abs(size * step).max()), trial, value, 1.0
        step = -np.linalg.lstsq(second, gradient, rcond=None)[0]
        if np.abs(step).max() < TOLERANCE or (done > 1 and moved < TOLERANCE):
            break
    beta = beta + step  # the last step is below the tolerance, or the best there is
    return Logistic(features, medians, means, deviations, [float(b) for b in beta[1:]], float(beta[0]), done)
