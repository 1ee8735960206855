"""Fits whose driver-side part is small: isotonic by pooled ranges, logistic by Newton steps."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from solvara.operators import isotonic, logit, models, ranking
from solvara.plans import catalogue


def plain_isotonic(points):
    """By the max-min formula over (score, n, positives) in order of score."""
    w, s = np.cumsum([0] + [n for _, n, _ in points]), np.cumsum([0] + [p for *_, p in points])
    k = len(points)
    return [max(min((s[b + 1] - s[a]) / (w[b + 1] - w[a]) for b in range(i, k)) for a in range(i + 1)) for i in range(k)]


def scored(kind, n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = rng.randrange(n) / n
        p = {"rising": x, "falling": 1 - x, "flat": 0.3, "wave": 0.5 + 0.4 * np.sin(9 * x)}[kind]
        out.append((i, int(rng.random() < p), x))
    return out


@pytest.mark.parametrize("kind", ["rising", "falling", "flat", "wave"])
@pytest.mark.parametrize("tasks", [1, 7, 40])
def test_isotonic_equals_the_formula_whatever_the_ranges(spark, kind, tasks):
    rows = scored(kind, 300)
    df = spark.createDataFrame(rows, "customer_id long, y int, score double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        blocks = isotonic.fit(df, "y", "score")
        got = {r.score: r.calibrated for r in isotonic.apply(df, blocks, "score").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    xs = sorted({x for *_, x in rows})
    points = [(x, sum(1 for *_, z in rows if z == x), sum(y for _, y, z in rows if z == x)) for x in xs]
    assert [got[x] for x in xs] == pytest.approx(plain_isotonic(points), abs=1e-12)
    values = [r.value for r in blocks.orderBy("lo").collect()]
    assert all(a < b for a, b in zip(values, values[1:]))


def test_isotonic_lines_and_ends_equal_sparks(spark):
    df = spark.createDataFrame(scored("wave", 400, 2), "customer_id long, y int, score double")
    ask = spark.createDataFrame([(i, -0.2 + 1.4 * i / 997) for i in range(998)], "i int, score double")
    ours = isotonic.apply(ask, isotonic.fit(df, "y", "score"), "score")
    theirs = IsotonicRegression(featuresCol="score", labelCol="y", predictionCol="spark").fit(df).transform(ours)
    assert theirs.where("abs(calibrated - spark) > 1e-9 or calibrated is null").isEmpty() and ours.count() == 998


def test_isotonic_without_rows_nulls_and_one_score(spark):
    schema = "customer_id long, y int, score double"
    ask = spark.createDataFrame([(1, 0, 0.5), (2, 1, None), (3, 1, float("nan"))], schema)
    none = isotonic.fit(spark.createDataFrame([(1, None, 0.5), (2, 1, None), (3, 0, float("nan"))], schema), "y", "score")
    assert none.count() == 0 and [r.calibrated for r in isotonic.apply(ask, none, "score").collect()] == [None] * 3
    one = isotonic.fit(spark.createDataFrame([(1, 1, 0.3), (2, 0, 0.3)], schema), "y", "score")
    assert {r.customer_id: r.calibrated for r in isotonic.apply(ask, one, "score").collect()} == {1: 0.5, 2: None, 3: None}


def credit(spark, n=800, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.expovariate(1), rng.randrange(4)
        y = int(rng.random() < 1 / (1 + np.exp(2 - a + 0.5 * b)))
        rows.append((i, y if i % 9 else None, None if i % 7 == 0 else a, b, c))
    return spark.createDataFrame(rows, "customer_id long, y int, a double, b double, c int")


def test_logistic_equals_sparks(spark):
    df, features = credit(spark), ["a", "b", "c"]
    ours = logit.fit(df, features, "y")
    rows = models.with_class_weight(df.where("y is not null"), "y")
    n = rows.count()
    filled = rows.select("y", "weight", *[F.coalesce(F.col(f).cast("double"), F.lit(m)).alias(f) for f, m in zip(features, ours.medians)])
    x = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True)
    raw = VectorAssembler(inputCols=features, outputCol="raw").transform(filled)
    theirs = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=1000, tol=1e-14, regParam=1 / n, standardization=False).fit(x.fit(raw).transform(raw))
    assert ours.coefficients == pytest.approx(list(theirs.coefficients), abs=1e-6) and ours.intercept == pytest.approx(theirs.intercept, abs=1e-6)
    assert ours.steps < 12


def test_logistic_is_where_the_gradient_vanishes(spark):
    df, features = credit(spark, 300, 4), ["a", "b", "c"]
    m = logit.fit(df, features, "y", penalty=2.5)
    rows = [r for r in m.scored(df, "p").collect() if r.y is not None]
    n1 = sum(r.y for r in rows)
    x = np.array([[1.0] + [((getattr(r, f) if getattr(r, f) is not None else med) - a) / d for f, med, a, d in zip(features, m.medians, m.means, m.deviations)] for r in rows])
    w = np.array([len(rows) / (2 * (n1 if r.y else len(rows) - n1)) for r in rows])
    gradient = x.T @ (w * (np.array([r.p for r in rows]) - np.array([r.y for r in rows]))) + 2.5 * np.array([0, *m.coefficients])
    assert np.abs(gradient).max() < 1e-7


def test_logistic_with_odd_features_and_one_class(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 2), None, 5.0, float("nan") if i < 3 else 1.0 * i) for i in range(40)], "customer_id long, y int, apart double, empty double, constant double, some double")
    m = logit.fit(df, ["apart", "empty", "constant", "some"], "y")
    assert m.coefficients[0] > 1 and m.coefficients[1:3] == pytest.approx([0, 0]) and m.scored(df).where("score is null or isnan(score)").isEmpty()
    assert [r.feature for r in m.table(df).collect()][0] == "apart"
    with pytest.raises(ValueError, match="both classes"):
        logit.fit(df.where("y = 1"), ["some"], "y")


def test_permutation_importance_of_a_useless_feature(spark):
    df = credit(spark)
    m = logit.fit(df, ["a", "b", "c"], "y")
    got = {r.feature: r.auc_drop for r in models.permutation_importance(m, df.withColumnRenamed("y", "target_dlq_2yrs"), ["a", "b", "c"]).collect()}
    assert got["a"] > 0.05 and abs(got["c"]) < 0.03 and set(got) == {"a", "b", "c"}


def test_few_rows_at_the_cut_leave_the_others_unshuffled(spark, tmp_path):
    df = credit(spark, 500).select("customer_id", "y", F.col("b").alias("score"), F.lit(1).alias("model"))
    df.write.parquet(path := f"file://{tmp_path}/rows")
    out = ranking.lowest_fraction(spark.read.parquet(path), ["model"], "score", "customer_id", 0.3)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("approved").count() == 150


@pytest.mark.parametrize("name", ["m31_model_scoring", "d7_drift_history"])
def test_queries_with_several_passes_make_the_portfolio_once(spark, monkeypatch, name):
    class Seen(Exception):
        pass

    def seen(rows, *_):
        raise Seen("lineitem" in rows._jdf.queryExecution().toString())

    monkeypatch.setattr(catalogue.logit, "fit", seen)
    monkeypatch.setattr(catalogue.drift, "mode_report", seen)
    with pytest.raises(Seen) as got:
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.value.args == (False,)


def test_quantiles_of_ties_and_single_values(spark):
    rng = random.Random(5)
    values = {"one": [3.0], "ties": [float(rng.randrange(4)) for _ in range(101)], "many": [rng.gauss(0, 1) for _ in range(257)]}
    df = spark.createDataFrame([(k, x) for k, xs in values.items() for x in xs], "k string, x double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.731, 1.0]
    frame = ranking.running_totals(df.groupBy("k", "x").agg(F.count("*").alias("n")), ["k"], "x", ["n"])
    for r in ranking.quantiles(frame, ["k"], "x", "n", shares).collect():
        assert r.cuts == pytest.approx([float(np.quantile(values[r.k], q)) for q in shares])
