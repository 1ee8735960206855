"""Boosted trees from histograms: one split by brute force, missing values, draws, and the AUC against Spark's trees."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvara.operators import boosting, models, ranking

SCHEMA = "customer_id long, target_dlq_2yrs int, a double, b double, c int"


def rows(n=600, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.randrange(5)
        gone = rng.random() < 0.25
        z = 1.5 * (a > 0.3) + 1.2 * (b > 0) * (c > 2) + (2.0 if gone else 0) - 2
        out.append((i, int(rng.random() < 1 / (1 + np.exp(-z))), None if gone else a, float("nan") if rng.random() < 0.1 else b, c))
    return out


def test_one_split_by_brute_force(spark):
    data = rows(300)
    df = spark.createDataFrame(data, SCHEMA)
    model = boosting.fit(df, ["a", "b", "c"], "target_dlq_2yrs", trees=1, depth=1, step=1.0, row_share=1.0, feature_share=1.0)
    y = np.array([r[1] for r in data], float)
    p = y.mean()
    w = np.where(y == 1, (1 - p) / p, 1.0)
    g, h = w * (0.5 - y), w * 0.25
    score = lambda on: g[on].sum() ** 2 / (h[on].sum() + 1)
    best = (0.0,)
    for f, e in enumerate(model.edges):
        x = np.array([np.nan if r[2 + f] is None else r[2 + f] for r in data], float)
        for cut, edge in enumerate(e, 1):
            for missing_left in (True, False):
                left = np.where(np.isnan(x), missing_left, x <= edge).astype(bool)
                if min(h[left].sum(), h[~left].sum()) >= 1:
                    gain = score(left) + score(~left) - score(np.full(len(y), True))
                    if gain > best[0] + 1e-9:
                        best = gain, f, cut, missing_left, -g[left].sum() / (h[left].sum() + 1), -g[~left].sum() / (h[~left].sum() + 1)
    tree = model.trees[0]
    assert (tree.feature[0], tree.cut[0], bool(tree.missing_left[0])) == best[1:4]
    assert tree.value[1:3] == pytest.approx(best[4:6]) and model.gain.sum() == pytest.approx(best[0])


def test_as_good_as_sparks_trees(spark):
    train, test = (spark.createDataFrame(rows(900, s), SCHEMA) for s in (2, 3))
    ours = boosting.fit(train, ["a", "b", "c"], "target_dlq_2yrs", trees=30)
    theirs = models.boosted_trees(train, ["a", "b", "c"], trees=30)
    both = [models.probabilities(m, test, ["a", "b", "c"]).select(F.lit(n).alias("model"), "target_dlq_2yrs", "score") for n, m in (("ours", ours), ("spark", theirs))]
    auc = {r.model: r.auc for r in ranking.evaluate(both[0].union(both[1]), ["model"], "target_dlq_2yrs", "score").collect()}
    assert auc["ours"] >= auc["spark"] - 0.01 and auc["ours"] > 0.7
    assert [r.feature for r in boosting.importance(ours, train).collect()][0] == "a"


def test_partitions_do_not_matter_and_draws_do(spark, monkeypatch):
    monkeypatch.setattr(boosting, "WRITTEN", 3)
    df = spark.createDataFrame(rows(400, 4), SCHEMA)
    fits = [boosting.fit(df.repartition(n), ["a", "b", "c"], "target_dlq_2yrs", trees=5, depth=3, seed=s) for n, s in ((1, 1), (4, 1), (4, 2))]
    same, other = (all((t.feature == u.feature).all() and (t.cut == u.cut).all() for t, u in zip(fits[0].trees, m.trees)) for m in fits[1:])
    assert same and not other
    assert {len({f for f in t.feature if f >= 0}) <= 2 for t in fits[0].trees} == {True}  # two of three features a tree
    margins = [m.margins(m.binned([np.array([0.1, np.nan]), np.array([np.nan, 1.0]), np.array([2.0, 3.0])])) for m in fits[:2]]
    assert margins[0] == pytest.approx(margins[1])


def test_odd_inputs(spark):
    df = spark.createDataFrame([(i, i % 2, None, 1.0, None if i % 2 else i % 4) for i in range(60)], SCHEMA)
    model = boosting.fit(df, ["a", "b", "c"], "target_dlq_2yrs", trees=3, depth=2, feature_share=1.0)
    got = {(r.target_dlq_2yrs): r.score for r in model.scored(df).collect()}
    assert got[1] > 0.5 > got[0] and model.gain[0] == model.gain[1] == 0
    with pytest.raises(ValueError, match="both classes"):
        boosting.fit(df.where("target_dlq_2yrs = 1"), ["c"], "target_dlq_2yrs")


def test_a_level_is_one_job_of_one_stage(spark):
    df = spark.createDataFrame(rows(400, 5), SCHEMA)
    jobs, tracker = {}, spark.sparkContext.statusTracker()
    for trees in (2, 6):
        spark.sparkContext.setJobGroup(f"trees-{trees}", "boosting")
        boosting.fit(df, ["a", "b", "c"], "target_dlq_2yrs", trees=trees, depth=3)
        jobs[trees] = len(tracker.getJobIdsForGroup(f"trees-{trees}"))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs[6] - jobs[2] <= 4 * 3


def test_margins_written_anew_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(rows(400, 6), SCHEMA)
    fits = []
    for written in (2, 50):
        monkeypatch.setattr(boosting, "WRITTEN", written)
        fits.append(boosting.fit(df, ["a", "b", "c"], "target_dlq_2yrs", trees=7, depth=3))
    assert all((t.feature == u.feature).all() and (t.cut == u.cut).all() and t.value == pytest.approx(u.value) for t, u in zip(fits[0].trees, fits[1].trees))
