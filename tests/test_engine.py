"""Boundaries, properties and invariants of the portfolio operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvara.functions import rules
from solvara.operators import clean, drift, fairness, models, profile, ranking, star, thresholds


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def psi_of(spark, ref, cur, **options):
    data = [("r", None if x is None else float(x)) for x in ref] + [("c", None if x is None else float(x)) for x in cur]
    df = rows(spark, data, "side string, x double").repartition(3)
    frame = drift.long_frame(df, ["x"], F.col("side") == "r", F.col("side") == "c")
    got = drift.psi(frame, drift.bin_edges(frame, **options)).collect()
    return got[0].psi if got else None


def numpy_psi(ref, cur, bins=10):
    """The definition, written anew with numpy for continuous features without ties."""
    edges = np.quantile(ref, np.linspace(0, 1, bins + 1))[1:-1]
    share = lambda x: np.maximum(np.bincount(np.searchsorted(edges, x, "right"), minlength=bins) / len(x), 1e-4)
    a, b = share(ref), share(cur)
    return float(((b - a) * np.log(b / a)).sum())


def test_decision_boundaries(spark):
    df = rows(spark, [(0.30,), (0.80,), (0.56,), (0.0,), (1.0,)], "p double")
    assert [r[0] for r in df.select(rules.decision(F.col("p"), 0.56)).collect()] == ["aprovado", "negado", "negado", "aprovado", "negado"]
    for bad in (-0.01, 1.01, 2.0, -5.0):
        with pytest.raises(Exception, match="outside 0 to 1"):
            rows(spark, [(bad,)], "p double").select(rules.decision(F.col("p"))).collect()


@pytest.mark.parametrize("shift", [0.0, 0.3, 2.0])
def test_psi_equals_its_definition(spark, shift):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=2000), rng.normal(shift, size=1500)
    assert abs(psi_of(spark, a, b) - numpy_psi(a, b)) < 1e-9


def test_psi_identity_nulls_constant_and_empty(spark):
    a = np.random.default_rng(2).normal(size=500)
    assert abs(psi_of(spark, a, a)) < 1e-9
    assert psi_of(spark, [*a, None, float("nan")], a) == psi_of(spark, a, a)
    assert psi_of(spark, [5.0] * 100, [7.0] * 50) == 0.0
    assert math.isnan(psi_of(spark, a, []))


def test_psi_of_zero_inflated_counts(spark):
    rng = np.random.default_rng(3)

    def sample(share):
        return np.where(rng.random(4000) < share, rng.integers(1, 5, 4000), 0)

    ref = sample(0.055)
    assert psi_of(spark, ref, sample(0.20)) > 0.10
    assert psi_of(spark, ref, sample(0.35)) >= 0.25
    assert psi_of(spark, ref, sample(0.055)) < 0.10


def test_bin_edges_of_each_kind(spark):
    def edges(values, **options):
        df = rows(spark, [(float(v),) for v in values], "x double")
        return drift.bin_edges(drift.long_frame(df, ["x"], F.lit(True), F.lit(False)), **options).first().edges

    assert edges([3] * 9) == []
    assert edges([0] * 90 + [1] * 6 + [2] * 4) == [0.5, 1.5]
    assert edges(list(range(12)) * 3 + [0] * 100) == [i + 0.5 for i in range(9)]  # the tail shares the last bin
    mass = [10.0] * 2000 + [i / 7 for i in range(60)]
    assert edges(mass) == [(0 + 1 / 7) / 2]  # a point mass: a cut between the two smallest values
    assert edges(mass, isolate_mode=True) == [(59 / 7 + 10) / 2]
    assert np.allclose(edges(range(101)), list(range(10, 100, 10)))


def test_psi_classes(spark):
    df = rows(spark, [(x,) for x in (0.0, 0.05, 0.099, 0.10, 0.20, 0.249, 0.25, 1.5, float("nan"), None)], "p double")
    assert [r[0] for r in df.select(rules.psi_class(F.col("p"))).collect()] == ["estavel"] * 3 + ["moderado"] * 3 + ["SEVERO"] * 2 + ["indefinido"] * 2
    assert rows(spark, [(0.05,)], "p double").select(rules.psi_class(F.col("p"), 0.03, 0.08)).first()[0] == "moderado"


def test_auc_drop(spark):
    df = rows(spark, [(0.80, 0.795), (0.80, 0.77), (0.80, 0.85)], "a double, b double")
    drop, alert = rules.auc_alert(F.col("a"), F.col("b"))
    got = df.select(drop.alias("d"), alert.alias("x")).collect()
    assert [r.x for r in got] == [False, True, False] and got[2].d < 0


def test_wilson(spark):
    low, high = rules.wilson(F.col("k"), F.col("n"))
    a, b, c = rows(spark, [(5, 100), (0, 50), (0, 0)], "k long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert 0 <= a.l < 0.05 < a.h <= 1 and abs(b.l) < 1e-12 and c.l is None and c.h is None


def test_age_bands(spark):
    df = rows(spark, [(x,) for x in (17, 18, 30, 31, 60, 61, 110, None)], "a int")
    assert [r[0] for r in df.select(rules.age_band(F.col("a"))).collect()] == ["não informada", "18-30", "18-30", "31-40", "51-60", "60+", "60+", "não informada"]


def test_income_bands(spark):
    values = [None, None, *[1000.0 * i for i in range(1, 11)]]
    got = {r.x: r.income_band for r in fairness.with_income_band(rows(spark, [(v,) for v in values], "x double"), "x").collect()}
    assert got[None] == "não informada" and got[1000.0] == "Q1 (menor)" and got[2000.0] == "Q1 (menor)" and got[3000.0] == "Q2" and got[10000.0] == "Q5 (maior)"
    assert {r.income_band for r in fairness.with_income_band(rows(spark, [(5.0,), (5.0,)], "x double"), "x").collect()} == {"Q1"}
    assert {r.income_band for r in fairness.with_income_band(rows(spark, [(None,)], "x double"), "x").collect()} == {"não informada"}


def test_break_even(spark):
    data = [(1, 0.9), (1, 0.9)] + [(0, 0.9)] * 6 + [(0, 0.1)] * 2
    r = thresholds.financial_impact(rows(spark, data, "y int, p double"), "y", "p", 0.5, margin=100.0, loss=300.0).first()
    assert (r.break_even_ratio, r.net, r.bads_rejected, r.goods_rejected) == (3.0, 0.0, 2, 6)
    nobody = thresholds.financial_impact(rows(spark, [(0, 0.1)], "y int, p double"), "y", "p").first()
    assert nobody.break_even_ratio is None and nobody.default_before == 0


def test_sweep_equals_direct_counts(spark):
    rng = np.random.default_rng(5)
    data = [(int(rng.random() < 0.2), round(float(rng.random()), 2)) for _ in range(400)]
    got = {r.threshold: (r.tn, r.fp, r.fn, r.tp) for r in thresholds.cost_sweep(rows(spark, data, "y int, p double"), "y", "p").collect()}
    for t, counts in got.items():
        assert counts == tuple(sum(1 for y, p in data if y == want and (p >= t) == deny) for want, deny in ((0, False), (0, True), (1, False), (1, True)))


def test_no_viable_threshold(spark):
    df = rows(spark, [(1, 0.99), (0, 0.99)], "y int, p double")
    best = thresholds.best_viable(thresholds.approval_sweep(df, "y", "p"))
    assert best.first().status == "inconclusiva" and thresholds.net_impact(df, "y", "p", best).count() == 0


def brute_auc(data):
    pos, neg = [p for y, p in data if y == 1], [p for y, p in data if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_ranking_metrics_do_not_depend_on_partitions(spark, parts):
    rng = np.random.default_rng(6)
    data = [(int(rng.random() < 0.3), round(float(rng.random()), 2)) for _ in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = rows(spark, [("a", y, p) for y, p in data], "model string, y int, p double")
        r = ranking.evaluate(df, ["model"], "y", "p").first()
        assert abs(r.auc - brute_auc(data)) < 1e-12
        cut = sorted({p for _, p in data})
        n = [sum(1 for y, _ in data if y == k) for k in (0, 1)]
        assert abs(r.ks - max(abs(sum(p <= c for y, p in data if y == 1) / n[1] - sum(p <= c for y, p in data if y == 0) / n[0]) for c in cut)) < 1e-12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_auc_equals_sparks_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(7)
    df = rows(spark, [("m", float(rng.random() < 0.3), float(np.round(rng.random(), 3))) for _ in range(500)], "model string, y double, p double")
    want = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(df)
    assert abs(ranking.evaluate(df, ["model"], "y", "p").first().auc - want) < 1e-9


def test_one_class_has_no_auc(spark):
    assert ranking.evaluate(rows(spark, [("m", 1, 0.5)], "model string, y int, p double"), ["model"], "y", "p").first().auc is None


@pytest.mark.parametrize("rate", [0.0, 0.125, 0.5, 0.731, 1.0])
def test_lowest_fraction(spark, rate):
    data = [("a", i, (i * 7) % 4 / 4) for i in range(20)] + [("b", i, 0.5) for i in range(12)]
    got = ranking.lowest_fraction(rows(spark, data, "model string, id long, p double"), ["model"], "p", "id", rate).collect()
    for model in "ab":
        own = sorted((p, i) for m, i, p in data if m == model)
        want = {i for _, i in own[: round(rate * len(own))]}
        assert {r.id for r in got if r.model == model and r.approved} == want


def test_spearman_resists_outliers(spark):
    rng = np.random.default_rng(8)
    x = rng.random(1500)
    y = np.tanh(3 * (x - 0.5)) + rng.normal(0, 0.1, 1500)
    x[:15] = rng.uniform(500, 5000, 15)
    df = rows(spark, [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, float("nan"))], "x double, y double")
    got = ranking.spearman(df, "x", "y").first()
    rank = lambda v: np.argsort(np.argsort(v))
    assert abs(got.spearman - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-9 and got.spearman > 0.5 and got.n == 1500


def test_winner_and_champion(spark):
    m = lambda a, b: rows(spark, [("simple", a), ("trees", b)], "model string, auc double")
    assert ranking.winner(m(0.80, 0.804), "simple", "trees").first().winner == "simple"
    assert ranking.winner(m(0.80, 0.81), "simple", "trees").first().winner == "trees"
    assert ranking.champion(rows(spark, [(1, 0.8), (2, 0.8), (3, 0.79)], "version int, auc double")).first().version == 1


def test_reconciliation_needs_a_record(spark):
    a = rows(spark, [("x", 0.8), ("y", 0.7), ("z", 0.6)], "model string, auc double")
    b = rows(spark, [("x", 0.8 + 5e-7), ("y", 0.71)], "model string, auc double")
    assert {r.model: r.passes for r in ranking.reconciled(a, b).collect()} == {"x": True, "y": False, "z": False}


def test_bias_alert_names_the_disadvantaged(spark):
    rng = np.random.default_rng(9)
    data = []
    for i in range(4000):
        age, y = [25, 45, 65][i % 3], int(rng.random() < 0.07)
        data.append((age, float(rng.random() * 1000), y, float(np.clip(rng.random() * 0.5 + (0.3 if age == 25 and y == 0 else 0), 0, 1))))
    df = fairness.with_bands(rows(spark, data, "age int, monthly_income double, y int, p double"))
    found = {(r.dimension, r.band) for r in fairness.alerts(fairness.group_metrics(df, "y", "p", 0.45, {"age": "age_band"})).collect()}
    assert ("age", "18-30") in found and ("age", "41-50") not in found


def test_calibration_corrects_inflated_scores(spark):
    rng = np.random.default_rng(10)
    data = []
    for i in range(6000):
        p = rng.beta(1, 13)
        data.append((i, int(rng.random() < p), float(min(1.0, 4 * p))))
    got = {r.kind: r for r in models.calibration_analysis(rows(spark, data, "customer_id long, target_dlq_2yrs int, score double")).collect()}
    assert got["raw"].mean_predicted > 3 * got["raw"].observed and abs(got["calibrated"].mean_predicted - got["calibrated"].observed) < 0.015
    assert got["calibrated"].brier < got["raw"].brier


def test_split_is_exact_by_class_and_independent_of_order(spark):
    data = [(i, int(i % 7 == 0)) for i in range(1000)]
    a, b = (sorted(map(tuple, models.stratified_split(rows(spark, d, "customer_id long, target_dlq_2yrs int").repartition(n)).collect())) for d, n in ((data, 1), (data[::-1], 5)))
    assert a == b
    for y in (0, 1):
        own = [t for t in a if t[1] == y]
        assert sum(t[2] for t in own) == round(0.25 * len(own))


def test_clean_quarantines_and_flags(spark):
    from solvara.streaming.ingest import RAW_SCHEMA

    base = [1, 0, 0.5, 40, 0, 0.1, 1000.0, 1, 0, 0, 0, 2.9]
    change = lambda **k: [k.get(f.name.replace("-", "_"), v) for f, v in zip(RAW_SCHEMA.fields, base)]
    data = [base, change(_c0=None), change(_c0=2, age=17), change(_c0=3, age=18), change(_c0=4, age=120), change(_c0=5, age=121), change(_c0=6, MonthlyIncome=None), change(_c0=7, NumberOfTimes90DaysLate=96), change(_c0=8, NumberOfTimes90DaysLate=95), change(_c0=9, NumberOfDependents=None), change(_c0=10, NumberOfDependents=float("nan"))]
    got = {r.customer_id: r for r in clean.clean(spark.createDataFrame(data, RAW_SCHEMA)).collect()}
    assert len(got) == 10 and [got[i].age for i in (2, 3, 4, 5)] == [None, 18, 120, None]
    assert got[6].is_monthly_income_null == 1 and got[7].has_delinquency_outlier == 1 and got[8].has_delinquency_outlier == 0
    assert got[1].num_dependents == 2 and got[9].num_dependents == 0 and got[10].num_dependents == 0


def test_union_checks(spark):
    a = rows(spark, [(1, 0, 5)], "customer_id long, target_default_2yrs int, x int")
    b = rows(spark, [(1, 6)], "customer_id long, x int")
    assert sorted(map(tuple, star.populations(a, b).collect()), key=str) == [(1, 0, 5), (10000001, None, 6)]
    with pytest.raises(ValueError, match="one population only"):
        star.populations(a, b.withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError, match="unique"):
        star.assert_unique(a.union(a))


def test_empty_profile(spark):
    empty = rows(spark, [], "a int, b double")
    assert {r.pct_null for r in profile.completeness(empty).collect()} == {0.0}
    assert profile.duplicate_rows(empty).first().n_duplicates == 0
    assert profile.numeric_summary(empty, ["a", "zz"]).first().n == 0


def test_empty_population_is_an_error(spark):
    df = rows(spark, [(1, 0.5)], "customer_id long, score double").withColumn("y", F.lit(1))
    with pytest.raises(RuntimeError, match="empty"):
        drift.mode_report(df, ["score"], "scoring", "y", star.hash_bucket())


def test_no_single_partition_over_rows(spark):
    """Running totals never plan one task over all rows."""
    df = rows(spark, [("m", i % 2, i / 100) for i in range(100)], "model string, y int, p double")
    plan = ranking.score_counts(df, ["model"], "y", "p")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_shapley_values_add_up(spark):
    rng = np.random.default_rng(11)
    data = [(i, int(rng.random() < 0.3), float(rng.normal()), float(rng.normal()) if i % 9 else None, 1.0) for i in range(300)]
    df = rows(spark, data, "customer_id long, target_dlq_2yrs int, a double, b double, c double")
    model = models.logistic(df, ["a", "b", "c"])
    got = models.sampled_shapley(model, df, ["a", "b", "c"], rows=20, orders=3, background=1)
    sums = {r.customer_id: r.s for r in got.groupBy("customer_id").agg(F.sum("attribution").alias("s")).collect()}
    scores = {r.customer_id: r.score for r in models.probabilities(model, df, ["a", "b", "c"]).collect()}
    assert len(sums) == 20
    base = [scores[k] - s for k, s in sums.items()]
    assert max(base) - min(base) < 1e-9  # the one background row's score
    assert max(abs(r.attribution) for r in got.where("feature = 'c'").collect()) < 1e-9


def test_required_columns(spark):
    with pytest.raises(ValueError, match="zz"):
        clean.require_columns(rows(spark, [(1,)], "a int"), ["a", "zz"])


def test_realised_outcomes_and_fallback(spark):
    from solvara.operators import drift, models

    rows = spark.createDataFrame([(i, int(i % 4 == 0), 0.9 - (i % 4) * 0.2 + (i % 7) / 100) for i in range(400)], "customer_id long, target_dlq_2yrs int, score double")
    predictions = models.predictions(rows, "m", "1")
    late = rows.where("customer_id < 100").select("customer_id", "target_dlq_2yrs")
    current = drift.realised(predictions, late, "target_dlq_2yrs", "customer_id")
    assert current.count() == 100
    one = drift.concept_report("resultados_realizados", current, rows, "target_dlq_2yrs", "score", 0.5).first()
    assert (one["mode"], one.auc_reference, one.auc_current, one.alert, one.as_expected) == ("resultados_realizados", 0.5, 1.0, False, True)
    unknown = drift.concept_report("resultados_realizados", current, rows, "target_dlq_2yrs", "score").first()
    assert unknown.auc_reference is None and unknown.auc_current == 1.0
    for outcomes in (None, late.limit(0)):
        assert drift.realised(predictions, outcomes, "target_dlq_2yrs", "customer_id") is None
    simulated = drift.concept_report("resultados_realizados", None, rows, "target_dlq_2yrs", "score").first()
    assert simulated["mode"] == "simulacao" and simulated.alert and simulated.as_expected


def test_histories_gain_rows_and_keep_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    from solvara.operators import drift
    from solvara.sources import tables

    rows = spark.createDataFrame([(i, float(i % 13), i % 2) for i in range(200)], "customer_id long, x double, g int")
    for mode in ("a", "b"):
        tables.append_by_date(drift.report_history(drift.report(rows, ["x"], F.col("g") == 0, F.col("g") == 1), mode, F.current_timestamp()), str(tmp_path))
    got = tables.read_merged(spark, str(tmp_path))
    assert sorted(r["mode"] for r in got.collect()) == ["a", "b"]
    assert {"feature", "psi", "psi_class", "ks", "p_value", "run_at", "n_reference", "n_current"} <= set(got.columns)


def test_profiles_of_empty_and_constant_columns(spark):
    from solvara.operators import profile

    df = spark.createDataFrame([(1, None, 2.0), (1, None, 4.0)], "a int, b double, c double")
    assert {r.column_name: r.n_distinct for r in profile.cardinality(df, exact=True).collect()} == {"a": 1, "b": 0, "c": 2}
    assert {r.column_name: (r.n_distinct, r.pct_distinct) for r in profile.cardinality(df.limit(0), exact=True).collect()} == {"a": (0, 0.0), "b": (0, 0.0), "c": (0, 0.0)}
    got = {r.column_name: (r.n, r.p25, r.p50, r.max) for r in profile.numeric_summary(df, ["a", "b", "c"], exact=True).collect()}
    assert got == {"a": (2, 1.0, 1.0, 1.0), "b": (0, None, None, None), "c": (2, 2.5, 3.0, 4.0)}
