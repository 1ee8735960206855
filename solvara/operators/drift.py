"""Data and concept drift: all features at once from one frame of counts by feature and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvara.functions import rules
from solvara.operators.ranking import evaluate, quantiles, running_totals
from solvara.operators.star import hash_bucket
from solvara.storage import staged

BINS, DISCRETE, LEAST = 10, 50, 1e-4


def long_frame(df: DataFrame, features: list[str], reference: Column, current: Column) -> DataFrame:
    """(feature, value, ref, cur): rows of both populations by distinct value, with running totals; nulls and NaNs left out."""
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    rows = df.select(reference.alias("__r"), current.alias("__c"), F.inline(items)).where("value is not null and not isnan(value)")
    counts = rows.groupBy("feature", "value").agg(F.count_if("__r").alias("ref"), F.count_if("__c").alias("cur"))
    return running_totals(counts, ["feature"], "value", ["ref", "cur"])


def bin_edges(frame: DataFrame, bins: int = BINS, isolate_mode: bool = False) -> DataFrame:
    """Inner edges by feature, from the reference side: (feature, edges); an empty array means a constant feature.

    Distinct deciles, if there are at least three and none tie. Where they tie and the feature has at most 50 values, a
    bin a value, the last pooling the tail. Otherwise, with fewer than three, one cut between the two smallest values.
    With ``isolate_mode`` that cut instead parts the most frequent value from its neighbour above, or below the greatest.
    """
    own = frame.where("ref > 0")
    deciles = quantiles(own, ["feature"], "value", "ref", [i / bins for i in range(bins + 1)])
    rank = F.row_number().over(Window.partitionBy("feature").orderBy("value"))
    least = own.withColumn("r", rank).where(F.col("r") <= bins + 1).groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("firsts"))
    sizes = own.groupBy("feature").agg(F.count("*").alias("distinct"), F.max_by("value", F.struct("ref", -F.col("value"))).alias("mode"))
    cuts, firsts = F.array_distinct("cuts"), F.col("firsts")

    def middles(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n), lambda i: (F.get(firsts, i - 1) + F.get(firsts, i)) / 2)

    one = middles(F.lit(1))
    if isolate_mode:
        beside = own.join(F.broadcast(sizes.select("feature", "mode")), "feature").groupBy("feature").agg(F.min(F.when(F.col("value") > F.col("mode"), F.col("value"))).alias("above"), F.max(F.when(F.col("value") < F.col("mode"), F.col("value"))).alias("below"))
        sizes = sizes.join(beside, "feature", "left")
        one = F.array((F.col("mode") + F.coalesce("above", "below")) / 2)
    edges = (
        F.when(F.col("distinct") < 2, F.array().cast("array<double>"))
        .when((F.size(cuts) < bins + 1) & (F.col("distinct") <= DISCRETE), middles(F.least(F.col("distinct") - 1, F.lit(bins - 1)).cast("int")))
        .when(F.size(cuts) < 3, one)
        .otherwise(F.slice(cuts, 2, F.greatest(F.size(cuts) - 2, F.lit(1))))
    )
    return deciles.join(least, "feature").join(sizes, "feature").select("feature", edges.alias("edges"))


def psi(frame: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, psi, n_ref, n_cur): bins closed on the left, shares floored at 1e-4; NaN if either side is empty."""
    binned = frame.join(F.broadcast(edges), "feature", "left")  # a row a feature, of at most a dozen numbers
    cell = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    counts = binned.groupBy("feature", cell.alias("cell")).agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    totals = counts.groupBy("feature").agg(F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("cell"), F.size("edges").alias("cuts"))
    full = grid.join(counts, ["feature", "cell"], "left").fillna(0, ["ref", "cur"]).join(totals, "feature")
    share = lambda c: F.greatest(F.try_divide(c, f"n_{c}"), F.lit(LEAST))
    term = (share("cur") - share("ref")) * F.ln(share("cur") / share("ref"))
    sums = full.groupBy("feature").agg(F.when(F.max("cuts") == 0, 0.0).otherwise(F.sum(term)).alias("psi"))
    value = F.when((F.col("n_ref") == 0) | (F.col("n_cur") == 0), float("nan")).otherwise(F.col("psi"))
    return totals.join(sums, "feature", "left").select("feature", value.alias("psi"), "n_ref", "n_cur")


def stored_profile(reference: DataFrame, features: list[str], version: int, bins: int = BINS) -> DataFrame:
    """What a batch is held against, without the reference itself: (version, feature, edges, counts by bin, n_ref), a row a feature."""
    frame = long_frame(reference, features, F.lit(True), F.lit(False))
    edges = staged(bin_edges(frame, bins))
    cell = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    counts = frame.join(F.broadcast(edges), "feature").groupBy("feature", cell.alias("cell")).agg(F.sum("ref").alias("ref"))  # a row a feature
    grid = edges.select("feature", "edges", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("cell")).join(counts, ["feature", "cell"], "left").fillna(0, ["ref"])
    by = F.array_sort(F.collect_list(F.struct("cell", "ref")))
    return grid.groupBy("feature").agg(F.first("edges").alias("edges"), F.transform(by, lambda x: x.ref).alias("counts"), F.sum("ref").alias("n_ref")).select(F.lit(version).alias("version"), "*")


def psi_against(profile: DataFrame, batch: DataFrame) -> DataFrame:
    """(version, feature, psi, n_ref, n_cur) of a batch against a stored profile of one version.

    The batch is binned where it lies and counted by feature and bin; nulls and NaNs are left out, a feature without values
    has a NaN. Shares are floored as in ``psi``.
    """
    features = [r.feature for r in profile.select("feature").collect()]  # a row a feature
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    rows = batch.select(F.inline(items)).where("value is not null and not isnan(value)")
    cell = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    counts = rows.join(F.broadcast(profile.select("feature", "edges")), "feature").groupBy("feature", cell.alias("cell")).agg(F.count("*").alias("cur"))
    grid = profile.select("version", "feature", "n_ref", F.size("edges").alias("cuts"), F.posexplode("counts").alias("cell", "ref"))
    full = grid.join(counts, ["feature", "cell"], "left").fillna(0, ["cur"])
    total = F.sum("cur").over(Window.partitionBy("feature"))
    share = lambda c, n: F.greatest(F.try_divide(c, n), F.lit(LEAST))
    sides = full.select("*", total.alias("n_cur")).withColumns({"r": share(F.col("ref"), F.col("n_ref")), "c": share(F.col("cur"), F.col("n_cur"))})
    each = sides.groupBy("version", "feature").agg(F.max("cuts").alias("cuts"), F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r"))).alias("psi"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"))
    value = F.when((F.col("n_ref") == 0) | (F.col("n_cur") == 0), float("nan")).when(F.col("cuts") == 0, 0.0).otherwise(F.col("psi"))
    return each.select("version", "feature", value.alias("psi"), "n_ref", "n_cur")


def kolmogorov_p(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample p-value on the effective size."""
    root = F.sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * statistic
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * x * x))
    series = 2 * F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ks(frame: DataFrame) -> DataFrame:
    """(feature, ks, p_value) between the two sides; null if one is empty."""
    gap = F.abs(F.try_divide(F.col("before_ref") + F.col("ref"), "total_ref") - F.try_divide(F.col("before_cur") + F.col("cur"), "total_cur"))
    out = frame.groupBy("feature").agg(F.max(gap).alias("ks"), F.first("total_ref").alias("n"), F.first("total_cur").alias("m"))
    return out.select("feature", "ks", kolmogorov_p(F.col("ks"), F.col("n"), F.col("m")).alias("p_value"))


def report(df: DataFrame, features: list[str], reference: Column, current: Column, bins: int = BINS) -> DataFrame:
    """PSI with its class, KS and p-value for each feature, the greatest PSI first."""
    frame = long_frame(df, features, reference, current)
    both = psi(frame, bin_edges(frame, bins)).join(ks(frame), "feature", "left")
    return both.select("feature", "psi", rules.psi_class(F.col("psi")).alias("psi_class"), "ks", "p_value", "n_ref", "n_cur").orderBy(F.desc("psi"), "feature")


def severe(report_: DataFrame) -> DataFrame:
    """One row: the features of severe drift in order of PSI, and their number."""
    rows = F.filter(F.collect_list(F.struct("psi", "feature", "psi_class")), lambda r: r.psi_class == "SEVERO")
    one = report_.agg(F.reverse(F.array_sort(rows)).alias("r"))
    return one.select(F.transform("r", lambda x: x.feature).alias("features"), F.size("r").alias("n_severe"))


def report_history(report_: DataFrame, mode: str, at: Column) -> DataFrame:
    """The rows that a run adds to the history of data drift."""
    return report_.select("feature", "psi", "psi_class", "ks", "p_value", at.alias("run_at"), F.lit(mode).alias("mode"), F.col("n_ref").alias("n_reference"), F.col("n_cur").alias("n_current"))


#: Populations compared, and the greatest PSI expected of those that are alike.
MODES = {"scoring": None, "training": 1e-9, "training_amostra": 0.10}


def populations(mode: str, label: str, bucket: Column) -> tuple[Column, Column]:
    """Reference and current rows of a mode: labelled against unlabelled, labelled against itself, or an 80/20 split of it."""
    labelled = F.col(label).isNotNull()
    return {
        "scoring": (labelled, ~labelled),
        "training": (labelled, labelled),
        "training_amostra": (labelled & (bucket >= 20), labelled & (bucket < 20)),
    }[mode]


def mode_report(df: DataFrame, features: list[str], mode: str, label: str, bucket: Column) -> DataFrame:
    """The drift report of a mode, whether each feature is as expected, and an error if a side has no rows."""
    ref, cur = populations(mode, label, bucket)
    if df.where(ref).isEmpty() or df.where(cur).isEmpty():
        raise RuntimeError(f"mode {mode}: a population is empty")
    limit = MODES[mode]
    return report(df, features, ref, cur).withColumns({"mode": F.lit(mode), "as_expected": F.lit(True) if limit is None else F.col("psi") < limit})


def concept(df: DataFrame, label: str, score: str, current: Column) -> DataFrame:
    """AUC of the reference rows against the current ones, KS of these, signed drop and alert."""
    rows = df.withColumn("population", F.when(current, "current").otherwise("reference"))
    by = evaluate(rows, ["population"], label, score)
    one = by.agg(*[F.max(F.when(F.col("population") == p, F.col(c))).alias(f"{c}_{p}") for c, p in (("auc", "reference"), ("auc", "current"), ("ks", "current"))])
    drop, alert = rules.auc_alert(F.col("auc_reference"), F.col("auc_current"))
    return one.withColumns({"auc_drop": drop, "alert": alert})


def realised(predictions: DataFrame, outcomes: DataFrame | None, label: str, key: str, score: str = "probability") -> DataFrame | None:
    """Predictions with the outcomes that have become known, None if there is no table of these or none has."""
    if outcomes is None:
        return None
    rows = predictions.select(key, F.col(score).alias("score")).join(outcomes.where(F.col(label).isNotNull()).select(key, label), key)
    return None if rows.isEmpty() else rows


#: Whether a mode of ``concept_report`` should alert; the outcomes of the real portfolio are open.
EXPECTED_ALERT = {"resultados_realizados": None, "treino_amostra": False, "simulacao": True}


def concept_report(mode: str, current: DataFrame | None, reference: DataFrame, label: str, score: str, recorded_auc: float | None = None) -> DataFrame:
    """One row: mode, AUC of reference and current rows, KS of the latter, drop, alert, and whether the alert is as expected.

    In the mode ``resultados_realizados`` the current rows are predictions with late labels, and the reference AUC is the
    recorded one, null if none was. Where there are no such rows (None), the mode becomes ``simulacao``: scores of half the
    reference's rows are reversed, which must alert. ``treino_amostra`` compares two parts of the labelled rows.
    """
    if mode == "resultados_realizados" and current is None:
        mode = "simulacao"
    if mode == "simulacao":
        half = hash_bucket() < 50
        current = reference.withColumn(score, F.when(half, 1 - F.col(score)).otherwise(F.col(score)))
    rows = current.select(F.lit("current").alias("population"), label, score)
    if mode != "resultados_realizados":
        rows = rows.union(reference.select(F.lit("reference"), label, score))
    by = evaluate(rows, ["population"], label, score)
    pick = lambda p, c: F.max(F.when(F.col("population") == p, F.col(c)))
    known = F.lit(recorded_auc).cast("double") if mode == "resultados_realizados" else pick("reference", "auc")
    one = by.agg(known.alias("auc_reference"), pick("current", "auc").alias("auc_current"), pick("current", "ks").alias("ks_current"))
    drop, alert = rules.auc_alert(F.col("auc_reference"), F.col("auc_current"))
    expected = EXPECTED_ALERT[mode]
    return one.select(F.lit(mode).alias("mode"), "*", drop.alias("auc_drop"), alert.alias("alert"), (F.lit(True) if expected is None else alert == expected).alias("as_expected"))


def concept_history(concept_: DataFrame, predicted: DataFrame, n_scoring: int | Column, at: Column) -> DataFrame:
    """The row of eleven columns that a run adds to the history of concept drift, from ``concept_report`` and the score's own drift."""
    both = rules.beside(concept_.select("mode", "auc_reference", "auc_current", "auc_drop", "ks_current", "alert"), predicted.select(F.col("psi").alias("prediction_psi"), F.col("psi_class").alias("prediction_class")))
    count = n_scoring if isinstance(n_scoring, Column) else F.lit(n_scoring).cast("long")
    return both.select(at.alias("run_at"), (F.col("mode") == "simulacao").alias("simulated"), "*", count.alias("n_scoring"))


def sensitivity(df: DataFrame, label: str, score: str, intensity: str) -> DataFrame:
    """AUC, drop against the rows of intensity 0, and alert for each intensity."""
    by = evaluate(df, [intensity], label, score).select(intensity, "auc")
    base = F.max(F.when(F.col(intensity) == 0, F.col("auc"))).over(Window.partitionBy())
    drop, alert = rules.auc_alert(base, F.col("auc"))
    return by.select(intensity, "auc", drop.alias("auc_drop"), alert.alias("alert"))
