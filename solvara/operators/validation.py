"""The figures of a validation run as rows of a metrics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvara.functions import rules
from solvara.operators import fairness, models, thresholds


def run_metrics(df: DataFrame, run: str, label: str, score: str, calibrated: str, dimensions: dict[str, str], at: Column, threshold: float = rules.THRESHOLD) -> DataFrame:
    """(run, run_at, kind, metric, value): five parameters and ten metrics of a scored, labelled portfolio.

    ``calibrated`` is the calibrated score's column, ``dimensions`` names the band columns that alerts look at.
    """
    floor = thresholds.cost_of_floor(df, label, score, threshold)
    money = thresholds.financial_impact(df, label, score, threshold)
    alerts = fairness.alerts(fairness.group_metrics(df, label, score, threshold, dimensions)).agg(F.count("*").alias("alerts"))
    kinds = F.array(F.struct(F.lit("raw").alias("kind"), F.col(score).alias("p")), F.struct(F.lit("calibrated").alias("kind"), F.col(calibrated).alias("p")))
    fit = models.calibration(df.select(label, F.inline(kinds)), ["kind"], label, "p")[0]
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{c}_{kind}")
    fits = fit.agg(*[pick(kind, c) for kind in ("raw", "calibrated") for c in ("brier", "mean_error")])
    one = rules.beside(rules.beside(rules.beside(floor, money.drop("approval_rate")), alerts), fits)
    params = {"operating_threshold": F.col("operating_threshold"), "min_cost_threshold": F.col("min_threshold"), "loss": F.lit(rules.LOSS), "margin": F.lit(rules.MARGIN), "approval_ratio_limit": F.lit(rules.FOUR_FIFTHS)}
    metrics = {
        "cost_of_floor": F.col("cost_of_floor"), "net_impact": F.col("net"), "break_even_ratio": F.col("break_even_ratio"),
        "default_without_model": F.col("default_before"), "default_with_model": F.col("default_after"), "n_alerts": F.col("alerts"),
        "brier_raw": F.col("brier_raw"), "brier_calibrated": F.col("brier_calibrated"),
        "calibration_error_raw": F.col("mean_error_raw"), "calibration_error_calibrated": F.col("mean_error_calibrated"),
    }
    rows = [F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("metric"), value.cast("double").alias("value")) for kind, part in (("parameter", params), ("metric", metrics)) for name, value in part.items()]
    return one.select(F.lit(run).alias("run"), at.alias("run_at"), F.inline(F.array(*rows)))
