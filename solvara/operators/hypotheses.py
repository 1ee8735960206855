"""The four business hypotheses as one report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.operators import models, thresholds
from solvara.sources import tables

#: What each hypothesis says, and what its test leaves open.
TEXTS = {
    "H1": ("A higher use of credit lines goes with a higher risk of default", "an association in the model, not a cause"),
    "H2": ("The debt ratio weighs more in the model than age", "one demographic feature stands for all"),
    "H3": ("Some threshold lowers the default rate at an acceptable approval rate", "one period only; thresholds may not last"),
    "H4": ("Rejecting at that threshold saves more than it forgoes", "loss and margin are assumed amounts"),
}


def summary(df: DataFrame, attributions: DataFrame, label: str, score: str, first: str = "revolving_utilization", pair: tuple[str, str] = ("debt_ratio", "age"), floor: float = 0.70) -> DataFrame:
    """(hypothesis, description, metric, status, value, evidence, limitation): rank correlation of a feature with its
    attribution, relative importance of two features, default reduction at the best viable threshold, net impact there."""

    def row(part: DataFrame, name: str, metric: str, status, value: str, evidence) -> DataFrame:
        about, limit = TEXTS[name]
        return part.select(F.lit(name).alias("hypothesis"), F.lit(about).alias("description"), F.lit(metric).alias("metric"), status.alias("status"), F.col(value).cast("double").alias("value"), evidence.alias("evidence"), F.lit(limit).alias("limitation"))

    rho = models.validated_feature(attributions, first)
    h1 = row(rho, "H1", "spearman", F.col("status"), "spearman", F.format_string("rho = %.3f, rank %d", "spearman", "rank"))
    diff = models.relative_difference(models.importance(attributions), *pair)
    h2 = row(diff, "H2", "relative_difference", F.col("status"), "difference", F.format_string("diff = %.3f", "difference"))
    best = thresholds.best_viable(thresholds.approval_sweep(df, label, score), floor)
    h3 = row(best, "H3", "default_reduction", F.col("status"), "reduction", F.format_string("threshold = %.2f", "threshold"))
    net = thresholds.net_impact(df, label, score, best)
    h4 = row(net, "H4", "net_impact", F.col("status"), "net", F.format_string("bads = %d, goods = %d", "bads_rejected", "goods_rejected"))
    return h1.union(h2).union(h3).union(h4)


def persist(report: DataFrame, database: str, table: str = "hypotheses_summary", location: str | None = None) -> DataFrame:
    """Write the report as a table of a database, in place of an earlier one, and return it as it reads there."""
    tables.ensure_database(report.sparkSession, database, location)
    tables.overwrite(report, f"{database}.{table}")
    tables.assert_rows(report.sparkSession.table(f"{database}.{table}"), "the hypotheses report")
    return report.sparkSession.table(f"{database}.{table}")
