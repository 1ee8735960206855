"""Column rules: decisions, bands, intervals, drift classes. Every boundary convention stands here once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Business parameters: loss of an approved bad payer, margin lost with a denied good one, operating threshold, least
#: approval rate, and the bounds of the fairness and drift alerts.
LOSS, MARGIN, THRESHOLD, APPROVAL_FLOOR = 15000.0, 1500.0, 0.45, 0.70
MIN_GOODS, FOUR_FIFTHS, Z_95 = 100, 0.80, 1.96
PSI_MODERATE, PSI_SEVERE, AUC_DROP = 0.10, 0.25, 0.03

NOT_STATED = "não informada"
AGE_BANDS = ["18-30", "31-40", "41-50", "51-60", "60+"]


def decision(p: Column, threshold: float = THRESHOLD) -> Column:
    """``negado`` from the threshold on, else ``aprovado``; a probability outside 0 to 1 is an error."""
    bad = F.raise_error(F.concat(F.lit("probability outside 0 to 1: "), p.cast("string")))
    return F.when(~p.between(0, 1), bad).when(p >= threshold, "negado").otherwise("aprovado")


def age_band(age: Column) -> Column:
    """18-30, 31-40, 41-50, 51-60, 60+, each with its upper end; younger than 18 and nulls are not stated."""
    return (
        F.when(age.isNull() | (age < 18), NOT_STATED)
        .when(age <= 30, AGE_BANDS[0]).when(age <= 40, AGE_BANDS[1]).when(age <= 50, AGE_BANDS[2]).when(age <= 60, AGE_BANDS[3])
        .otherwise(AGE_BANDS[4])
    )


def wilson(successes: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Both ends of Wilson's interval for a share; null without cases."""
    p, zz = F.try_divide(successes, n), z * z
    centre = (p + F.try_divide(F.lit(zz), 2 * n)) / (1 + F.try_divide(F.lit(zz), n))
    margin = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + F.try_divide(F.lit(zz), n))
    ok = n > 0
    return F.when(ok, centre - margin), F.when(ok, centre + margin)


def psi_class(psi: Column, moderate: float = PSI_MODERATE, severe: float = PSI_SEVERE) -> Column:
    """``indefinido`` for null or NaN, ``SEVERO``, ``moderado`` or ``estavel``."""
    return F.when(psi.isNull() | F.isnan(psi), "indefinido").when(psi >= severe, "SEVERO").when(psi >= moderate, "moderado").otherwise("estavel")


def auc_alert(reference: Column, current: Column, limit: float = AUC_DROP) -> tuple[Column, Column]:
    """The drop of the AUC, negative where it rose, and whether it reaches the limit."""
    return reference - current, (reference - current) >= limit


def beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of ``row``, a frame of at most one aggregated row; without it they are null."""
    key = F.lit(1).alias("__one")
    return df.select("*", key).join(F.broadcast(row.select("*", key)), "__one", "left").drop("__one")
