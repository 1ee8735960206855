"""Fairness by age and income band: error rates of both kinds, intervals and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvara.functions import rules
from solvara.operators.ranking import quantiles, running_totals


def income_edges(df: DataFrame, income: str, bands: int = 5) -> DataFrame:
    """One row: the distinct quantile edges of the stated incomes."""
    stated = df.where(F.col(income).isNotNull()).groupBy(F.lit(1).alias("__all"), income).agg(F.count("*").alias("n"))
    cuts = quantiles(running_totals(stated, ["__all"], income, ["n"]), ["__all"], income, "n", [i / bands for i in range(bands + 1)])
    return cuts.select(F.array_distinct("cuts").alias("edges"))


def with_income_band(df: DataFrame, income: str, bands: int = 5) -> DataFrame:
    """Add ``income_band`` and ``income_order``: quantile bands closed on the right, the lowest value included; nulls are a band of their own."""
    rows = rules.beside(df, income_edges(df, income, bands))  # one row of bands + 1 numbers, or none
    x, edges = F.col(income), F.col("edges")
    n = F.greatest(F.size(edges) - 1, F.lit(1))
    order = 1 + F.size(F.filter(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), lambda e: x > e))
    name = F.concat(F.lit("Q"), order.cast("string"), F.when(n == 1, "").when(order == 1, " (menor)").when(order == n, " (maior)").otherwise(""))
    return rows.withColumns({"income_band": F.when(x.isNull(), rules.NOT_STATED).otherwise(name), "income_order": F.when(x.isNull(), n + 1).otherwise(order)}).drop("edges")


def with_bands(df: DataFrame, age: str = "age", income: str = "monthly_income") -> DataFrame:
    return with_income_band(df.withColumn("age_band", rules.age_band(F.col(age))), income)


def group_metrics(df: DataFrame, label: str, score: str, threshold: float, dimensions: dict[str, str]) -> DataFrame:
    """Metrics for each band of each dimension (name -> band column) in one aggregation over the long frame.

    Denied goods are the central rate; they are significantly high where their interval lies above the overall rate.
    """
    rows = df.where(F.col(label).isNotNull()).select((F.col(score) >= threshold).alias("deny"), F.col(label).alias("y"), F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("band")) for d, c in dimensions.items()])))
    counts = rows.groupBy("dimension", "band").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 0).alias("goods"), F.count_if(F.col("y") == 1).alias("bads"), F.count_if((F.col("y") == 0) & F.col("deny")).alias("fp"), F.count_if((F.col("y") == 1) & ~F.col("deny")).alias("fn"))
    whole = Window.partitionBy("dimension")
    low, high = rules.wilson(F.col("fp"), F.col("goods"))
    rated = counts.withColumns({
        "default_rate": F.col("bads") / F.col("n"),
        "approval_rate": (F.col("goods") - F.col("fp") + F.col("fn")) / F.col("n"),
        "goods_denied": F.try_divide("fp", "goods"),
        "ci_low": low,
        "ci_high": high,
        "bads_approved": F.try_divide("fn", "bads"),
        "small_sample": F.col("goods") < rules.MIN_GOODS,
        "overall": F.try_divide(F.sum("fp").over(whole), F.sum("goods").over(whole)),
    })
    return rated.withColumns({"approval_ratio": F.try_divide("approval_rate", F.max("approval_rate").over(whole)), "above_average": F.coalesce(F.col("ci_low") > F.col("overall"), F.lit(False))}).drop("overall")


def alerts(metrics: DataFrame) -> DataFrame:
    """A row for each band and rule that it breaks: four fifths of the best approval, denied goods above the overall rate."""
    note = F.when(F.col("small_sample"), " (few rows)").otherwise("")
    pct = lambda c: F.concat(F.format_number(100 * F.col(c), 1), F.lit("%"))
    ratio = F.when(F.col("approval_ratio") < rules.FOUR_FIFTHS, F.struct(F.lit("four_fifths").alias("rule"), F.concat(F.lit("approves "), pct("approval_rate"), F.lit(", a ratio of "), F.format_number("approval_ratio", 2), F.lit(" to the best band"), note).alias("message")))
    above = F.when(F.col("above_average"), F.struct(F.lit("goods_denied").alias("rule"), F.concat(F.lit("denies "), pct("goods_denied"), F.lit(" of good payers, more than all bands together"), note).alias("message")))
    return metrics.select("dimension", "band", F.inline(F.array_compact(F.array(ratio, above))))
