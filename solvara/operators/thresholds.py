"""Threshold sweeps on a grid: scores are counted once by grid cell, thresholds are cumulative sums over the cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvara.functions import rules

COST_GRID = [round(i / 100, 2) for i in range(1, 100)]
FLOOR_GRID = [round(i / 20, 2) for i in range(1, 19)]


def confusion(label: str, score: Column, threshold: float) -> list[Column]:
    """tn, fp, fn, tp of denying from the threshold on."""
    y, deny = F.col(label), score >= threshold
    return [F.count_if((y == 0) & ~deny).alias("tn"), F.count_if((y == 0) & deny).alias("fp"), F.count_if((y == 1) & ~deny).alias("fn"), F.count_if((y == 1) & deny).alias("tp")]


def with_cost(df: DataFrame, margin: float = rules.MARGIN, loss: float = rules.LOSS) -> DataFrame:
    """Cost of denied goods and approved bads, and the approval rate, of a frame with tn, fp, fn, tp."""
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return df.withColumns({"total_cost": F.col("fp") * F.lit(margin) + F.col("fn") * F.lit(loss), "approval_rate": F.try_divide(F.col("tn") + F.col("fn"), n)})


def sweep(df: DataFrame, label: str, score: str, grid: list[float]) -> DataFrame:
    """Confusion counts at each threshold of the grid.

    A score's cell is the number of thresholds it reaches, so the only shuffle is of a count a cell; a row is denied at
    the thresholds up to its cell. The window runs over those few cells.
    """
    steps = F.array(*[F.lit(t) for t in grid])
    cell = F.size(F.filter(steps, lambda t: t <= F.col(score)))
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(cell.alias("cell")).agg(F.count_if(F.col(label) == 0).alias("good"), F.count_if(F.col(label) == 1).alias("bad"))
    cells = df.sparkSession.createDataFrame([(i, grid[i - 1] if i else None) for i in range(len(grid) + 1)], "cell int, threshold double")
    full = F.broadcast(cells).join(counts, "cell", "left").fillna(0, ["good", "bad"])
    above = Window.orderBy("cell").rowsBetween(0, Window.unboundedFollowing)
    below = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    out = full.withColumns({
        "tn": F.coalesce(F.sum("good").over(below), F.lit(0)),
        "fp": F.sum("good").over(above),
        "fn": F.coalesce(F.sum("bad").over(below), F.lit(0)),
        "tp": F.sum("bad").over(above),
    })
    return out.where("cell > 0").select("threshold", "tn", "fp", "fn", "tp")


def cost_sweep(df: DataFrame, label: str, score: str, margin: float = rules.MARGIN, loss: float = rules.LOSS) -> DataFrame:
    """Cost and approval rate at 0.01 to 0.99, in order of threshold."""
    return with_cost(sweep(df, label, score, COST_GRID), margin, loss).orderBy("threshold")


def cheapest(costs: DataFrame) -> DataFrame:
    """The threshold of least cost, the lowest of equals."""
    return costs.agg(F.min(F.struct("total_cost", "threshold", "approval_rate")).alias("r")).select("r.threshold", "r.total_cost", "r.approval_rate")


def cost_of_floor(df: DataFrame, label: str, score: str, operating: float = rules.THRESHOLD) -> DataFrame:
    """Cheapest and operating threshold side by side, and what the latter costs more."""
    best = cheapest(cost_sweep(df, label, score)).toDF("min_threshold", "min_cost", "min_approval")
    now = with_cost(df.where(F.col(label).isNotNull()).agg(*confusion(label, F.col(score), operating)))
    named = now.select(F.lit(operating).alias("operating_threshold"), F.col("total_cost").alias("operating_cost"), F.col("approval_rate").alias("operating_approval"))
    return rules.beside(best, named).withColumn("cost_of_floor", F.col("operating_cost") - F.col("min_cost"))


def approval_sweep(df: DataFrame, label: str, score: str) -> DataFrame:
    """Approval rate, default rate among the approved (null if none) and overall, at 0.05 to 0.90."""
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return sweep(df, label, score, FLOOR_GRID).select("threshold", F.try_divide(F.col("tn") + F.col("fn"), n).alias("approval_rate"), F.try_divide(F.col("fn"), F.col("tn") + F.col("fn")).alias("default_rate"), F.try_divide(F.col("fn") + F.col("tp"), n).alias("base_rate"))


def best_viable(swept: DataFrame, floor: float = rules.APPROVAL_FLOOR) -> DataFrame:
    """Of the thresholds that approve enough, the one of lowest default rate, the first of equals; one row, nulls if there is none."""
    ok = swept.where((F.col("approval_rate") >= floor) & F.col("default_rate").isNotNull())
    row = ok.agg(F.min(F.struct("default_rate", "threshold", "approval_rate", "base_rate")).alias("r"))
    drop = F.col("r.base_rate") - F.col("r.default_rate")
    status = F.when(F.col("r").isNull(), "inconclusiva").when(drop > 0, "confirmada").otherwise("refutada")
    return row.select("r.threshold", "r.approval_rate", "r.default_rate", "r.base_rate", drop.alias("reduction"), status.alias("status"))


def net_impact(df: DataFrame, label: str, score: str, chosen: DataFrame, margin: float = rules.MARGIN, loss: float = rules.LOSS) -> DataFrame:
    """Loss avoided and margin lost at the chosen threshold of the approval grid, a frame of one row; no row without a threshold."""
    at = sweep(df, label, score, FLOOR_GRID).join(F.broadcast(chosen.select("threshold")), "threshold")
    out = at.select("threshold", F.col("tp").alias("bads_rejected"), F.col("fp").alias("goods_rejected"), (F.col("tp") * F.lit(loss) - F.col("fp") * F.lit(margin)).alias("net"))
    return out.withColumn("status", F.when(F.col("net") > 0, "confirmada").otherwise("refutada"))


def financial_impact(df: DataFrame, label: str, score: str, threshold: float = rules.THRESHOLD, margin: float = rules.MARGIN, loss: float = rules.LOSS) -> DataFrame:
    """Portfolio before and after the threshold, in one aggregation."""
    one = df.where(F.col(label).isNotNull()).agg(*confusion(label, F.col(score), threshold))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return one.select(
        n.alias("n"),
        F.try_divide(F.col("tn") + F.col("fn"), n).alias("approval_rate"),
        F.try_divide(F.col("fn") + F.col("tp"), n).alias("default_before"),
        F.try_divide(F.col("fn"), F.col("tn") + F.col("fn")).alias("default_after"),
        F.col("tp").alias("bads_rejected"),
        F.col("fp").alias("goods_rejected"),
        (F.col("tp") * F.lit(loss)).alias("avoided_loss"),
        (F.col("fp") * F.lit(margin)).alias("opportunity_cost"),
        (F.col("tp") * F.lit(loss) - F.col("fp") * F.lit(margin)).alias("net"),
        F.try_divide(F.col("fp"), F.col("tp")).alias("break_even_ratio"),
    )
