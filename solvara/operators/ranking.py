"""Ranking metrics from one cumulative frame, for any number of models or groups at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvara.storage import staged


def running_totals(counts: DataFrame, by: list[str], order: str, sums: list[str]) -> DataFrame:
    """Add before_<s> and total_<s> for each of ``sums``: what comes before a row by ``order`` in its group, and in all of it.

    ``counts`` has one row for each group and value. Rows are ranged by group and value and staged; totals of each range
    (a row for each range and group) give the offsets, so a group's running sum never needs one task.
    """
    ranged = staged(counts.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy(*by, "__part").agg(*[F.sum(s).alias(s) for s in sums])
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*by, "__part", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"__off_{s}") for s in sums], *[F.sum(s).over(Window.partitionBy(*by)).alias(f"total_{s}") for s in sums])
    inside = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"__in_{s}") for s in sums])
    out = own.join(F.broadcast(offsets), [*by, "__part"])  # a row for each group and range
    return out.select(*counts.columns, *[(F.col(f"__in_{s}") + F.col(f"__off_{s}")).alias(f"before_{s}") for s in sums], *[f"total_{s}" for s in sums])


def score_counts(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Good and bad rows by group and distinct score, with running totals. Rows without label or score take no part."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = rows.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return running_totals(counts, by, "score", ["pos", "neg"])


def evaluate(df: DataFrame, by: list[str], label: str, score: str, precision: float = 0.30) -> DataFrame:
    """AUC (ties count half), KS, and the best recall at a precision of ``precision`` or more (0 if none), by group."""
    frame = score_counts(df, by, label, score)
    up_pos, up_neg = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    taken_pos, taken = F.col("total_pos") - F.col("before_pos"), F.col("total_pos") + F.col("total_neg") - F.col("before_pos") - F.col("before_neg")
    gap = F.abs(F.try_divide(up_pos, "total_pos") - F.try_divide(up_neg, "total_neg"))
    good = F.when(taken_pos / taken >= precision, F.try_divide(taken_pos, "total_pos"))
    return frame.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * (2 * F.col("before_neg") + F.col("neg"))), 2 * F.first("total_pos") * F.first("total_neg")).alias("auc"),
        F.max(gap).alias("ks"),
        F.coalesce(F.max(good), F.lit(0.0)).alias("recall_at_precision"),
        F.first("total_pos").alias("n_pos"),
        F.first("total_neg").alias("n_neg"),
    )


def winner(metrics: DataFrame, simple: str, complex_: str, tie: float = 0.005) -> DataFrame:
    """The interpretable model if the AUCs differ by less than ``tie``, else the better."""
    one = metrics.agg(F.max(F.when(F.col("model") == simple, F.col("auc"))).alias("auc_simple"), F.max(F.when(F.col("model") == complex_, F.col("auc"))).alias("auc_complex"))
    pick = F.when(F.abs(F.col("auc_complex") - F.col("auc_simple")) < tie, simple).when(F.col("auc_complex") > F.col("auc_simple"), complex_).otherwise(simple)
    return one.withColumn("winner", pick)


def champion(versions: DataFrame) -> DataFrame:
    """The version in charge after all challenges: a challenger must have a strictly greater AUC, so the first of equals stays."""
    return versions.agg(F.max_by("version", F.struct("auc", -F.col("version"))).alias("version"), F.max("auc").alias("auc"))


def reconciled(recomputed: DataFrame, recorded: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Recomputed against recorded AUC by model; a missing record doesn't pass."""
    both = recomputed.select("model", "auc").join(recorded.select("model", F.col("auc").alias("recorded")), "model", "left")
    return both.withColumn("passes", F.coalesce(F.abs(F.col("auc") - F.col("recorded")) <= tolerance, F.lit(False)))


def lowest_fraction(df: DataFrame, by: list[str], score: str, key: str, rate: float) -> DataFrame:
    """Add ``approved``: whether a row is among the round(rate * n) lowest scores of its group, ties by ``key``.

    The score at the cut comes from the cumulative frame of distinct scores; only rows at it are ranked by key, again by
    a cumulative frame, so that no group is sorted in one task. These are staged: where they are few, as their size tells,
    the rows themselves aren't shuffled. Rounding is half to even.
    """
    narrow = staged(df.select(*by, F.col(score).alias("__score"), F.col(key).alias("__key")))  # what places are decided by
    counts = narrow.groupBy(*by, "__score").agg(F.count("*").alias("n"))
    frame = running_totals(counts, by, "__score", ["n"])
    need = F.bround(F.lit(rate) * F.col("total_n"), 0).cast("long")
    cut = staged(frame.where((F.col("before_n") < need) & (F.col("before_n") + F.col("n") >= need)).select(*by, F.col("__score").alias("__cut"), (need - F.col("before_n")).alias("__left")))
    marked = df.join(F.broadcast(cut), by, "left")  # a row a group
    at = narrow.join(F.broadcast(cut), by).where(F.col("__score") == F.col("__cut"))
    keys = staged(running_totals(at.groupBy(*by, "__key").agg(F.count("*").alias("m")), by, "__key", ["m"]).select(*by, F.col("__key").alias(key), (F.col("before_m") + 1).alias("__place")))
    placed = marked.join(keys, [*by, key], "left")
    inside = (F.col(score) < F.col("__cut")) | ((F.col(score) == F.col("__cut")) & (F.col("__place") <= F.col("__left")))
    return placed.withColumn("approved", F.coalesce(inside, F.lit(False))).select(*df.columns, "approved")


def equal_approval(df: DataFrame, by: list[str], label: str, score: str, key: str, rate: float) -> DataFrame:
    """At one approval rate for all groups: default rate among the approved, bads and goods rejected."""
    rows = lowest_fraction(staged(df.select(*by, label, score, key)), by, score, key, rate)
    return rows.groupBy(*by).agg(
        F.avg(F.when(F.col("approved"), F.col(label))).alias("default_approved"),
        F.count_if(~F.col("approved") & (F.col(label) == 1)).alias("bads_rejected"),
        F.count_if(~F.col("approved") & (F.col(label) == 0)).alias("goods_rejected"),
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; rows with a null or NaN in either take no part."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    weighted = staged(rows.groupBy("x", "y").agg(F.count("*").alias("w")))

    def ranks(c: str) -> DataFrame:
        counts = weighted.groupBy(F.lit(1).alias("__all"), F.col(c)).agg(F.sum("w").alias("n"))
        return running_totals(counts, ["__all"], c, ["n"]).select(c, (F.col("before_n") + (F.col("n") + 1) / 2).alias(f"r{c}"))

    pairs = weighted.join(ranks("x"), "x").join(ranks("y"), "y")
    w, a, b = F.col("w"), F.col("rx"), F.col("ry")
    sums = pairs.agg(F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * b).alias("sab"), F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"))
    return sums.selectExpr("try_divide(n * sab - sa * sb, sqrt(n * saa - sa * sa) * sqrt(n * sbb - sb * sb)) AS spearman", "n")


def quantiles(frame: DataFrame, by: list[str], value: str, n: str, shares: list[float]) -> DataFrame:
    """Linear-interpolated quantiles by group, as (by, cuts: array in the order of ``shares``).

    ``frame`` comes from running_totals over counts ``n``; only the rows that hold a wanted rank go on, told by plain
    comparisons, so that no other row gets a list of ranks.
    """
    ranks, holds = [], F.lit(False)
    first, end = F.col(f"before_{n}"), F.col(f"before_{n}") + F.col(n)
    for i, q in enumerate(shares):
        at = F.lit(q) * (F.col(f"total_{n}") - 1)
        holds = holds | ((at > first - 1) & (at < end))  # the rank below or above is one of the row's
        ranks += [F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), to(at).cast("long").alias("rank"), (at - F.floor(at)).alias("part")) for side, to in (("lo", F.floor), ("hi", F.ceil))]
    held = frame.where(holds).select(*by, value, F.inline(F.filter(F.array(*ranks), lambda r: (r.rank >= first) & (r.rank < end))))
    lo, hi = (F.max(F.when(F.col("side") == s, F.col(value))) for s in ("lo", "hi"))
    each = held.groupBy(*by, "i").agg((lo + (hi - lo) * F.max("part")).alias("cut"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "cut"))), lambda s: s.cut).alias("cuts"))
