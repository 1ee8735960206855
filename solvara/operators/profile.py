"""Data profiles, each from one aggregation over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvara.functions import rules
from solvara.operators.ranking import quantiles, running_totals
from solvara.storage import staged

#: Repeated digests up to this number are broadcast; more are joined by shuffle.
FEW_DIGESTS = 500_000
#: Rows that a full profile shows.
SAMPLE = 5


def _melted(row: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """One aggregated row with a struct for each column as a row for each column."""
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(c)[n].alias(n) for n in names]) for c in columns])
    return row.select(F.inline(items))


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls of each column, as number and per cent (0 on an empty table), worst first."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    one = df.agg(*[F.struct(F.lit(kinds[c]).alias("data_type"), F.count_if(F.col(c).isNull()).alias("n_null"), F.coalesce(F.round(F.try_divide(100 * F.count_if(F.col(c).isNull()), F.count("*")), 2), F.lit(0.0)).alias("pct_null")).alias(c) for c in columns])
    return _melted(one, columns, ["data_type", "n_null", "pct_null"]).orderBy(F.desc("n_null"), "column_name")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows, as number and per cent."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates"), F.coalesce(F.round(F.try_divide(100 * F.sum(F.col("__n") - 1), F.sum("__n")), 2), F.lit(0.0)).alias("pct_duplicates"))


def row_digest(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of a whole row; rows that group together have equal ones, be zero signed or not."""
    plain = [F.when(F.col(f"`{c}`") == 0, F.lit(0.0).cast(kind)).otherwise(F.col(f"`{c}`")) if kind in ("float", "double") else F.col(f"`{c}`") for c, kind in df.dtypes]
    return F.xxhash64(F.lit(1), *plain), F.xxhash64(F.lit(2), *plain, *[c.isNull() for c in plain])


def _suspects(df: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """``df`` with digests, the digests of several rows (staged), and whether these are few enough to be broadcast."""
    one, two = row_digest(df)
    rows = df.select("*", one.alias("__d1"), two.alias("__d2"))
    several = staged(rows.groupBy("__d1", "__d2").agg(F.count("*").alias("__n")).where("__n > 1").select("__d1", "__d2"))
    return rows, several, several.count() <= FEW_DIGESTS


def duplicate_rows_by_digest(df: DataFrame) -> DataFrame:
    """As ``duplicate_rows``, but whole rows are compared only where 128-bit digests repeat.

    What is shuffled is sixteen bytes a row, however wide the table; rows that share a digest are then grouped in full.
    """
    rows, several, few = _suspects(df)
    same = rows.join(F.broadcast(several) if few else several, ["__d1", "__d2"], "left_semi").select(df.columns)
    extra = duplicate_rows(same).select("n_duplicates")
    total = df.agg(F.count("*").alias("n"))
    return rules.beside(extra, total).select("n_duplicates", F.coalesce(F.round(F.try_divide(100 * F.col("n_duplicates"), F.col("n")), 2), F.lit(0.0)).alias("pct_duplicates"))


def distinct_rows_by_digest(df: DataFrame) -> DataFrame:
    """As ``distinct``, but only rows whose digests repeat are shuffled in full; the others pass where they lie."""
    rows, several, few = _suspects(df)
    side = F.broadcast(several) if few else several
    single = rows.join(side, ["__d1", "__d2"], "left_anti").select(df.columns)
    return single.union(rows.join(side, ["__d1", "__d2"], "left_semi").select(df.columns).distinct())


def duplicated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def cardinality(df: DataFrame, exact: bool = False) -> DataFrame:
    """Distinct values of each column; approximate unless ``exact``.

    Exact ones come from one count by column and value, so no row is copied for each column's own distinct count.
    """
    if not exact:
        one = df.agg(*[F.struct(F.approx_count_distinct(c).alias("n_distinct"), F.coalesce(F.round(F.try_divide(100 * F.approx_count_distinct(c), F.count("*")), 2), F.lit(0.0)).alias("pct_distinct")).alias(c) for c in df.columns])
        return _melted(one, df.columns, ["n_distinct", "pct_distinct"]).orderBy("n_distinct", "column_name")
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in df.columns])
    values = df.select(F.inline(items)).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    each = values.groupBy("column_name").agg(F.count("value").alias("n_distinct"), F.sum("n").alias("rows"))
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column_name string")
    whole = F.broadcast(names).join(each, "column_name", "left")  # a row a column, also on an empty table
    share = F.coalesce(F.round(F.try_divide(100 * F.col("n_distinct"), "rows"), 2), F.lit(0.0))
    return whole.select("column_name", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), share.alias("pct_distinct")).orderBy("n_distinct", "column_name")


def numeric_summary(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """Count, mean, deviation, least, quartiles and greatest of the columns that are present.

    Exact quartiles come from the cumulative frame of all columns' distinct values, ranged over tasks.
    """
    present = [c for c in columns if c in df.columns]
    names = ["n", "mean", "std", "min", "p25", "p50", "p75", "max"]

    def stats(c: str) -> Column:
        x = F.col(c).cast("double")
        quartiles = [] if exact else [F.percentile_approx(x, p, 10_000).alias(name) for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))]
        return F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), *quartiles, F.max(x).alias("max")).alias(c)

    one = df.agg(*map(stats, present))
    if not exact:
        return _melted(one, present, names)
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in present])
    counts = df.select(F.inline(items)).where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    cuts = quantiles(running_totals(counts, ["column_name"], "value", ["n"]), ["column_name"], "value", "n", [0.25, 0.5, 0.75])
    both = _melted(one, present, ["n", "mean", "std", "min", "max"]).join(F.broadcast(cuts), "column_name", "left")  # a row a column
    return both.withColumns({name: F.get("cuts", F.lit(i)) for i, name in enumerate(("p25", "p50", "p75"))}).select("column_name", *names)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and per cent by value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n_rows"))
    return counts.withColumn("pct", F.round(100 * F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()), 2))


def quality_flags(silver: DataFrame) -> DataFrame:
    return silver.agg(F.sum("is_monthly_income_null").alias("n_income_null"), F.sum("has_delinquency_outlier").alias("n_outlier"), F.count_if(F.col("age").isNull()).alias("n_age_quarantined"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Share of label 1, its weight (1 - p) / p, and rows without a label."""
    p = F.avg(label)
    return df.agg(p.alias("positive_rate"), F.try_divide(1 - p, p).alias("scale_pos_weight"), F.count_if(F.col(label).isNull()).alias("n_unlabelled"))


def full_profile(df: DataFrame, numeric: list[str], keys: list[str]) -> DataFrame:
    """All reports as (section, item, measure, value); a column's place is the value of its type.

    The section ``sample`` has the numbers of the five rows of least keys, the item being the row's place. The input is
    evaluated once and staged; reports read their columns of that. ``preview`` shows any rows.
    """
    df = staged(df)

    def rows(part: DataFrame, section: str, item: Column) -> DataFrame:
        values = [c for c, kind in part.dtypes if kind in ("bigint", "int", "double") and c not in keys]
        return part.select(F.lit(section).alias("section"), item.alias("item"), F.explode(F.create_map(*[x for c in values for x in (F.lit(c), F.col(c).cast("double"))])).alias("measure", "value"))

    types = df.sparkSession.createDataFrame([(c, kind, float(i)) for i, (c, kind) in enumerate(df.dtypes, 1)], "item string, measure string, value double")
    table = df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
    first = df.orderBy(*keys).limit(SAMPLE).withColumn("__at", F.row_number().over(Window.orderBy(*keys)).cast("string"))
    numbers = [c for c, kind in df.dtypes if kind in ("bigint", "int", "double")]
    values = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in numbers])
    parts = [
        first.select(F.lit("sample").alias("section"), F.col("__at").alias("item"), F.inline(values)),
        rows(table, "table", F.lit("")),
        types.select(F.lit("schema").alias("section"), "item", "measure", "value"),
        rows(completeness(df), "nulls", F.col("column_name")),
        rows(cardinality(df, exact=True), "cardinality", F.col("column_name")),
        rows(numeric_summary(df, numeric, exact=True), "numeric", F.col("column_name")),
        rows(duplicated_keys(df, keys).agg(F.count("*").alias("n_keys")), "duplicate_keys", F.lit(",".join(keys))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """Any few rows."""
    return df.limit(rows)
