"""Column profiles from sketches stored by day: a grown table is profiled by reading its new days alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvara.sources import tables

#: Size of the distinct-count sketch (2^12 registers: 1.6 % standard error) and of the quantile sketch (rank error about 1.3 % at 200).
DISTINCT_SIZE, QUANTILE_SIZE = 12, 200
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def sketched(df: DataFrame) -> DataFrame:
    """A row a column, from one aggregation: exact counts, mean and squared deviations, extremes, and the two sketches.

    Columns that aren't numbers have counts and distinct values alone. Nulls and NaNs are in no sketch; NaNs count as null.
    """
    kinds = {c: kind.split("(")[0] for c, kind in df.dtypes}

    def one(c: str):
        number = kinds[c] in NUMBERS
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) if number else F.lit(None).cast("double")
        key = x if number and kinds[c] in ("float", "double") else F.col(c)
        quantiles = F.kll_sketch_agg_double(x, QUANTILE_SIZE) if number else F.lit(None).cast("binary")
        return F.struct(
            F.lit(c).alias("column_name"), F.count("*").alias("n_rows"), F.count(key).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("squares"), F.min(x).alias("min"), F.max(x).alias("max"),
            F.hll_sketch_agg(key.cast("string"), DISTINCT_SIZE).alias("distinct"), quantiles.alias("quantiles"),
        ).alias(c)

    return df.agg(*map(one, df.columns)).select(F.inline(F.array(*[F.col(f"`{c}`") for c in df.columns])))


def store_day(df: DataFrame, path: str, day: str) -> bool:
    """Add a day's rows to the stored sketches, once: a day that is there stays, whatever comes. True if it was added."""
    return tables.append_once(sketched(df), path, day)


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The profile of all stored days: (column_name, n, n_null, n_distinct, mean, std, min, p25, p50, p75, max).

    Counts, mean, deviation and extremes are exact; distinct values and quartiles are the merged sketches' estimates.
    """
    rows = spark.read.parquet(path)
    total = F.sum("n")
    mean = F.sum(F.col("mean") * F.col("n")) / total
    both = rows.groupBy("column_name").agg(
        total.alias("n"), (F.sum("n_rows") - total).alias("n_null"), mean.alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"),
        (F.sum("squares") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.sum(F.col("n") * F.col("mean")) * mean).alias("squares"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"),
    )
    middle = rows.where("quantiles is not null and n > 0").groupBy("column_name").agg(F.kll_merge_agg_double("quantiles").alias("q"))
    middle = middle.select("column_name", *[F.kll_sketch_get_quantile_double("q", F.lit(share)).alias(name) for name, share in QUARTILES.items()])
    deviation = F.when(F.col("n") > 1, F.sqrt(F.greatest("squares", F.lit(0.0)) / (F.col("n") - 1))).alias("std")
    return both.join(F.broadcast(middle), "column_name", "left").select("column_name", "n", "n_null", "n_distinct", "mean", deviation, "min", *QUARTILES, "max")  # a row a column
