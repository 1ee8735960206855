"""Streaming jobs over landing files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvara.sources.portfolio import portfolio, raw_profiles
from solvara.storage import shared_dir, staged
from solvara.streaming import ingest, keyed

#: Ids of the tables are long.
RAW = T.StructType([T.StructField("_c0", T.LongType()), *ingest.RAW_SCHEMA.fields[1:]])
BRONZE = T.StructType([*RAW.fields, *ingest.BRONZE_SCHEMA.fields[len(RAW.fields) :]])


def landing(spark: SparkSession, folder: str, path: str, again: bool = False) -> None:
    """The portfolio as raw CSV files in ``path``; with ``again`` every tenth row once more, with a greater debt ratio."""
    rows = raw_profiles(spark, folder)
    if again:
        rows = rows.where("_c0 % 10 = 0").withColumn("DebtRatio", F.col("DebtRatio") + 1)
    rows.select([f.name for f in RAW.fields]).write.mode("append").option("header", True).option("nullValue", "NA").csv(path)


def bronze(spark: SparkSession, folder: str) -> DataFrame:
    """Ingest, and ingest again without new files: the rows by label."""
    path, out = shared_dir(spark) + "/landing", shared_dir(spark)
    landing(spark, folder, path)
    for _ in range(2):
        ingest.run_bronze(spark, path, f"{out}/bronze", f"{out}/checkpoint", schema=RAW)
    return spark.read.schema(BRONZE).parquet(f"{out}/bronze").groupBy("SeriousDlqin2yrs").agg(F.count("*").alias("n_rows"), F.count("MonthlyIncome").alias("n_income"))


def silver(spark: SparkSession, folder: str) -> DataFrame:
    """Both hops, then again after changed rows have landed: of a key the row that came last stays."""
    path, out = shared_dir(spark) + "/landing", shared_dir(spark)
    for again in (False, True):
        landing(spark, folder, path, again)
        ingest.run_bronze(spark, path, f"{out}/bronze", f"{out}/c1", schema=RAW)
        rows = ingest.run_silver(spark, f"{out}/bronze", f"{out}/silver", f"{out}/c2", schema=BRONZE)
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """The star schema of the streamed rows, joined."""
    rows = silver(spark, folder)
    dim, fct = ingest.run_gold(rows.where("target_default_2yrs is not null"), rows.where("target_default_2yrs is null").drop("target_default_2yrs"))
    return fct.join(dim, "customer_id").select("customer_id", "age", "monthly_income", "debt_ratio", "total_delinquency_events", "target_dlq_2yrs")


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches, a restart after each: all rows, later ones of every tenth customer, then older ones of every fifth."""
    path, out = shared_dir(spark) + "/landing", shared_dir(spark)
    rows = portfolio(spark, folder).select("customer_id", "debt_ratio")
    rows.withColumn("updated_at", F.current_timestamp()).where("false").write.parquet(path)
    stream = spark.readStream.schema("customer_id long, debt_ratio double, updated_at timestamp").parquet(path)
    for add, every, day in ((0, 1, 1), (1, 10, 3), (2, 5, 2)):
        rows.where(F.col("customer_id") % every == 0).select("customer_id", F.col("debt_ratio") + add, F.lit(f"2024-01-0{day}").cast("timestamp")).toDF("customer_id", "debt_ratio", "updated_at").write.mode("append").parquet(path)
        keyed.keep_newest(stream, keyed.KeyedTable(spark, f"{out}/table"), "updated_at", f"{out}/checkpoint").awaitTermination()
    return keyed.KeyedTable(spark, f"{out}/table").read().select("customer_id", "debt_ratio", F.dayofmonth("updated_at").alias("day"))


def outcomes(spark: SparkSession, folder: str, predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions (customer_id, probability) and labels (customer_id, target_dlq_2yrs) as two streams, joined as labels become known.

    Labels come up to 60 days after the prediction, and a restart after it.
    """
    path, out = shared_dir(spark), shared_dir(spark)
    start, key = F.lit("2024-01-01").cast("timestamp"), F.col("customer_id")
    predicted = start + F.make_dt_interval(days=(key % 5).cast("int"))
    known = predicted + F.make_dt_interval(days=(key % 61).cast("int"))
    sides = [
        (predictions.select("customer_id", F.col("probability").alias("score"), predicted.alias("predicted_at")), f"{path}/predictions", "customer_id long, score double, predicted_at timestamp"),
        (labels.select("customer_id", "target_dlq_2yrs", known.alias("known_at")), f"{path}/outcomes", "customer_id long, target_dlq_2yrs int, known_at timestamp"),
    ]
    for rows, at, _ in sides:
        rows.where("false").write.parquet(at)
    p, o = (spark.readStream.schema(schema).parquet(at) for _, at, schema in sides)
    joined = keyed.realised_stream(p, o, "customer_id", "predicted_at", "known_at", "90 DAYS", "10 days")
    for rows, at, _ in sides:
        rows.write.mode("append").parquet(at)
        keyed.append_stream(joined, f"{out}/realised", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/realised")


def drifted(spark: SparkSession, profile: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows as the one batch of a stream, held against a profile; a second run finds nothing new."""
    out, held = shared_dir(spark), staged(profile)
    rows.write.parquet(f"{out}/rows")
    stream = spark.readStream.schema(rows.schema).parquet(f"{out}/rows")
    for _ in range(2):
        keyed.drift_stream(stream, held, f"{out}/history", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/history").select("batch", "feature", "psi", "psi_class", "n_ref", "n_cur")
