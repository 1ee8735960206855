"""Incremental ingestion: CSV files to an append-only raw table, that to one current row per key, that to the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from solvara.operators import clean, star
from solvara.sources.landing import dataset_of
from solvara.sources.tables import assert_rows
from solvara.streaming.keyed import KeyedTable

# The public raw file's columns by position; its first header cell is empty.
RAW_SCHEMA = T.StructType([
    T.StructField("_c0", T.IntegerType()),
    T.StructField("SeriousDlqin2yrs", T.IntegerType()),
    T.StructField("RevolvingUtilizationOfUnsecuredLines", T.DoubleType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("NumberOfTime30-59DaysPastDueNotWorse", T.IntegerType()),
    T.StructField("DebtRatio", T.DoubleType()),
    T.StructField("MonthlyIncome", T.DoubleType()),
    T.StructField("NumberOfOpenCreditLinesAndLoans", T.IntegerType()),
    T.StructField("NumberOfTimes90DaysLate", T.IntegerType()),
    T.StructField("NumberRealEstateLoansOrLines", T.IntegerType()),
    T.StructField("NumberOfTime60-89DaysPastDueNotWorse", T.IntegerType()),
    T.StructField("NumberOfDependents", T.DoubleType()),
])
BRONZE_SCHEMA = T.StructType([*RAW_SCHEMA.fields, T.StructField("_ingestion_timestamp", T.TimestampType()), T.StructField("_source_file", T.StringType())])


def raw_stream(spark: SparkSession, folder: str, dataset: str | None = None, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """A stream of the CSV files that arrive in a folder, with arrival time and file name; of one dataset, if asked."""
    rows = spark.readStream.schema(schema).option("header", True).option("nullValue", "NA").option("pathGlobFilter", "*.csv").csv(folder)
    rows = rows.withColumns({"_ingestion_timestamp": F.current_timestamp(), "_source_file": F.col("_metadata.file_name")})
    return rows if dataset is None else rows.where(dataset_of(F.col("_source_file")) == dataset)


def append_all(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet folder and stop; a later run takes only new files."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)


class Snapshots:
    """A keyed table as numbered Parquet versions: readers take the newest complete one.

    A batch reads the newest version before its own number and writes its own, so that a replayed batch gives the same
    version again, and a failed one leaves the last complete version in place.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, version: int) -> str:
        return f"{self.folder}/v{version:012d}"

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest complete version (before a number), None if there is none."""
        known = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(self._at(known[-1])) if known else None

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(self._at(version))

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest versions."""
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(self._at(v)), True)


def upsert_batch(table: Snapshots | KeyedTable, key: str = "customer_id", newer_only: bool = False) -> Callable[[DataFrame, int], None]:
    """The function that merges a cleaned micro-batch.

    Of a batch's rows of one key the last to arrive stays, then the greatest file name, then the greatest row hash. It
    replaces the stored row; with ``newer_only``, only if it arrived later. A keyed table rewrites the partitions that the
    batch touches, snapshots all.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        content = [c for c in batch.columns if not c.startswith("_")]
        rows = clean.latest(batch, [key], [F.desc("_ingestion_timestamp"), F.desc("_source_file"), F.desc(F.xxhash64(*content))])
        if isinstance(table, KeyedTable):
            table.upsert(rows, batch_id, "_ingestion_timestamp" if newer_only else None)
            return
        current = table.read(before=batch_id + 1)
        if current is not None:
            if newer_only:
                stored = current.select(key, F.col("_ingestion_timestamp").alias("__stored"))
                rows = rows.join(stored, key, "left").where("__stored is null or _ingestion_timestamp > __stored").drop("__stored")
            rows = clean.upserted(current, rows, [key])
        table.write(rows, batch_id + 1)

    return merge


def upsert_all(spark: SparkSession, bronze: str, table: Snapshots | KeyedTable, checkpoint: str, newer_only: bool = False, schema: T.StructType = BRONZE_SCHEMA) -> StreamingQuery:
    """Clean the raw table's new rows and merge them batch by batch, then stop."""
    rows = clean.clean(spark.readStream.schema(schema).parquet(bronze)).withColumn("_silver_processed_at", F.current_timestamp())
    return rows.writeStream.foreachBatch(upsert_batch(table, newer_only=newer_only)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_bronze(spark: SparkSession, landing: str, bronze: str, checkpoint: str, dataset: str | None = None, schema: T.StructType = RAW_SCHEMA) -> None:
    """Ingest what has arrived; an error if the raw table is empty then."""
    append_all(raw_stream(spark, landing, dataset, schema), bronze, checkpoint).awaitTermination()
    assert_rows(spark.read.schema(T.StructType([*schema.fields, *BRONZE_SCHEMA.fields[len(RAW_SCHEMA.fields) :]])).parquet(bronze), "the raw table")


def run_silver(spark: SparkSession, bronze: str, silver: str, checkpoint: str, newer_only: bool = False, schema: T.StructType = BRONZE_SCHEMA, buckets: int = 32) -> DataFrame:
    """Merge what is new; an error if there was nothing to merge and no table yet (its checkpoint outlived it)."""
    query = upsert_all(spark, bronze, KeyedTable(spark, silver, buckets=buckets), checkpoint, newer_only, schema)
    query.awaitTermination()
    rows = KeyedTable(spark, silver).read()
    if rows is None:
        read = sum(p["numInputRows"] for p in query.recentProgress)
        raise RuntimeError(f"no cleaned table after {read} new rows: delete its checkpoint to read all again")
    return rows


def run_gold(training: DataFrame, scoring: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Dimension and fact of the current rows; an error if ids repeat or a table is empty."""
    drop = lambda df: df and df.drop(*[c for c in df.columns if c.startswith("_")])
    rows = star.populations(drop(training), drop(scoring))
    star.assert_unique(rows)
    dim, fct = star.dim_customer(rows), star.fct_credit_profile(rows)
    assert_rows(dim, "the customer dimension")
    assert_rows(fct, "the profile fact")
    return dim, fct
