"""Keyed tables that a batch rewrites only where its keys fall, and streams that keep state by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from solvara.functions import rules
from solvara.operators import drift
from solvara.sources import tables
from solvara.storage import Files, staged

BUCKET = "key_bucket"


class KeyedTable:
    """One row a key, as Parquet partitioned by key hash; an upsert reads and rewrites the partitions its keys fall into.

    A batch's new partitions are written whole beside the table first, under the batch's number, and then put in place by
    dynamic partition overwrite. If that fails in between, the replayed batch finds them complete and only puts them in
    place, so its rows are equal and nothing is lost. Batches come in order; readers meanwhile may see a batch in part.

    ``buckets`` holds for a new table; one that is there keeps its number. A batch of fewer keys than buckets touches that
    few, so a table of many rows and small batches wants many.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "customer_id", buckets: int = 32):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.files = Files(spark, self.folder)
        there = [n for n in self.files.names("") if n.startswith("of") and n[2:].isdigit()]
        self.buckets = int(there[0][2:]) if there else buckets
        self.rows = f"of{self.buckets}"

    def read(self) -> DataFrame | None:
        """The table's rows, None before the first batch."""
        rows = self._partitions()
        return None if rows is None else rows.drop(BUCKET)

    def _partitions(self) -> DataFrame | None:
        if not self.files.names(self.rows):
            return None
        return self.spark.read.parquet(f"{self.folder}/{self.rows}")

    def upsert(self, batch: DataFrame, number: int, arrived: str | None = None) -> None:
        """Put a batch of single keys in place of the stored rows; with ``arrived``, only of those that arrived earlier.

        Null keys are one key. A batch without rows changes nothing.
        """
        log = f"_batches/{number:012d}"
        if not self.files.exists(f"{log}/_SUCCESS"):
            rows = staged(batch.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")))
            touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # a row a bucket at most
            current = self._partitions()
            if current is not None:
                stored = current.where(F.col(BUCKET).isin(touched))
                same = rows[self.key].eqNullSafe(F.col("__key"))
                if arrived:
                    rows = rows.join(stored.select(F.col(self.key).alias("__key"), F.col(arrived).alias("__stored")), same, "left").where(f"__stored is null or {arrived} > __stored").drop("__key", "__stored")
                mine = rows.select(F.col(self.key).alias("__key"))
                rows = rows.unionByName(stored.join(mine, stored[self.key].eqNullSafe(F.col("__key")), "left_anti"))
            rows.repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.folder}/{log}")
        if [n for n in self.files.names(log) if n.startswith(BUCKET)]:
            rows = self.spark.read.parquet(f"{self.folder}/{log}")
            rows.repartition(F.col(BUCKET)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.folder}/{self.rows}")
        for name in self.files.names("_batches"):
            if name < f"{number:012d}":
                self.files.delete(f"_batches/{name}")


def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Of each key the row of greatest ``at``, then of greatest hash: keyed state where ``rows`` is a stream.

    The stream's state has one row a key and outlives restarts; a row that comes late but is older than the one held, or
    comes again, changes nothing. Rows without ``at`` are older than all others.
    """
    content = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*content), F.struct(F.col(at), F.xxhash64(*content)))
    return rows.groupBy(key).agg(last.alias("__row")).select(key, "__row.*")


def keep_newest(rows: DataFrame, table: KeyedTable, at: str, checkpoint: str) -> StreamingQuery:
    """Keep ``table`` at each key's newest row: take what has arrived and stop. Only keys that changed are written."""
    changed = newest(rows, table.key, at).writeStream.outputMode("update")
    return changed.foreachBatch(lambda batch, number: table.upsert(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_rows(rows: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """A stream without rows whose ``keys`` came before within a time of ``at``; the state holds no more than that time."""
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def realised_stream(predictions: DataFrame, outcomes: DataFrame, key: str, predicted_at: str, known_at: str, wait: str, late: str) -> DataFrame:
    """Predictions joined, as they come, with outcomes of the same key known up to ``wait`` after them.

    Both are streams, each with a watermark of ``late``: a row older than the newest of its stream by more than that may be
    left out, and state goes once neither side can match it any more. Repeated rows match as often as they come; nulls in
    key or time match nothing.
    """
    p = predictions.withWatermark(predicted_at, late)
    o = outcomes.withColumnRenamed(key, "__key").withWatermark(known_at, late)
    due: Column = F.col(known_at).between(F.col(predicted_at), F.col(predicted_at) + F.expr(f"INTERVAL {wait}"))
    return p.join(o, (F.col(key) == F.col("__key")) & due).drop("__key")


def append_stream(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet folder and stop."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)


def drift_stream(rows: DataFrame, profile: DataFrame, history: str, checkpoint: str) -> StreamingQuery:
    """Hold each batch that has arrived against a stored profile and append its figures once, with the batch's number; then stop."""

    def measure(batch: DataFrame, number: int) -> None:
        figures = drift.psi_against(profile, batch).select(F.lit(number).cast("long").alias("batch"), "*", rules.psi_class(F.col("psi")).alias("psi_class"))
        tables.append_once(figures, history, f"{number:012d}")

    return rows.writeStream.foreachBatch(measure).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
