"""Upserts that rewrite only what they touch, and streams with state by key."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from solvara.storage import Files
from solvara.streaming import keyed

SCHEMA = "customer_id long, x int, at timestamp"


def at(day):
    return dt.datetime(2024, 1, day)


def rows_of(table):
    return sorted(((r.customer_id, r.x) for r in table.read().collect()), key=str)


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), buckets=16)
    assert table.read() is None
    table.upsert(spark.range(500).select(F.col("id").alias("customer_id"), F.lit(0).alias("x"), F.lit(at(1)).alias("at")), 0)
    files = Files(spark, str(tmp_path / "t"))
    data = lambda: {f: t for f, t in files.files("of16").items() if f.endswith(".parquet")}
    before = data()
    assert len(before) == 16
    batch = spark.createDataFrame([(7, 1, at(2)), (8, 1, at(2)), (1000, 1, at(2))], SCHEMA)
    touched = {r[0] for r in batch.select(F.pmod(F.xxhash64("customer_id"), F.lit(16))).collect()}
    table.upsert(batch, 1)
    after = data()
    kept = {f for f in before if f in after and after[f] == before[f]}
    assert {int(f.split("key_bucket=")[1].split("/")[0]) for f in set(before) - kept} == touched and len(kept) == 16 - len(touched)
    assert rows_of(table) == sorted([(i, int(i in (7, 8))) for i in range(500)] + [(1000, 1)], key=str)
    assert keyed.KeyedTable(spark, str(tmp_path / "t"), buckets=99).buckets == 16


def test_a_batch_reads_only_touched_partitions(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), buckets=16)
    table.upsert(spark.range(500).select(F.col("id").alias("customer_id"), F.lit(0).alias("x"), F.lit(at(1)).alias("at")), 0)
    stored = table._partitions().where(F.col(keyed.BUCKET).isin([3]))
    assert len(stored.inputFiles()) == 16 and "PartitionFilters: [isnotnull(key_bucket" in stored._jdf.queryExecution().executedPlan().toString()


def test_replays_and_failures_between_write_and_commit(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    first = spark.createDataFrame([(1, 10, at(1)), (2, 20, at(1)), (None, 5, at(1))], SCHEMA)
    second = spark.createDataFrame([(2, 21, at(2)), (3, 30, at(2)), (None, 6, at(2))], SCHEMA)
    want = [(1, 10), (2, 21), (3, 30), (None, 6)]
    for number, batch in ((0, first), (0, first), (1, second), (1, second)):
        table.upsert(batch, number)
    assert rows_of(table) == sorted(want, key=str)
    third = spark.createDataFrame([(1, 11, at(3))], SCHEMA)
    real = Files.names

    def fails(self, name):
        if name.startswith("_batches/"):
            raise OSError("the driver is gone")
        return real(self, name)

    monkeypatch.setattr(Files, "names", fails)
    with pytest.raises(OSError):
        table.upsert(third, 2)
    monkeypatch.setattr(Files, "names", real)
    for name in real(table.files, table.rows):  # as if the overwrite had got as far as deleting
        if name == f"key_bucket={spark.range(1, 2).select(F.pmod(F.xxhash64('id'), F.lit(4))).first()[0]}":
            table.files.delete(f"{table.rows}/{name}")
    table.upsert(third, 2)
    assert rows_of(table) == sorted([(1, 11), *want[1:]], key=str)
    table.upsert(third.where("false"), 3)
    assert rows_of(table) == sorted([(1, 11), *want[1:]], key=str) and len(table.files.names("_batches")) == 1


def test_newer_only(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"))
    table.upsert(spark.createDataFrame([(1, 1, at(2)), (2, 1, at(2))], SCHEMA), 0, "at")
    table.upsert(spark.createDataFrame([(1, 2, at(1)), (2, 2, at(3)), (3, 2, at(1))], SCHEMA), 1, "at")
    assert rows_of(table) == [(1, 1), (2, 2), (3, 2)]


def test_newest_over_restarts(spark, tmp_path):
    """An older row that comes last, a repeated one and a tie; each run starts from the checkpoint."""
    stream = None
    for batch in ([(1, 10, at(5)), (2, 20, at(5)), (3, 30, None)], [(1, 11, at(6)), (1, 12, at(4)), (2, 20, at(5)), (3, 31, at(1))], [(1, 13, at(5)), (2, 19, at(4)), (4, 40, at(1)), (3, 32, None)]):
        spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        keyed.keep_newest(stream, keyed.KeyedTable(spark, str(tmp_path / "t"), buckets=4), "at", str(tmp_path / "c")).awaitTermination()
    assert rows_of(keyed.KeyedTable(spark, str(tmp_path / "t"))) == [(1, 11), (2, 20), (3, 31), (4, 40)]
    tied = spark.createDataFrame([(1, 1, at(1)), (1, 2, at(1))], SCHEMA)
    assert keyed.newest(tied, "customer_id", "at").collect() == keyed.newest(tied.orderBy(F.desc("x")), "customer_id", "at").collect()


def test_repeated_rows_within_a_time(spark, tmp_path):
    for batch in ([(1, 1, at(1)), (1, 1, at(1)), (2, 1, at(1))], [(1, 1, at(2)), (3, 1, at(20))], [(3, 1, at(21)), (1, 1, at(22))]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = keyed.distinct_rows(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["customer_id", "x"], "at", "5 days")
        keyed.append_stream(rows, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    found = sorted((r.customer_id, r.at.day) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [(1, 1), (1, 22), (2, 1), (3, 20)]


def test_outcomes_meet_predictions_and_late_ones_are_left_out(spark, tmp_path):
    p_schema, o_schema = "customer_id long, score double, predicted_at timestamp", "customer_id long, y int, known_at timestamp"
    spark.createDataFrame([], p_schema).write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([], o_schema).write.parquet(str(tmp_path / "o"))
    p, o = (spark.readStream.schema(s).parquet(str(tmp_path / n)) for n, s in (("p", p_schema), ("o", o_schema)))
    joined = keyed.realised_stream(p, o, "customer_id", "predicted_at", "known_at", "10 DAYS", "2 days")
    assert joined.columns == ["customer_id", "score", "predicted_at", "y", "known_at"]

    def step(predictions, outcomes):
        spark.createDataFrame(predictions, p_schema).write.mode("append").parquet(str(tmp_path / "p"))
        spark.createDataFrame(outcomes, o_schema).write.mode("append").parquet(str(tmp_path / "o"))
        keyed.append_stream(joined, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        return sorted((r.customer_id, r.y) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert step([(1, 0.1, at(1)), (2, 0.2, at(1)), (3, 0.3, at(2)), (None, 0.4, at(1))], [(1, 1, at(1)), (None, 1, at(1))]) == [(1, 1)]
    assert step([], [(2, 0, at(11)), (3, 0, at(13))]) == [(1, 1), (2, 0)]  # 3 was known after its ten days
    assert step([(4, 0.4, at(28))], [(4, 1, at(29))]) == [(1, 1), (2, 0), (4, 1)]
    step([(8, 0.1, at(30))], [(8, 0, at(30))])
    assert (5, 1) not in step([(5, 0.5, at(3))], [(5, 1, at(4))])  # weeks behind both watermarks
