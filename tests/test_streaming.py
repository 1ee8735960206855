"""Streams against their batch forms, replays, snapshots, tables and the dictionary."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from solvara.operators import clean
from solvara.sources import dictionary, tables
from solvara.sources.landing import dataset_of
from solvara.streaming import ingest

HEADER = ",SeriousDlqin2yrs,RevolvingUtilizationOfUnsecuredLines,age,NumberOfTime30-59DaysPastDueNotWorse,DebtRatio,MonthlyIncome,NumberOfOpenCreditLinesAndLoans,NumberOfTimes90DaysLate,NumberRealEstateLoansOrLines,NumberOfTime60-89DaysPastDueNotWorse,NumberOfDependents"


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([HEADER, *lines]) + "\n")


def line(i, age=40, income="1000", dependents="1"):
    return f"{i},0,0.5,{age},0,0.1,{income},1,0,0,0,{dependents}"


def test_incremental_upsert_and_replay(spark, tmp_path):
    landing, bronze, silver = tmp_path / "landing", str(tmp_path / "bronze"), str(tmp_path / "silver")
    write(landing, "cs-training-1.csv", [line(1), line(2, income="NA"), line(3, dependents="NA")])
    (landing / "notes.txt").write_text("not a table")
    step = lambda: (ingest.run_bronze(spark, str(landing), bronze, str(tmp_path / "c1")), ingest.run_silver(spark, bronze, silver, str(tmp_path / "c2")))[1]
    assert step().count() == 3
    write(landing, "cs-training-2.csv", [line(2, age=50), line(4)])
    got = {r.customer_id: r for r in step().collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[2].age == 50 and got[2].is_monthly_income_null == 0 and got[3].num_dependents == 0
    again = {r.customer_id: r for r in step().collect()}
    assert again == got  # nothing new: the same version
    write(landing, "cs-training-3.csv", [line(2, age=50), line(4)])  # the same rows under a new name
    assert sorted(r.customer_id for r in step().collect()) == [1, 2, 3, 4]


def test_stream_equals_batch_for_any_split(spark, tmp_path):
    ages = [(i % 7 + 1, 20 + i) for i in range(30)]
    results = []
    for k, cuts in enumerate([[30], [10, 20, 30], [1, 2, 29, 30]]):
        base = tmp_path / str(k)
        base.mkdir()
        at = 0
        for n, cut in enumerate(cuts):
            own = list(dict(ages[at:cut]).items())  # a file has a key once: order within a file isn't defined
            write(base / "in", f"training-{n}.csv", [line(i, age=a) for i, a in own])
            ingest.run_bronze(spark, str(base / "in"), str(base / "b"), str(base / "c1"))
            rows = ingest.run_silver(spark, str(base / "b"), str(base / "s"), str(base / "c2"))
            at = cut
        results.append(sorted((r.customer_id, r.age) for r in rows.collect()))
    assert results[0] == results[1] == results[2] == sorted(dict(ages).items())


def test_replayed_batch_and_newer_only(spark, tmp_path):
    schema = "customer_id int, x int, _ingestion_timestamp timestamp, _source_file string"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    snaps = ingest.Snapshots(spark, str(tmp_path / "s"))
    merge = ingest.upsert_batch(snaps)
    merge(batch((1, 10, at(2), "a"), (1, 11, at(2), "b"), (2, 20, at(2), "a")), 0)
    assert {(r.customer_id, r.x) for r in snaps.read().collect()} == {(1, 11), (2, 20)}
    for _ in range(2):
        merge(batch((2, 21, at(1), "c"), (3, 30, at(1), "c")), 1)
        assert {(r.customer_id, r.x) for r in snaps.read().collect()} == {(1, 11), (2, 21), (3, 30)}
    ingest.upsert_batch(snaps, newer_only=True)(batch((1, 99, at(1), "d"), (2, 22, at(3), "d")), 2)
    assert {(r.customer_id, r.x) for r in snaps.read().collect()} == {(1, 11), (2, 22), (3, 30)}
    assert snaps.versions() == [1, 2, 3]
    snaps.vacuum(keep=1)
    assert snaps.versions() == [3]


def test_consumed_checkpoint_without_a_table(spark, tmp_path):
    import shutil

    landing = tmp_path / "in"
    write(landing, "training.csv", [line(1)])
    ingest.run_bronze(spark, str(landing), str(tmp_path / "b"), str(tmp_path / "c1"))
    ingest.run_silver(spark, str(tmp_path / "b"), str(tmp_path / "s"), str(tmp_path / "c2"))
    shutil.rmtree(tmp_path / "s")
    with pytest.raises(RuntimeError, match="checkpoint"):
        ingest.run_silver(spark, str(tmp_path / "b"), str(tmp_path / "s"), str(tmp_path / "c2"))


def test_routing_by_file_name(spark, tmp_path):
    df = spark.createDataFrame([("cs-Training.csv",), ("cs-TEST.csv",), ("training-test.csv",), ("other.csv",)], "f string")
    assert [r[0] for r in df.select(dataset_of(F.col("f"))).collect()] == ["training", "scoring", "training", None]
    landing = tmp_path / "in"
    write(landing, "cs-training.csv", [line(1)])
    write(landing, "cs-test.csv", [line(2)])
    ingest.run_bronze(spark, str(landing), str(tmp_path / "b"), str(tmp_path / "c"), dataset="scoring")
    assert [r[0] for r in spark.read.schema(ingest.BRONZE_SCHEMA).parquet(str(tmp_path / "b")).select("_c0").collect()] == [2]


def test_histories_gain_columns(spark):
    spark.sql("DROP TABLE IF EXISTS hist")
    tables.append_history(spark.createDataFrame([(1, "a")], "id int, mode string"), "hist")
    tables.append_history(spark.createDataFrame([(0.5, 2)], "psi double, ID int"), "hist")
    assert sorted(map(tuple, spark.table("hist").collect()), key=str) == [(1, "a", None), (2, None, 0.5)]
    assert tables.ensure_columns(spark, "hist", {"PSI": "double", "extra": "string"}) == ["extra"]
    assert tables.ensure_columns(spark, "not_there", {"a": "int"}) == []
    assert tables.optional_table(spark, "not_there") is None and tables.optional_table(spark, "hist").count() == 2
    tables.overwrite(spark.createDataFrame([(1,)], "other int"), "hist")
    assert spark.table("hist").columns == ["other"]
    with pytest.raises(RuntimeError):
        tables.assert_rows(spark.createDataFrame([], "a int"), "it")
    spark.sql("DROP TABLE hist")


def test_dictionary_audit_and_comments(spark):
    spark.sql("DROP TABLE IF EXISTS doc1")
    spark.createDataFrame([(1, 2, 3)], "a int, extra int, _hidden int").write.saveAsTable("doc1")
    d = spark.createDataFrame([("doc1", "a", "it's a", "s", False), ("doc1", "label", "l", "s", True), ("doc1", "gone", "g", "s", False), ("absent", "x", "x", "s", False)], dictionary.DICTIONARY)
    found = dictionary.coverage(d, dictionary.table_columns(spark, ["doc1", "absent"]), hidden=("_hidden",))
    assert sorted((r.column_name, r.finding) for r in found.collect()) == [("extra", "undocumented"), ("gone", "missing")]
    dictionary.apply_all(spark, d, {"doc1": "the table's text", "absent": "none"})
    assert {c.name: c.description for c in spark.catalog.listColumns("doc1")}["a"] == "it's a"
    with pytest.raises(ValueError, match="gone"):
        dictionary.apply_all(spark, d, {"doc1": ""}, strict=True)
    spark.sql("DROP TABLE doc1")


def test_upsert_keeps_columns_by_name(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([("z", 2), ("w", 3)], "v string, k int")
    assert sorted((r.k, r.v) for r in clean.upserted(a, b, ["k"]).collect()) == [(1, "x"), (2, "z"), (3, "w")]
