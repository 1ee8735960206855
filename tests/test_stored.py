"""Sketches by day, runs appended once, stored drift profiles, bucketed tables and row digests."""

import math
import random

import pytest
from pyspark.sql import functions as F

from solvara.operators import drift, hypotheses, profile, sketches
from solvara.sources import tables
from solvara.storage import Files


def numbers(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(i, None if i % 11 == 0 else rng.gauss(5, 2), float("nan") if i % 7 == 0 else float(rng.randrange(40)), None if i % 5 == 0 else f"v{rng.randrange(900)}", None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, y double, s string, empty int")


def test_sketches_of_days_equal_the_whole(spark, tmp_path):
    df, path = numbers(spark, 6000), str(tmp_path / "s")
    days = [df.where(f"id % 3 = {d}") for d in range(3)]
    assert [sketches.store_day(days[d], path, f"2024-01-0{d}") for d in (0, 1, 1, 2)] == [True, True, False, True]
    got = {r.column_name: r for r in sketches.merged(spark, path).collect()}
    plain = df.withColumn("y", F.nanvl("y", F.lit(None).cast("double")))
    for c in df.columns:
        row = plain.agg(F.count(c).alias("n"), F.count_distinct(c).alias("d")).first()
        assert (got[c].n, got[c].n_null) == (row.n, 6000 - row.n) and abs(got[c].n_distinct - row.d) <= 0.05 * row.d
    for c in ("id", "x", "y"):
        values = sorted(r[0] for r in plain.select(F.col(c).cast("double")).where(f"{c} is not null").collect())
        mean = sum(values) / len(values)
        assert got[c].mean == pytest.approx(mean) and got[c].std == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)))
        assert (got[c].min, got[c].max) == (values[0], values[-1])
        for name, share in sketches.QUARTILES.items():
            q = getattr(got[c], name)
            under, up = sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values)
            assert under <= share + 0.03 and up >= share - 0.03
    assert got["s"].mean is None and got["s"].p50 is None and got["empty"].n == 0 and got["empty"].n_distinct == 0


def test_a_grown_table_reads_the_new_day_alone(spark, tmp_path):
    path, data = str(tmp_path / "s"), str(tmp_path / "data")
    for d in range(3):
        numbers(spark, 100, d).write.parquet(f"{data}/day={d}")
    for d in range(2):
        sketches.store_day(spark.read.parquet(f"{data}/day={d}"), path, str(d))
    Files(spark, data).delete("day=0")  # old days may even be gone
    Files(spark, data).delete("day=1")
    sketches.store_day(spark.read.parquet(f"{data}/day=2"), path, "2")
    assert {r.column_name: r.n for r in sketches.merged(spark, path).collect()}["id"] == 300 and tables.runs(spark, path) == ["0", "1", "2"]


def test_a_run_appends_once_even_after_a_failure(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    first, second = spark.createDataFrame([(1, "a")], "x int, run string"), spark.createDataFrame([(2, "b", 0.5)], "x int, run string, more double")
    assert tables.append_once(first, path, "a") and not tables.append_once(first, path, "a")

    def fails(self, name, to):
        raise OSError("the driver is gone")

    real = Files.rename
    monkeypatch.setattr(Files, "rename", fails)
    with pytest.raises(OSError):
        tables.append_once(second, path, "b")
    assert tables.runs(spark, path) == ["a"] and tables.read_merged(spark, path).count() == 1  # what failed isn't seen
    monkeypatch.setattr(Files, "rename", real)
    assert tables.append_once(second, path, "b")
    assert sorted((r.x, r.more) for r in tables.read_merged(spark, path).collect()) == [(1, None), (2, 0.5)]
    with pytest.raises(ValueError, match="run name"):
        tables.append_once(first, path, "../a")


def test_psi_against_a_stored_profile_reads_no_reference(spark, tmp_path):
    rng = random.Random(2)
    schema = "customer_id long, wide double, few int, constant double, gone double"
    make = lambda n, shift: [(i, rng.gauss(shift, 1) if i % 10 else None, rng.randrange(3 + shift), 7.0, None if shift else 1.0 * i) for i in range(n)]
    spark.createDataFrame(make(500, 0), schema).write.parquet(str(tmp_path / "ref"))
    spark.createDataFrame(make(300, 1), schema).write.parquet(str(tmp_path / "cur"))
    reference, batch = (spark.read.parquet(str(tmp_path / n)) for n in ("ref", "cur"))
    features = ["wide", "few", "constant", "gone"]
    drift.stored_profile(reference, features, 3).write.parquet(str(tmp_path / "profile"))
    held = spark.read.parquet(str(tmp_path / "profile"))
    both = reference.withColumn("r", F.lit(True)).union(batch.withColumn("r", F.lit(False)))
    frame = drift.long_frame(both, features, F.col("r"), ~F.col("r"))
    want = {r.feature: r for r in drift.psi(frame, drift.bin_edges(frame)).collect()}
    Files(spark, str(tmp_path)).delete("ref")
    out = drift.psi_against(held, batch)
    got = {r.feature: r for r in out.collect()}
    assert set(got) == set(features) and {r.version for r in got.values()} == {3} and math.isnan(got["gone"].psi) and got["constant"].psi == 0
    for f in ("wide", "few"):
        assert got[f].psi == pytest.approx(want[f].psi) and got[f].psi > 0.05 and (got[f].n_ref, got[f].n_cur) == (want[f].n_ref, want[f].n_cur)
    assert "/ref" not in out._jdf.queryExecution().toString()


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    tables.ensure_database(spark, "bucketed_db", str(tmp_path / "db"))
    a = spark.range(1000).select(F.col("id").alias("customer_id"), (F.col("id") * 2).alias("x"))
    tables.write_bucketed(a, "bucketed_db.a", "customer_id", 4)
    tables.write_bucketed(a.withColumnRenamed("x", "y").where("customer_id % 3 = 0"), "bucketed_db.b", "customer_id", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = spark.table("bucketed_db.a").join(spark.table("bucketed_db.b"), "customer_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and joined.count() == 334
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP DATABASE bucketed_db CASCADE")


@pytest.mark.parametrize("few", [500_000, 0])
def test_digests_equal_whole_rows(spark, monkeypatch, few):
    monkeypatch.setattr(profile, "FEW_DIGESTS", few)
    nan = float("nan")
    rows = [(1, "a", 0.0), (1, "a", -0.0), (1, None, 1.0), (None, "a", 1.0), (1, None, 1.0), (2, "b", nan), (2, "b", nan), (3, "", None), (3, None, None), (4, "c", 1.0)] + [(9, "hot", 2.0)] * 40
    df = spark.createDataFrame(rows, "a int, b string, c double")
    assert profile.duplicate_rows_by_digest(df).collect() == profile.duplicate_rows(df).collect()
    assert sorted(map(str, profile.distinct_rows_by_digest(df).collect())) == sorted(map(str, df.distinct().collect()))
    empty = df.where("false")
    assert profile.duplicate_rows_by_digest(empty).collect() == profile.duplicate_rows(empty).collect() and profile.distinct_rows_by_digest(empty).isEmpty()


def test_digests_shuffle_the_same_however_wide_the_table(spark):
    def widest(df):
        one, two = profile.row_digest(df)
        plan = df.select(one.alias("d1"), two.alias("d2")).groupBy("d1", "d2").count()._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "Exchange" in line]

    narrow, wide = spark.range(10).select("id"), spark.range(10).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(60)])
    assert len(widest(narrow)) == len(widest(wide)) == 1 and "c59" not in "".join(widest(wide))


def test_persisted_hypotheses_replace_an_earlier_report(spark, tmp_path):
    report = spark.createDataFrame([("H1", 0.5)], "hypothesis string, value double")
    hypotheses.persist(spark.createDataFrame([("H0", 1, "x")], "hypothesis string, value int, more string"), "hypo_db", location=str(tmp_path / "h"))
    assert hypotheses.persist(report, "hypo_db").collect() == report.collect()
    with pytest.raises(RuntimeError, match="no rows"):
        hypotheses.persist(report.where("false"), "hypo_db")
    spark.sql("DROP DATABASE hypo_db CASCADE")
