import random

import pytest
from pyspark.sql import functions as F

from solvara.llm import line_dedup
from solvara.storage import staged
from tests.llm import cases

BLANK = " \t\n\x0b\x0c\r"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=10, chars=1, keep_first=False):
    found, places = {}, {}
    for i, t in set(rows):
        for p, line in enumerate((t or "").split("\n")):
            key = lowered(line.strip(BLANK))
            if len(key) >= chars:
                found.setdefault(key, set()).add((i, t))
    gone = {k for k, d in found.items() if len(d) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [lowered(x.strip(BLANK)) not in gone for x in lines]
        if keep_first:
            for p, line in enumerate(lines):
                key = lowered(line.strip(BLANK))
                if key in gone and places.setdefault(key, (i, p)) == (i, p):
                    keep[p] = True
        out.append((i, len(lines), len(lines) - sum(keep), "\n".join(x for x, k in zip(lines, keep) if k)))
    return sorted(out, key=str)


def got(spark, rows, least=10, chars=1, keep_first=False):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = line_dedup.without_lines(docs, line_dedup.keep_bitmaps(docs, least, chars, keep_first))
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    pool = ["Share this page", " share THIS page\t", "ÄRGER mit Ä", "ärger mit Ä", "all rights", "x", "", " \x0b ", "long " * 50] + [f"line {i}" for i in range(60)]
    return [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("least, chars", [(10, 1), (2, 1), (20, 5), (1, 1), (10**6, 1)])
def test_equals_brute_force(spark, least, chars):
    rows = corpus(1)
    assert got(spark, rows, least, chars) == brute(rows, least, chars)


@pytest.mark.parametrize("cuts", [8, 10**6])
def test_first_occurrences_stay(spark, monkeypatch, cuts):
    monkeypatch.setattr(line_dedup, "CUTS", cuts)
    monkeypatch.setattr(line_dedup, "SHOWN", 4)
    rows = corpus(2)
    assert got(spark, rows, 3, keep_first=True) == brute(rows, 3, keep_first=True)


def test_odd_rows(spark):
    rows = [(None, None), (None, ""), (None, "a\nb"), (1, "A\n\nb "), (1, "A\n\nb "), (1, "other\na"), (2, "\n\n\n"), (3, "a"), (4, "é\r\na\r"), (5, "b\n" * 70_000 + "c")]
    rows += [(r[0], r[1]) for r in cases.odd_rows()]
    for least in (2, 3):
        assert got(spark, rows, least) == brute(rows, least)


def test_empty_table(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("n_docs", [9, 10])
def test_a_hash_cut_into_parts(spark, monkeypatch, n_docs):
    """A line that one document repeats, and one that a third of all lines is: documents count, not lines or parts."""
    monkeypatch.setattr(line_dedup, "SHOWN", 4)
    rows = [(i, "\n".join(["hot"] * 500 + [f"own {i} {j}" for j in range(20)] + ["hot"])) for i in range(n_docs)]
    rows += [(1000, "again\n" * 3000), (1001, "AGAIN")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup._hot(line_dedup.line_hashes(docs)).count() == 2
    assert got(spark, rows) == brute(rows)


def test_bitmaps_round_trip(spark):
    rng = random.Random(4)
    lists = [[0], [5], list(range(200)), [0, 1, 2, 130, 131, 20_000, 3_000_000], sorted(rng.sample(range(5000), 1500))]
    df = spark.createDataFrame([(x,) for x in lists], "p array<int>").select("p", line_dedup.packed(F.col("p")).alias("b"))
    for r in df.select("p", "b", line_dedup.unpacked(F.col("b")).alias("flags")).collect():
        assert [i for i, keep in enumerate(r.flags) if not keep] == r.p and len(r.flags) == r.p[-1] + 1
    assert len(df.collect()[2].b) == 3


def test_native_plan_and_clashing_columns(spark):
    plain = staged(spark.createDataFrame(cases.rows(), cases.SCHEMA).select("doc_id", "text"))
    docs = cases.clashing(plain)
    bitmaps = line_dedup.keep_bitmaps(docs, 2)
    out = line_dedup.without_lines(docs, bitmaps)
    plans = "".join(df._jdf.queryExecution().toString() for df in (line_dedup.line_hashes(docs), bitmaps, out))
    assert not any(sign in plans for sign in ("Python", "Arrow", "Pandas", "ExistingRDD"))
    assert {c.lower() for c in out.columns} == {c.lower() for c in docs.columns} | {"n_lines", "n_dropped"}
    assert out.where("`a.b` <> concat('a.b of ', doc_id)").isEmpty()
    same = line_dedup.without_lines(plain, line_dedup.keep_bitmaps(plain, 2))
    assert sorted(map(str, out.select(same.columns).collect())) == sorted(map(str, same.collect()))


def test_one_range_exchange_carries_the_stream(spark):
    docs = spark.createDataFrame(corpus(3), "doc_id long, text string")
    lines = line_dedup.line_hashes(docs)
    run = line_dedup.Window.partitionBy("h1", "h2", "doc_id")
    plan = lines.repartitionByRange("h1", "h2", "doc_id").withColumn("n", F.row_number().over(run.orderBy("pos")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
