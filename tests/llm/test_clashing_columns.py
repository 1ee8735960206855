"""Every operator, stage and the whole pipeline on a table whose columns have the names that operators add or use inside."""

import public_tokenizers
import pytest

import corpus_pipeline
from solvara.llm import contamination, html_text, licences, near_dups, packing, quality, sharding, substrings, token_files
from solvara.storage import shared_dir
from tests.llm import cases
from tests.llm.test_pipeline import corpus

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both(spark):
    plain = spark.createDataFrame(cases.rows(), cases.SCHEMA).select("doc_id", "text").repartition(3).cache()
    return plain, cases.clashing(plain)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_operators_of_documents(spark, both):
    items = spark.createDataFrame([(0, cases.rows()[3][1])], "item_id long, text string")
    for run in (near_dups.near_duplicates, licences.licence_scan, lambda d: contamination.leaks(d, cases.clashing(items.selectExpr("item_id", "text", "item_id as doc_id")))):
        same(*map(run, both))
    same(*(packing.pack_documents(d, PATH).select("doc_id", "start", "ids", "doc_tokens") for d in both))

    def files(d):
        folder = shared_dir(spark)
        return token_files.read_token_files(token_files.write_token_files(d, folder, PATH), folder)

    same(*map(files, both))


def test_added_columns_replace_those_of_the_same_name(spark, both):
    plain, clash = both
    labels = spark.createDataFrame([(r[0], r[0] % 2, "x") for r in cases.rows()], "doc_id long, quality int, label string")
    model = quality.fit(plain, labels.drop("label"))
    assert (quality.fit(clash, labels).vectors == model.vectors).all()
    for added, run in [
        ({"score"}, lambda d: quality.scored(d, model)),
        ({"score"}, lambda d: quality.scored(d, None)),
        ({"n_words", "n_removed"}, substrings.without_repeats),
        ({"row_number", "shard", "slot"}, lambda d: sharding.shard_rows(d, 3, 1, "doc_id")),
    ]:
        a, b = run(plain), run(clash)
        names = [c.lower() for c in b.columns]
        assert len(set(names)) == len(names) and set(names) == {c.lower() for c in clash.columns} | added
        same(a, b.select(a.columns))
        for c in {"own_id", "a.b", "back`tick", "Size"} - added:
            quoted = c.replace("`", "``")
            assert b.selectExpr(f"`{quoted}` = concat('{c} of ', doc_id) as x").where("not x").isEmpty()
    assert sharding.shard_rows(clash, 3, 1, "shard", "doc_id").count() == plain.count()


def test_html_keeps_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "<p>a", "old", "x")], "page_id long, html string, text string, `a.b` string")
    assert html_text.html_text(pages).collect()[0].asDict() == {"page_id": 1, "html": "<p>a", "text": "a", "a.b": "x"}


def test_pipeline(spark, tmp_path):
    folder, other = str(tmp_path / "plain"), str(tmp_path / "clash")
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cases.clashing(docs).write.parquet(f"{other}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{other}/{name}.parquet")
    a, b = docs, spark.read.parquet(f"{other}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, a, folder).write.parquet(f"{folder}/{name}")
        stage(spark, b, other).write.parquet(f"{other}/{name}")
        a, b = spark.read.parquet(f"{folder}/{name}"), spark.read.parquet(f"{other}/{name}")
        assert b.columns == cases.clashing(docs).columns
        same(a, b.select(a.columns))
        assert b.where("score is null or `a.b` <> concat('a.b of ', doc_id)").isEmpty()
    assert corpus_pipeline.run(spark, other).count()
