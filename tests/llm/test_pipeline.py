"""Each stage against a brute-force version on a small corpus, and the whole run."""

import random

import corpus_pipeline
from solvara.llm import quality
from tests.llm import cases
from tests.llm.test_contamination import brute as leaks
from tests.llm.test_near_dups import brute as groups
from tests.llm.test_substrings import brute as cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    rng = random.Random(8)
    rows = [(*r[:4], len(r[1] or "")) for r in cases.rows(8)]
    items = [(i, " ".join(cases.words(rng, 35, 5000))) for i in range(4)]
    rows += [(600 + i, f"{' '.join(cases.words(rng, 40))} {items[i][1]} {' '.join(cases.words(rng, 20))}", "en", "s", 1) for i in range(4)]
    rows += [(700 + i, "junk!! " * (20 + i), "en", "s", 1) for i in range(60)]
    labels = [(r[0], int("junk" not in (r[1] or "")), 0) for r in rows if r[0] % 5]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    _, items = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(f"{folder}/out{i}")
        after = spark.read.parquet(f"{folder}/out{i}")
        if name != "packing":
            assert after.columns == docs.columns
        seen.append((name, before, [tuple(r) for r in after.collect()]))
        docs = after
    (_, b, a), *rest = seen
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r.doc_id for r in quality.scored(spark.read.parquet(f"{folder}/documents.parquet"), model).collect() if r.score >= 0.5}
    assert sorted(a, key=str) == sorted((r for r in b if r[0] in good), key=str) and not any("junk" in (r[1] or "") for r in a)
    (_, b, a), *rest = rest
    kept = {r[0] for r in groups(b) if r[3]}
    assert sorted(r[0] for r in a) == sorted(kept) and set(a) <= set(b) and len(a) < len(b)
    (_, b, a), *rest = rest
    want = {r[0]: r for r in cut(b)}
    texts = {r[0]: r[1] for r in b}
    assert {r[0]: r[1] for r in a} == {d: (w[1] if w[3] else texts[d]) for d, w in want.items() if not w[3] or w[3] < w[2]}
    (_, b, a), (_, last, pieces) = rest
    hit = {x[0] for x in leaks([r[:2] for r in b], items)}
    assert hit and sorted(r[0] for r in a) == sorted(r[0] for r in b if r[0] not in hit)
    assert {p[0] for p in pieces} == {r[0] for r in last}


def test_run(spark, tmp_path):
    corpus(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() and {"doc_id", "sequence_id", "offset", "ids"} <= set(out.columns)
