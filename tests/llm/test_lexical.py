import math
import random
import re

import pyarrow as pa
import pytest

from solvara.llm import lexical
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    split = [(i, terms(t)) for i, t in docs]
    split = [(i, t) for i, t in split if t]
    n, total = len(split), sum(len(t) for _, t in split)
    df: dict = {}
    for _, t in split:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        own, scored = terms(text), []
        for i, t in split:
            m = 75 + (25 * len(t) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * c) // (1000 * c + 12 * m)) for x in own if (c := t.count(x)))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, k=20):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, lexical.search(d, spark.createDataFrame(items, "item_id long, text string"), k).collect()), key=str)


def corpus(seed, n_docs=400, n_items=12, vocabulary=300):
    rng = random.Random(seed)
    word = lambda: f"w{int(vocabulary * rng.random() ** 2)}"  # noqa: E731  # low numbers are common
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(n_items)]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 120)))) for i in range(n_docs)]
    return docs + [(n_docs + i, f"{docs[i][1]}, {items[i % n_items][1].upper()}; {docs[-i][1]}") for i in range(30)], items


@pytest.mark.parametrize("bucket, seeds", [(4096, 2048), (16, 8), (1, 1)])
def test_equals_brute_force(spark, monkeypatch, bucket, seeds):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "SEED_ROWS", seeds)
    docs, items = corpus(1)
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, items, 3) == brute(docs, items, 3)


def test_copies_and_ties(spark, monkeypatch):
    """A third of all rows is one text: it is dealt out, and its least ids lead."""
    monkeypatch.setattr(lexical, "BUCKET", 16)
    docs, items = corpus(2)
    docs += [(10_000 - i, items[0][1]) for i in range(200)] + [docs[3]] * 4
    assert got(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    docs = cases.odd_rows()
    docs = [(r[0], r[1]) for r in docs] + [(None, "one two"), (None, "ONE two three"), (70, "ÄÖ ÄÖ äö x2y a_b c-d\x7fe f"), (71, "... --- !"), (72, "w1 " * 3000)]
    items = [(1, "one TWO two"), (1, "one TWO two"), (1, "three"), (2, None), (3, ""), (4, " ,. "), (5, "äö ÄÖ x2y a e f"), (None, "one"), (6, "unseen words"), (7, "w1 w2 w3")]
    assert got(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None), (2, "")], [(1, "a")]), ([(1, "a")], [(1, "a")])])
def test_small_tables(spark, docs, items):
    assert got(spark, docs, items) == brute(docs, items)


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PASS_BYTES", 900)
    docs, items = corpus(3, 150)
    assert got(spark, docs, items) == brute(docs, items)


def test_bounds_pass_over_documents_but_none_that_count():
    """Against exact scores: nobody who reaches the bound is passed over, and most others are."""
    import numpy as np

    docs, items = corpus(4, 600)
    queries = lexical.Queries([i for i, _ in items], [t for _, t in items])
    counts = next(lexical.term_counts([pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]})], queries.vocabulary))
    queries.weigh(np.random.default_rng(0).integers(0, 9000, len(queries.vocabulary)))
    tf = counts.column("tfs").flatten().to_numpy()
    lengths = counts.column("terms").value_lengths().to_numpy()
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * 100)
    at = np.cumsum(lengths) - lengths
    norm = np.sqrt(np.add.reduceat((impact * queries.roots[counts.column("terms").flatten().to_numpy()]) ** 2, at))
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(tf)), pa.int32()), pa.array(impact))
    bucket = lexical.Bucket(pa.RecordBatch.from_arrays([counts.column("doc_id"), pa.array(norm), counts.column("terms"), lists], ["doc_id", "norm", "terms", "impacts"]), queries.roots)
    everyone, kept = np.arange(len(docs)), 0
    for q in range(len(items)):
        scores = bucket.scores(queries, q, everyone)
        bound = np.sort(scores)[-20]
        left = bucket.survivors(queries, q, float(bound))
        assert set(np.flatnonzero(scores >= bound)) <= set(left)
        kept += len(left)
    assert kept < len(items) * len(docs) / 3
