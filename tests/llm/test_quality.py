import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest

from solvara.llm import quality
from tests.llm import cases


def tables(spark, n=240):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(cases.words(rng, 60)) if good else rng.choice(["buy now!! ", "| a | b ", "spam "]) * 30
        docs.append((i, text, "en", "s", 1, 1, 1, "b", 0.5))
        labels.append((i, int(good)))
    return docs, labels


def test_learns_only_from_rows_not_held_out(spark):
    docs, labels = tables(spark)
    df = spark.createDataFrame(docs, cases.SCHEMA)
    out = zlib.crc32
    wrong = [(i, 1 - q if out(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    a, b = (quality.fit(df, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, wrong))
    assert (a.vectors == b.vectors).all() and (a.output == b.output).all()


def test_held_out_accuracy_and_bounds(spark):
    docs, labels = tables(spark)
    df = spark.createDataFrame(docs, cases.SCHEMA)
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality.scored(df.drop("score"), model).withColumn("held_out", quality.held_out()).collect()
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.95
    assert len(quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"), rows=10).output) == 2


def test_table_equals_the_network():
    """The looked-up score is the softmax of averaged vectors."""
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=(1 << quality.BUCKET_BITS, quality.WIDTH)).astype(np.float32), rng.normal(size=(2, quality.WIDTH)).astype(np.float32))
    texts = ["a few words here here", "", None, "é ü 日本", "x" * 6000]
    for (buckets, counts), text in zip(quality.counted(pa.array(texts)), texts):
        mean = (counts / counts.sum()) @ model.vectors[buckets]
        z = model.output @ mean
        assert abs(np.exp(z[1]) / np.exp(z).sum() - 1 / (1 + np.exp(-(model.table()[buckets] * counts).sum() / counts.sum()))) < 1e-5


def test_nulls_blanks_and_no_labels(spark):
    rows = [(1, None), (None, ""), (2, " \n"), (2, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs, labels = tables(spark)
    model = quality.fit(spark.createDataFrame(docs, cases.SCHEMA), spark.createDataFrame([*labels, (None, 1), (3, None), (4, 7)], "doc_id long, quality int"))
    scores = {r.score for r in quality.scored(df, model).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1
    none = quality.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert none is None and {r.score for r in quality.scored(df, none).collect()} == {0.5}
    assert quality.scored(df.limit(0), model).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_accuracy_on_held_out_labels(spark, folder):
    got = quality.op9_quality(spark, folder).where("held_out").toPandas()
    labels = ds.dataset(f"{folder}/labels.parquet").to_table(columns=["doc_id", "quality"]).to_pandas()
    both = got.merge(labels, on="doc_id")
    assert len(both) and (both.predicted == both.quality).mean() > 0.95


def test_features_and_scores_as_counted_plainly():
    rng = random.Random(9)
    alphabet = ["a", "b", "ab", "é", "日本", "x" * 30, "😀"]
    texts = ["", " ", "a", "\t\n", None, "ab ab ab", " ".join(rng.choice(alphabet) for _ in range(60_000))]
    texts += ["".join(rng.choice([*alphabet, " ", "\t", "\n", "  "]) for _ in range(rng.randint(1, 80))) for _ in range(60)]

    def alone(text, group):
        return int(list(quality.features(pa.array([text])))[group][0][0])

    known = {}

    def bucket(text, group):
        if (text, group) not in known:
            known[text, group] = alone(text, group)
        return known[text, group]

    model = quality.Model(np.random.default_rng(3).normal(size=(1 << quality.BUCKET_BITS, 2)).astype(np.float32), np.array([[0.5, -1], [2, 0.25]], dtype=np.float32))
    for text, (buckets, counts) in zip(texts, quality.counted(pa.array(texts))):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        wanted = {0: 1}  # the constant feature
        for b in [*(bucket(w, 0) for w in words), *(bucket(f"{a} {b}", 1) for a, b in zip(words, words[1:]))]:
            wanted[b] = wanted.get(b, 0) + 1
        padded = f" {text or ''} "
        for n, mix in zip(quality.NGRAMS, quality._MIX.tolist()):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if not re.search(r"[\x20\x09-\x0D]", gram[1:-1]):
                    h = sum(ord(c) * k for c, k in zip(gram, quality._CHAR.tolist())) * mix % 2**32 >> 32 - quality.BUCKET_BITS
                    wanted[h] = wanted.get(h, 0) + 1
        assert dict(zip(buckets.tolist(), counts.tolist())) == wanted
        share = {b: c / sum(wanted.values()) for b, c in wanted.items()}
        assert abs(sum(model.table()[b] * s for b, s in share.items()) - float((model.output[1] - model.output[0]).astype(float) @ sum(model.vectors[b].astype(float) * s for b, s in share.items()))) < 1e-6


def test_a_very_long_text_scores_as_its_average(spark):
    model = quality.Model(np.random.default_rng(3).normal(size=(1 << quality.BUCKET_BITS, 2)).astype(np.float32), np.array([[0.5, -1], [2, 0.25]], dtype=np.float32))
    texts = ["one two three " * 300_000 + "end", "", None, "short"]
    got = quality.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for row, (buckets, counts) in zip(sorted(got), quality.counted(pa.array(texts))):
        assert abs(row.score - 1 / (1 + math.exp(-float(model.table()[buckets] @ counts) / counts.sum()))) < 1e-9


def test_descent_steps_as_written_out():
    samples = [(np.array([1, 5], np.int32), np.array([2, 1], np.float32), 1), (np.array([5, 9, 11], np.int32), np.array([1, 1, 3], np.float32), 0), (np.array([0], np.int32), np.array([4], np.float32), 1)]
    model = quality.train(samples, seed=5)
    rng = np.random.default_rng(5)
    width = quality.WIDTH
    v = rng.uniform(-1 / width, 1 / width, (1 << quality.BUCKET_BITS, width)).astype(np.float32)
    vectors = {b: [float(x) for x in v[b]] for b in (0, 1, 5, 9, 11)}
    out = [[0.0] * width, [0.0] * width]
    steps, done = 50 * len(samples), 0
    for _ in range(50):
        for i in rng.permutation(len(samples)):
            buckets, counts, label = (x.tolist() if hasattr(x, "tolist") else x for x in samples[i])
            share = [c / sum(counts) for c in counts]
            mean = [sum(s * vectors[b][j] for b, s in zip(buckets, share)) for j in range(width)]
            odds = [math.exp(sum(w * m for w, m in zip(out[c], mean))) for c in (0, 1)]
            error = [o / sum(odds) - (c == label) for c, o in enumerate(odds)]
            rate = quality.STEP * (1 - done / steps)
            back = [sum(error[c] * out[c][j] for c in (0, 1)) for j in range(width)]
            out = [[out[c][j] - rate * error[c] * mean[j] for j in range(width)] for c in (0, 1)]
            for b, s in zip(buckets, share):
                vectors[b] = [x - rate * s * g for x, g in zip(vectors[b], back)]
            done += 1
    assert np.allclose(model.output, out, atol=1e-4) and all(np.allclose(model.vectors[b], x, atol=1e-4) for b, x in vectors.items())
    assert np.array_equal(model.vectors[2], v[2])
