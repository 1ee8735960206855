import re

import pytest

from solvara.llm import substrings, textkit
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def brute(rows, k=13):
    first: dict[tuple, int] = {}
    split = [WORD.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, split):
        d = LAST if r[0] is None else r[0]
        for i in range(len(w) - k + 1):
            t = tuple(w[i : i + k])
            first[t] = min(first.get(t, LAST), d)
    out = []
    for r, w in zip(rows, split):
        d, gone = LAST if r[0] is None else r[0], set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out.append((r[0], " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    return sorted((tuple(r) for r in substrings.without_repeats(df, **options).select("doc_id", "text", "n_words", "n_removed").collect()), key=str)


def repeats():
    rows = cases.rows(6)
    same = ("the same " * 30 + "line of words that repeats within and across documents ") * 3
    return rows + [(500 + i, f"{rows[i][1]} {same} tail{i}", "en", "s", 1, 1, 1, "b", 0.1) for i in range(8)]


@pytest.mark.parametrize("rows", [repeats(), cases.odd_rows(), []])
def test_equals_brute_force(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_one_bucket_and_one_partition(spark):
    assert got(spark, repeats(), buckets=1) == brute(repeats())


def test_hot_minimisers_spread(spark):
    """A passage in most documents: the strings around it don't meet in one bucket, and results stay exact."""
    import random

    rng = random.Random(5)
    passage = " ".join(cases.words(rng, 14, 9000))
    rows = [(i, f"{' '.join(cases.words(rng, 20, 9000))} {passage} {' '.join(cases.words(rng, 20, 9000))}", "en", "s", 1, 1, 1, "b", 0.1) for i in range(400)]
    df = spark.createDataFrame(rows, cases.SCHEMA).select("doc_id", "text").withColumn("tag", substrings.tag())
    hot = substrings.hot_minimisers(df, 13, 32)
    assert hot.bits.any() and got(spark, rows, buckets=32) == brute(rows)

    def most(hot):
        sizes: dict = {}
        for r in substrings.packed_strings(df.repartition(2), 13, 32, hot).where("bucket >= 0").collect():
            sizes[r.bucket] = sizes.get(r.bucket, 0) + len(substrings.unpack(bytes(r.blob), substrings.PACKED)[0])
        return max(sizes.values()) / (sum(sizes.values()) / len(sizes))

    assert 2 * most(hot) < most(substrings.hot_minimisers(df.limit(0), 13, 32))


def test_settled_by_words_where_hashes_clash(spark, monkeypatch):
    """With window hashes of two bits nearly all windows clash; the words decide."""
    rows = repeats()
    docs = [(r[0] if r[0] is not None else LAST, r[1] or "") for r in rows]
    import numpy as np
    import pyarrow as pa

    words = textkit.Words(pa.array([t for _, t in docs]))
    keep = [i for i, c in enumerate(words.counts()) if c >= 13 and c < 200]
    texts = [" ".join(WORD.findall(docs[i][1])).encode() for i in keep]
    blob = substrings.pack([np.array([docs[i][0] for i in keep]), np.zeros(len(keep), np.uint16), np.zeros(len(keep), np.int32), np.array([words.counts()[i] - 12 for i in keep], np.uint8), np.array([len(t) for t in texts], np.int32), np.frombuffer(b"".join(texts), np.uint8)])
    table = pa.table({"bucket": pa.array([0], pa.int32()), "blob": [blob]})
    plain = substrings.spans_in(table, 13).to_pylist()
    monkeypatch.setattr(substrings, "rolled", lambda h, k: textkit.rolled(h, k) >> np.uint64(62))
    clash = substrings.spans_in(table, 13).to_pylist()
    assert plain == clash and plain


def test_untidy_leaves_clean_texts_alone(spark):
    rows = [(1, " a  b\n", "", "", 0, 0, 0, "", 0.0), (2, None, "", "", 0, 0, 0, "", 0.0)]
    assert [r[1] for r in got(spark, rows, tidy=False)] == [" a  b\n", None]


def test_thousands_of_null_ids(spark):
    """Different texts and lengths under one id, with passages of lesser ids: each loses its own words only."""
    import random

    rng = random.Random(11)
    passages = [cases.words(rng, 20, 9000) for _ in range(8)]
    rows = [(i, " ".join(p), "en", "s", 1, 1, 1, "b", 0.1) for i, p in enumerate(passages)]
    for i in range(4000):
        cut = rng.randrange(30)
        own = [f"own{i}x{j}" for j in range(cut + rng.randrange(30))]
        rows.append((None, " ".join(own[:cut] + rng.choice(passages) + own[cut:]), "en", "s", 1, 1, 1, "b", 0.1))
    assert got(spark, rows) == brute(rows)


def test_known_repeats_spread(spark):
    """Many partitions of one chunk each: what is known to repeat doesn't meet in one group."""
    rows = [(i, " ".join(f"w{j}" for j in range(40)), "en", "s", 1, 1, 1, "b", 0.1) for i in range(400)]
    df = spark.createDataFrame(rows, cases.SCHEMA).select("doc_id", "text").withColumn("tag", substrings.tag()).repartition(40)
    sent = substrings.packed_strings(df, 13, 32, substrings.hot_minimisers(df.limit(0), 13, 32)).where("bucket < 0").groupBy("bucket").count().collect()
    assert len(sent) > 12 and max(r["count"] for r in sent) < 10


def test_many_buckets(spark):
    """A chunk sends frames to buckets that it has strings for alone, each string once; results don't depend on their number."""
    rows = repeats()
    df = spark.createDataFrame(rows, cases.SCHEMA).select("doc_id", "text").withColumn("tag", substrings.tag()).repartition(1)
    cold = substrings.hot_minimisers(df.limit(0), 13, 240)
    sent = []
    for buckets in (240, 700_000):
        frames = [substrings.unpack(bytes(r.blob), substrings.PACKED) for r in substrings.packed_strings(df, 13, buckets, cold).where("bucket >= 0").collect()]
        assert all(len(f[0]) for f in frames)
        sent.append(sum(len(f[0]) for f in frames))
    assert sent[0] == sent[1]
    assert got(spark, rows, buckets=3000) == brute(rows)


def test_no_hot_minimiser_is_missed(spark):
    """A minimiser that leads few strings of each chunk but many of all is hot; the filter finds all of them."""
    import numpy as np

    rows = [(i, " ".join(["common", "passage", "here"] + [f"d{i}w{j}" for j in range(12)]), "en", "s", 1, 1, 1, "b", 0.1) for i in range(300)]
    df = spark.createDataFrame(rows, cases.SCHEMA).select("doc_id", "text").withColumn("tag", substrings.tag()).repartition(100)
    import pyarrow as pa

    counts: dict = {}
    for i, text, *_ in rows:
        found = substrings.merged_strings(pa.RecordBatch.from_arrays([pa.array([i]), pa.array([text]), pa.array([i])], ["doc_id", "text", "tag"]), 13)
        for m in found[4]:
            counts[int(m)] = counts.get(int(m), 0) + 1
    led = {m for m, n in counts.items() if n >= max(substrings.LEAST_HOT, sum(counts.values()) / 200)}
    hot = substrings.hot_minimisers(df, 13, 100)
    assert led and hot.has(np.array(sorted(led), np.uint64)).all()
    assert hot.has(np.array(sorted(set(counts) - led), np.uint64)).mean() < 0.2
