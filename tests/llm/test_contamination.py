import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from solvara.llm import contamination, textkit
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def lowered(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    best = {}
    for d, text in docs:
        w = lowered(text)
        for item, passage in items:
            b = lowered(passage)
            k, n = min(5, len(b)), min(len(b), len(w))
            if not b or n < k:
                continue
            own = grams(b, k)
            for start in range(len(w) - n + 1):
                win = grams(w[start : start + n], k)
                shared = sum((own & win).values())
                union = sum((own | win).values())
                top = best.get((d, item))
                if 4 * shared >= 3 * union and (top is None or (shared / union, -start) > (top[3], -top[0])):
                    best[d, item] = (start, shared, union, shared / union)
    return sorted(((*k, *v) for k, v in best.items()), key=str)


def got(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.item_id, r.start, r.shared, r.union_size, r.similarity) for r in contamination.leaks(d, b).collect()), key=str)


def planted(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(cases.words(rng, n, 900))) for i, n in enumerate([1, 3, 5, 6, 8, 11, 15, 20, 27, 31, 32, 33, 37, 45, 59, 60, 61, 90, 140])] + [(50, None), (51, "  ")]
    docs = [(i, " ".join(cases.words(rng, 150, 900))) for i in range(10)]
    for i, (item, text) in enumerate(items[:19] * 4):
        w = text.split()
        for _ in range(i // 19):  # substitutions, deletions and insertions
            at = rng.randrange(len(w)) if w else 0
            w[at : at + rng.choice([0, 1, 1])] = rng.choice([["new"], [], ["new"]])
        if i % 5 == 0:
            w = w[len(w) // 12 :]
        docs.append((100 + i, f"{' '.join(cases.words(rng, rng.randrange(0, 40), 900))}\n{' '.join(w).upper()} {' '.join(cases.words(rng, rng.randrange(0, 40), 900))}"))
    docs += [(None, items[9][1]), (7, None), (8, ""), (9, docs[20][1]), (9, docs[20][1]), (100, "repeated id " + items[12][1])]
    return docs, items


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    docs, items = planted(seed)
    assert got(spark, docs, items) == brute(docs, items)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(contamination, "PASS_BYTES", 2000)
    docs, items = planted(1)
    assert got(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = planted(1)
    assert got(spark, [], items) == got(spark, docs, []) == []


@pytest.mark.parametrize("radius", [contamination.RUN_RADIUS, contamination.RADIUS])
def test_blocks_find_all_fingerprints_within_the_radius(radius):
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 300).astype(np.uint64)
    index = contamination.Index(items, np.arange(300), radius)
    prints = np.concatenate([items[:200], rng.integers(0, 2**63, 100).astype(np.uint64)])
    for i in range(200):
        for bit in rng.choice(64, rng.integers(0, radius + 3), replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(bit)
    at, item = index.within(prints)
    near = {(a, b) for a in range(300) for b in range(300) if int(prints[a] ^ items[b]).bit_count() <= radius}
    assert set(zip(at.tolist(), item.tolist())) == near


def test_runs_fit_the_clean_run():
    for n in range(1, 400):
        w = contamination.run_for(n)
        assert w + contamination.stride(w) - 1 <= max(1, contamination.clean_run(n)) <= n


@pytest.mark.parametrize("most", [13, 300, 10**6])
def test_windows_cover_texts_and_have_plain_fingerprints(most):
    rng = random.Random(3)
    texts = [" ".join(cases.words(rng, n)) for n in (0, 3, 4, 5, 12, 13, 14, 40, 301)]
    words = textkit.Words(pa.array(texts))
    hashes = words.hashes()
    start, end, text = contamination.windows_of(words.of, 13)
    prints = contamination.window_prints(contamination.bit_sums(hashes, most), start, end)
    assert set(text) == set(range(3, 9)) and (np.diff(start) > 0).all()
    for s, e, t, p in zip(start, end, text, prints):
        assert words.of[t] <= s < e <= words.of[t + 1] and e - s == min(13, words.counts()[t])
        bits = np.unpackbits(textkit.rolled(hashes[s:e], 5).view(np.uint8).reshape(-1, 8), axis=1)
        assert (np.unpackbits(np.array([p]).view(np.uint8)) == (2 * bits.sum(0) > len(bits))).all()
    for t in range(3, 9):
        own = text == t
        assert start[own].min() == words.of[t] and end[own].max() == words.of[t + 1] and (start[own][1:] <= end[own][:-1]).all()


def test_recall_of_item_sized_windows():
    """Of pairs near the bound and above, the windows alone find 0.9 or more; the runs find the rest."""
    rng = random.Random(11)
    items = [(i, " ".join(cases.words(rng, rng.randrange(12, 90), 5000))) for i in range(40)]
    docs = []
    for i in range(240):
        w = items[i % 40][1].split()
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1])] = rng.choice([["new"], [], ["new"]])
        docs.append((i, " ".join(cases.words(rng, rng.randrange(0, 60), 5000) + w + cases.words(rng, rng.randrange(0, 60), 5000))))
    true = {(d, i) for d, i, *_ in brute(docs, items)}
    held = contamination.Items([i for i, _ in items], [t for _, t in items])
    words = textkit.Words(pa.array([t for _, t in docs]), lower=True)
    by_windows, by_runs = ({(int(p) // 40, int(p) % 40) for x in f(words, words.hashes()) for p in x} for f in (held.by_windows, held.by_runs))
    assert len(true) > 100 and true <= by_runs
    assert len(true & by_windows) >= 0.9 * len(true)
    print(f"recall of windows {len(true & by_windows) / len(true):.3f} of {len(true)}")


def test_texts_shorter_than_an_item(spark):
    """A word before a cut item: the whole text is compared."""
    rng = random.Random(12)
    items = [(i, " ".join(cases.words(rng, n, 5000))) for i, n in enumerate([15, 21, 30, 44, 70])]
    docs = [(100 * i + cut, " ".join(["other", *text.split()[: len(text.split()) - cut]])) for i, text in items for cut in range(1, 12)]
    assert got(spark, docs, items) == brute(docs, items)


def test_a_very_long_text(spark):
    rng = random.Random(13)
    items = [(i, " ".join(cases.words(rng, n, 5000))) for i, n in enumerate([15, 60])]
    words = cases.words(rng, 60_000, 5000)
    docs = [(0, " ".join(words[:50_000] + items[0][1].split() + words[50_000:] + items[1][1].split()))]
    assert [(r[1], r[2], r[5]) for r in got(spark, docs, items)] == [(0, 50_000, 1.0), (1, 60_015, 1.0)]


def kept_by_row(docs, items):
    """Each row judged by its own text."""
    hit = {i for i, *_ in brute([(n, text) for n, (_, text) in enumerate(docs)], items)}
    return sorted((row for n, row in enumerate(docs) if n not in hit), key=str)


def test_filter_keeps_clean_documents(spark):
    docs, items = planted(2)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    kept = contamination.without_leaks(d, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == kept_by_row(docs, items)


def test_filter_judges_rows_of_one_id_by_their_texts(spark):
    rng = random.Random(21)
    item = " ".join(cases.words(rng, 30, 5000))
    clean = [" ".join(cases.words(rng, 40, 5000)) for _ in range(3)]
    docs = [(None, clean[0]), (None, clean[1]), (7, clean[2]), (None, item), (7, f"before {item} after"), (None, None), (7, ""), (7, clean[2])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    kept = contamination.without_leaks(d, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == kept_by_row(docs, [(0, item)]) and kept.count() == 6
