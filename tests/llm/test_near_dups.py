import random
import re

import pytest

from solvara.llm import joins, near_dups
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Component (as the set of its row numbers) of each row."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids: dict[int, list] = {}
    for i, r in enumerate(rows):
        ids.setdefault(root(i), []).append(r[0])
    least = {k: min([x for x in v if x is not None], default=None) for k, v in ids.items()}
    return sorted(((r[0], len(sets[i]), least[root(i)], r[0] == least[root(i)]) for i, r in enumerate(rows)), key=str)


def got(spark, rows, parts=4):
    df = spark.createDataFrame(rows, cases.SCHEMA).repartition(parts)
    return sorted((tuple(r)[:4] for r in near_dups.near_duplicates(df).collect()), key=str)


def chain(seed, n, keep):
    """Copies of copies, each with a few more changes, so that components hold pairs below the bound."""
    rng = random.Random(seed)
    base = cases.words(rng, 90, 3000)
    texts = [base]
    for _ in range(n - 1):
        w = list(rng.choice(texts))
        for _ in range(rng.randrange(0, keep)):
            w[rng.randrange(len(w))] = f"c{rng.randrange(10**6)}"
        texts.append(w)
    return [(i, " ".join(w), "en", "s", 1, 1, 1, "b", 0.1) for i, w in enumerate(texts)]


@pytest.mark.parametrize("rows", [cases.rows(), cases.odd_rows(), []])
def test_equals_brute_force(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_large_group_with_links_below_the_bound(spark):
    rows = chain(4, 220, 5)
    assert got(spark, rows) == brute(rows)


def test_block_comparison_alone(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", 500)  # many blocks a bucket
    rows = chain(5, 120, 6)
    assert got(spark, rows) == brute(rows)


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 330)] + [(400, i) for i in range(401, 440)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    found = {r.node: r.component for r in joins.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert joins.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_rows_without_an_id(spark):
    """Rows are looked up by id and text: those without an id don't meet all classes of such rows."""
    rng = random.Random(6)
    texts = [" ".join(cases.words(rng, 30, 5000)) for _ in range(1500)]
    texts += [t + " more" for t in texts] + [texts[0]] * 2000
    rows = [(None if i % 10 else i, t, "en", "s", 1, 1, 1, "b", 0.1) for i, t in enumerate(texts)]
    found = got(spark, rows)
    ids: dict = {}
    for (d, t, *_), base in zip(rows, [*range(1500), *range(1500), *[0] * 2000]):
        ids.setdefault(base, []).append(d)
    least = {b: min((x for x in v if x is not None), default=None) for b, v in ids.items()}
    want = sorted(((r[0], len(shingles(r[1])), least[b], r[0] == least[b]) for r, b in zip(rows, [*range(1500), *range(1500), *[0] * 2000])), key=str)
    assert found == want
