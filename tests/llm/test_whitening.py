import math
import random

import numpy as np
import pytest

from solvara.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=32):
    """By numpy: ids, exact deviations, eigenvalues, and the whitened rows up to each component's sign."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(good), [sum(c) for c in zip(*(x for _, x in good))]
    off = [[n * a - s for a, s in zip(x, sums)] for _, x in good]
    centred = np.array(off, dtype=float) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return [i for i, _ in good], n, [sum(o * o for o in row) for row in off], values[order] / values.sum(), centred @ directions[:, order] / np.sqrt(values[order])


def f32(x):
    return float(np.float32(x))


def vectors(seed, n, d):
    rng = random.Random(seed)
    scales = [1 + 3 * i / d for i in range(d)]
    return [(i, [f32(rng.gauss(0.3, s)) for s in scales]) for i in range(n)]


def held_against_brute(spark, rows, components=32):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = whitening.whiten(whitening.integers(df), components).collect()
    ids, n, deviations, explained, z = brute(rows, components)
    k = len(explained)
    assert len(out) == len(ids) * k and {r.n for r in out} == {n}
    assert sorted((r.vec_id, r.deviation) for r in out if r.component == 1) == sorted(zip(ids, deviations))
    place = {i: j for j, i in enumerate(ids)}
    got = np.zeros((len(ids), k))
    for r in out:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    signs = np.sign((got * z).sum(0))
    assert np.abs(got * signs - z).max() < 1e-6
    error = np.abs((got - got.mean(0)).T @ (got - got.mean(0)) / n - np.eye(k)).max()
    assert len({r.identity_error for r in out}) == 1 and abs(out[0].identity_error - error) < 1e-9 and error < 1e-6


@pytest.mark.parametrize("n, d", [(300, 8), (200, 40)])
def test_equals_numpy(spark, n, d):
    held_against_brute(spark, vectors(1, n, d))


def test_many_blocks(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("BLOCK_COLUMNS", 8), ("BLOCKS_A_TASK", 2)):
        monkeypatch.setattr(whitening, name, value)
    held_against_brute(spark, vectors(2, 205, 20))


def test_rows_that_take_no_part(spark):
    rows = vectors(3, 60, 4)
    held_against_brute(spark, rows + [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan")] * 4), (103, [float("inf"), 0.0, 0.0, 0.0])])
    longer = spark.createDataFrame(rows + [(200, [1.0] * 5), (201, [])], SCHEMA)
    assert whitening.whiten(whitening.integers(longer)).select("vec_id").distinct().count() == 60


def test_null_and_repeated_ids(spark):
    rows = vectors(4, 40, 3)
    df = spark.createDataFrame(rows + [(None, rows[0][1]), (5, rows[6][1]), rows[7]], SCHEMA)
    out = whitening.whiten(whitening.integers(df)).collect()
    assert len(out) == 43 * 3 and sum(r.vec_id is None for r in out) == 3 and sum(r.vec_id == 5 for r in out) == 6 and out[0].n == 43


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]])
def test_without_variance(spark, rows):
    out = whitening.whiten(whitening.integers(spark.createDataFrame(rows, SCHEMA)))
    assert out.collect() == [] and [f"{c} {t}" for c, t in out.dtypes] == [x.strip().replace("long", "bigint") for x in whitening.WHITENED.split(",")]


def test_directions_without_variance_go(spark):
    rng = random.Random(5)
    rows = [(i, [a, b, a, 7.0]) for i, (a, b) in enumerate((rng.randrange(9) / 1.0, rng.randrange(9) / 1.0) for _ in range(50))]
    out = whitening.whiten(whitening.integers(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {r.component for r in out} == {1, 2} and out[0].identity_error < 1e-9


def test_huge_entries(spark):
    """What doesn't fit a long is null; the rest goes on in doubles."""
    rows = vectors(6, 30, 3) + [(99, [5e16, 0.0, 0.0]), (98, [5e16, 1.0, 0.0]), (97, [-5e16, 0.0, 1.0]), (96, [5e16, 1.0, 0.0]), (95, [1e30, 0.0, 0.0])]
    out = whitening.whiten(whitening.integers(spark.createDataFrame(rows, SCHEMA))).collect()
    assert all(r.deviation is None for r in out) and len(out) == 34 * len({r.component for r in out})
