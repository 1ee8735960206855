import math
import random

import pytest

from solvara.llm import knn


def brute(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries: dict = {}
    for i, v in good:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, a in queries.items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def got(spark, rows):
    v = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    q = v.where("vec_id % 50 = 0").groupBy("vec_id").agg({"v": "min"}).toDF("query_id", "v")
    return sorted(map(tuple, knn.top_k(v, q).collect()))


def f32(x):
    import numpy as np

    return float(np.float32(x))


def vectors(seed, n, d=8, groups=12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(groups)]
    return [(i, [f32(c + rng.gauss(0, 0.2)) for c in rng.choice(centres)]) for i in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    rows = vectors(1, 900)
    assert got(spark, rows) == brute(rows)


def test_one_common_vector_and_odd_rows(spark):
    rows = vectors(2, 300) + [(1000 + i, vectors(2, 1)[0][1]) for i in range(300)]
    rows += [(5000, None), (5001, [1.0, None]), (5050, [float("nan")] * 8), (5100, [float("inf")] * 8), (None, rows[0][1]), (5150, [1.0, 2.0]), (5151, [2.0, 1.0]), (5152, [-2.0, 1.0]), (50, rows[1][1]), (7, rows[7][1]), (5200, [1e6] * 8), (5201, [-3e6] * 8), (-50, rows[3][1])]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(50, [1.0])], [(50, [1.0]), (3, [2.0]), (2, [2.0])], [(0, []), (1, [])]])
def test_few_rows(spark, rows):
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("times", [2, 10])
def test_repeated_query_rows_and_equal_vectors(spark, monkeypatch, times):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    rows = vectors(3, 600)
    alike = [(1000 * q + i, rows[q][1]) for q in (0, 50, 100) for i in range(1, 9)]
    rows += alike + [rows[q] for q in range(0, 600, 50) for _ in range(times - 1)] + [alike[0]] * (times - 1) + [rows[7]] * 3
    assert got(spark, rows) == brute(rows)


def test_repeated_query_ids_and_many_lengths(spark):
    rows = [*vectors(4, 200), (50, vectors(5, 1)[0][1]), (100, [9.0] * 8), (100, [-9.0] * 8)]
    rows += [(1000 + 50 * n + i, [float(i + j) for j in range(n)]) for n in range(9, 40) for i in (0, 1, 2)]
    assert got(spark, rows) == brute(rows)


def test_products_up_to_the_longs_range():
    import numpy as np

    big = np.array([[2**31, -(2**31)], [2**31, 2**31 - 1]], dtype=np.int64)
    assert knn.products(big, big[1:]).tolist() == [[2**31], [2**62 + (2**31 - 1) ** 2]]
    low = np.array([[-(2**62), 2]], dtype=np.int64)
    assert knn.products(low, np.array([[2, 0]])).tolist() == [[-(2**63)]]
    with pytest.raises(OverflowError):
        knn.products(low, np.array([[-2, 0]]))


def test_components_and_products_beyond_a_long_are_errors(spark):
    for rows in ([(50, [1e30]), (1, [1.0])], [(50, [3e9, 3e9]), (1, [3e9, 3e9])]):
        with pytest.raises(Exception, match="fit a long"):
            got(spark, rows)


def test_clashing_columns(spark):
    rows = [(i, v, "x", i, -i, 3, 0.5) for i, v in vectors(6, 120)]
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, d long, cell long, rank int, score double")
    v = knn.quantised(wide)
    q = v.where("vec_id % 50 = 0").groupBy("vec_id").agg({"v": "min"}).toDF("query_id", "v")
    assert sorted(map(tuple, knn.top_k(v, q).collect())) == brute([r[:2] for r in rows])
