import numpy as np
import pytest

from solvara.llm import sharding
from tests.llm import cases


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000, 65536, 65537])
def test_permutation_and_its_inverse(n):
    to = sharding.permuted(np.arange(n), n, 5)
    assert sorted(to) == list(range(n))
    assert (sharding.permuted(to, n, 5, inverse=True) == np.arange(n)).all()
    shard, slot = sharding.place_of(np.arange(n), n, 4, 5)
    assert (sharding.row_at(shard, slot, n, 4, 5) == np.arange(n)).all()


def test_seeds_differ():
    assert (sharding.permuted(np.arange(1000), 1000, 1) != sharding.permuted(np.arange(1000), 1000, 2)).mean() > 0.9


@pytest.mark.parametrize("rows", [cases.rows(), cases.odd_rows(), [], [cases.rows()[0]]])
def test_every_row_gets_a_place(spark, rows):
    df = spark.createDataFrame(rows, cases.SCHEMA).select("doc_id", "cid").repartition(4)
    got = sharding.shard_rows(df, 4, 9, "doc_id", "cid").collect()
    n = len(rows)
    assert len(got) == n and sorted(r.row_number for r in got) == list(range(n))
    places = {r.row_number: (r.shard, r.slot) for r in got}
    if n:
        shard, slot = sharding.place_of(np.arange(n), n, 4, 9)
        assert places == {i: (shard[i], slot[i]) for i in range(n)}
        order = sorted(((r[0] is not None, r[0] or 0, r[5]) for r in rows))
        assert [((r.doc_id is not None), r.doc_id or 0, r.cid) for r in sorted(got, key=lambda r: r.row_number)] == order
    sizes = [sum(r.shard == s for r in got) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_partitioning_does_not_matter(spark):
    df = spark.createDataFrame(cases.rows(), cases.SCHEMA).select("doc_id")
    one, many = (sorted(map(tuple, sharding.shard_rows(df.repartition(n), 3, 4, "doc_id").collect())) for n in (1, 7))
    assert one == many
