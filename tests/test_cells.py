"""Search over cells against the full scan: ties, zero vectors, hot cells, few vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import cells, vectors


def clustered(seed, n=600, dim=8, groups=12, spread=0.05):
    r = np.random.default_rng(seed)
    around = r.normal(size=(groups, dim))
    v = around[r.integers(0, groups, n)] + spread * r.normal(size=(n, dim))
    v[n // 2 : n // 2 + n // 6] = v[0]  # copies: ties in one hot cell
    v[-3:] = 0
    return v


def table(spark, v, name="item_id"):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"{name} long, v array<double>")


@pytest.mark.parametrize("k", [1, 5, 700])
def test_cells_equal_the_full_scan(spark, tmp_path, k):
    v = clustered(1)
    items, queries = table(spark, v), table(spark, np.concatenate([v[:20], -v[:3], np.zeros((1, 8))]), "query_id")
    found = cells.Cells.build(items, str(tmp_path / "c"))
    assert found.size.sum() == len(v) and cells.ZERO in found.cell
    wanted = vectors.vector_search(items, queries, k, decimals=6)
    assert sorted(map(tuple, found.search(queries, k, decimals=6).collect())) == sorted(map(tuple, wanted.collect()))


def test_most_cells_are_skipped(spark, tmp_path):
    v = clustered(2)
    found = cells.Cells.build(table(spark, v), str(tmp_path / "c"), cells=20)
    report = found.report(table(spark, v[:50], "query_id")).agg(F.sum("n").alias("n"), F.sum("n_read").alias("read")).first()
    assert report.n == 50 * len(v) and report.read < 0.5 * report.n


def test_no_bound_is_exceeded():
    r = np.random.default_rng(3)
    v = vectors.unit(r.normal(size=(500, 6)))
    center = cells.centers_of(v, 10)
    near = (v @ center.T).argmax(axis=1)
    radius = np.array([np.arccos(np.clip((v[near == c] @ center[c]), -1, 1)).max(initial=0) for c in range(len(center))])
    found = cells.Cells("", None, np.arange(len(center)), center, radius, np.bincount(near, minlength=len(center)))
    queries = vectors.unit(r.normal(size=(100, 6)))
    bound = found.bounds(queries)
    for c in range(len(center)):
        if (near == c).any():
            assert ((queries @ v[near == c].T).max(axis=1) <= bound[:, c]).all()


def test_few_or_no_vectors(spark, tmp_path):
    one = table(spark, np.array([[0.0, 2.0]]))
    queries = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "query_id long, v array<double>")
    got = cells.Cells.build(one.unionByName(spark.createDataFrame([(9, None)], one.schema)), str(tmp_path / "a")).search(queries)
    assert [tuple(r) for r in got.collect()] == [(1, 1, 0, 1.0)]
    none = cells.Cells.build(one.limit(0), str(tmp_path / "b"))
    assert none.search(queries).count() == 0 and [tuple(r) for r in none.report(queries).collect()] == [(1, 0, 0)]
    assert cells.Cells.build(one, str(tmp_path / "d")).search(queries.limit(0)).count() == 0
