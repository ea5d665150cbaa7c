"""Nearest neighbours in blocks: the same as by brute force, and without stored visits."""

from pathlib import Path

import numpy as np
import pytest

from featmart.operators import neighbors


def brute(queries, points, ids, own, k):
    found = []
    for i, q in enumerate(queries):
        d = ((q - points) ** 2).sum(axis=1)
        d[own[i] == ids] = np.inf
        top = np.lexsort((ids, d))[:k]
        found += [(i, ids[t], d[t]) for t in top if np.isfinite(d[t])]
    return found


@pytest.mark.parametrize("dims, spread, shift", [(1, 3, 0), (2, 2, 1e6), (8, 5, -3), (64, 1000, 1e3)])
def test_best_k_equals_brute_force(dims, spread, shift):
    """Ties, copies, a far centre and rows that are no numbers."""
    rng = np.random.default_rng(dims)
    points = rng.integers(0, spread, (300, dims)) / 7 + shift
    points[::5] = points[0]
    points[7, 0], points[9, 0] = np.nan, np.inf
    ids = rng.permutation(300).astype(np.int64)
    queries, own = points[::-1], ids[::-1]
    for k in (1, 4, 400):
        expected = brute(queries, points, ids, own, k)
        found = list(zip(*neighbors.best_k(queries, points, ids, own, k)))
        assert found == expected
        last = np.full(300, np.inf)
        for i, _, d in expected:
            last[i] = d
        assert list(zip(*neighbors.best_k(queries, points, ids, own, k, last))) == expected


def test_copies_of_one_point_stay_few():
    """Of many equal points only k besides the query's own are compared."""
    points, ids = np.ones((20_000, 64)), np.arange(20_000)
    assert len(neighbors._copies_cut(points, ids, 4)) == 4
    rows, keys, dists = neighbors.best_k(points, points, ids, ids, 3)
    assert keys[:3].tolist() == [1, 2, 3] and keys[-3:].tolist() == [0, 1, 2] and not dists.any()


def test_visits_are_not_stored(spark):
    """In many dimensions a query visits most boxes: what is stored stays in proportion to the rows."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    folder = Path(spark.conf.get("spark.checkpoint.dir"))

    def stored():
        return sum(f.stat().st_size for f in folder.rglob("part-*"))

    before = stored()
    got = {(r["id"], r["neighbour"], r["place"]) for r in neighbors.nearest(df, df, 2, box_rows=60).collect()}
    assert stored() - before < 8 * x.nbytes
    ids = np.arange(len(x))
    places = brute(x, x, ids, ids, 2)
    assert got == {(i, n, j % 2) for j, (i, n, _) in enumerate(places)}
