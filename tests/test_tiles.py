"""Tiled correlations equal those of one matrix, for any tile size; no task gets more than two blocks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmament.functions import linalg as L
from firmament.operators import correlation as K
from firmament.operators import tiles as T

SNAPS = [(dt.date(2020, 3, 1), 252), (dt.date(2020, 6, 1), 90)]


@pytest.fixture(scope="module")
def case(spark):
    """Two windows of 60 and 20 firms, with a constant series, an equal pair, an opposite pair, a gap in the positions."""
    rng = np.random.default_rng(6)
    rows, mats = [], {}
    for (d, w), n in zip(SNAPS, (60, 20), strict=True):
        X = rng.normal(size=(80, n)) + rng.normal(size=(80, 1)) * rng.random(n)
        X[:, 3], X[:, 5], X[:, 7] = 1.0, X[:, 4], -X[:, 4]
        mats[d] = X
        rows += [(d, w, i if i < 40 else i + 9, 1000 - i, None if i % 7 == 0 else "abc"[i % 3], X[:, i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "snap_date date, win int, pos int, firm long, sector string, w array<double>"), mats


@pytest.mark.parametrize("tile,k", [(1, 5), (7, 5), (7, 100), (7, 10_000), (20, 100), (64, 1), (64, 100)])
def test_top_pairs_equal_one_matrix(spark, case, tile, k):
    windows, mats = case
    got = K.corr_top_pairs(windows, spark.createDataFrame([(*s, k) for s in SNAPS], "snap_date date, win int, k int"), tile).collect()
    for d, X in mats.items():
        C = L.correlation(X)
        i, j = L.top_pairs(C, k)
        want = {(1000 - max(a, b), 1000 - min(a, b)): abs(C[a, b]) for a, b in zip(i.tolist(), j.tolist())}
        have = {(r.src, r.dst): r.weight for r in got if r.snap_date == d}
        assert have.keys() == want.keys() and all(abs(have[p] - want[p]) < 1e-12 for p in want)


@pytest.mark.parametrize("tile", [6, 64])
def test_sums_equal_one_matrix(spark, case, tile):
    windows, mats = case
    links = [(1000 - a, 1000 - b) for a, b in ((0, 1), (4, 5), (19, 2), (8, 11), (3, 4), (0, 7))]
    edges = spark.createDataFrame([(*s, "L", *e) for s in SNAPS for e in [*links, (1000, 5)]], "snap_date date, win int, layer string, src long, dst long")
    sums = T.tile_sums(windows, edges, tile).collect()
    for d, X in mats.items():
        C = np.abs(L.correlation(X))
        sector = np.array(["Unknown" if i % 7 == 0 else "abc"[i % 3] for i in range(len(C))])
        same, upper = sector[:, None] == sector[None, :], np.triu(np.ones_like(C, dtype=bool), 1)
        for flag in (True, False):
            mine = [r for r in sums if r.snap_date == d and r.layer is None and r.same == flag]
            assert sum(r.pairs for r in mine) == (upper & (same == flag)).sum()
            assert sum(r.total for r in mine) == pytest.approx(C[upper & (same == flag)].sum(), rel=1e-12)
        have = {(r.src, r.dst): (r.same, r.total) for r in sums if r.snap_date == d and r.layer}
        assert have.keys() == set(links)
        assert all(have[a, b] == (same[1000 - a, 1000 - b], pytest.approx(C[1000 - a, 1000 - b], abs=1e-12)) for a, b in links)


def test_no_task_gets_more_than_two_blocks(case):
    windows, _ = case
    blocked = T.blocks(windows, 7)
    assert blocked.agg(F.max(F.size("sectors"))).first()[0] == 7
    per = T.tiles(blocked).groupBy("snap_date", "win", "a", "b").count()
    assert per.agg(F.max("count")).first()[0] == 2 and per.where("a = b and count <> 1").isEmpty()
    assert {r.n for r in per.groupBy("snap_date").agg(F.count("*").alias("n")).collect()} == {54, 6}  # one block is empty


def test_nothing_in_nothing_out(spark, case):
    windows, _ = case
    none = windows.where("false")
    assert K.strata_totals(none).isEmpty() and K.corr_top_pairs(none, spark.createDataFrame([(*SNAPS[0], 3)], "snap_date date, win int, k int")).isEmpty()
    assert K.corr_top_pairs(windows, spark.createDataFrame([(*SNAPS[0], 0)], "snap_date date, win int, k int")).isEmpty()
