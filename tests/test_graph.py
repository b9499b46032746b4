"""Snapshots, as-of, layers, structure and correlation graphs on small known cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmament.functions.stats import normal_two_sided, student_two_sided
from firmament.operators import correlation as K
from firmament.operators import graph as G
from firmament.operators import structure as ST
from firmament.operators import windows as Wn

D = dt.date
EDGE = "snap_date date, win int, src long, dst long, weight double"


def edges(spark, rows):
    return spark.createDataFrame([(d, 60, a, b, float(w)) for d, a, b, w in rows], EDGE)


def test_asof_is_strict_and_goes_stale(spark):
    snaps = spark.createDataFrame([(D(2020, 1, 10),), (D(2020, 2, 10),)], "snap_date date")
    want = {D(2020, 1, 10): None, D(2020, 1, 11): D(2020, 1, 10), D(2020, 2, 10): D(2020, 1, 10),
            D(2020, 2, 11): D(2020, 2, 10), D(2020, 8, 11): D(2020, 2, 10), D(2020, 8, 12): None}
    days = spark.createDataFrame([(d,) for d in want], "date date")
    got = G.asof_snapshot(days, snaps)
    assert {r["date"]: r["snap_date"] for r in got.collect()} == want
    a = G.time_audit(got).first()
    assert (a["days"], a["days_with_graph"], a["violations"], a["max_age"]) == (6, 4, 0, 183)


def test_layers(spark):
    d = D(2020, 1, 1)
    rows = [("COMPETES_WITH", 1, 2, 3.0, 0), ("SUPPLIES_TO", 2, 1, 2.0, 1), ("SECTOR_PEER", 1, 3, 9.0, 2),
            ("ANALYZES", 2, 3, 1.0, 3), ("COMPETES_WITH", 4, 4, 5.0, 4), ("COMPETES_WITH", 1, 99, 5.0, 5)]
    s = spark.createDataFrame([(d, 60, *r) for r in rows], "snap_date date, win int, layer string, src long, dst long, weight double, seq long")
    uni = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4)], "firm long, pos int")

    def graph(**kw):
        return {(r["src"], r["dst"]): r["weight"] for r in G.layer_graph(s, uni, **kw).collect()}

    assert graph() == {(1, 2): 5.0}
    assert graph(types=["SECTOR_PEER"], exclude=[]) == {(1, 3): 9.0}
    assert graph(exclude=[]) == {(1, 2): 5.0, (1, 3): 9.0, (2, 3): 1.0}
    twice = s.unionByName(spark.createDataFrame([(d, 60, "COMPETES_WITH", 2, 1, 7.0, 9)], s.schema))
    assert {(r["src"], r["dst"]): r["weight"] for r in G.layer_graph(twice, uni).collect()} == {(1, 2): 9.0}


def test_structure_of_a_known_graph(spark):
    d0, d1, d2 = D(2020, 1, 1), D(2020, 1, 21), D(2020, 2, 10)
    g = edges(spark, [(d0, 1, 2, 1), (d0, 2, 3, 1), (d0, 1, 3, 1), (d0, 4, 5, 1), (d1, 1, 2, 1), (d1, 4, 5, 1), (d1, 5, 6, 1)])
    snaps = spark.createDataFrame([(d, 60) for d in (d0, d1, d2)], "snap_date date, win int")
    uni = spark.createDataFrame([(i, i) for i in range(1, 7)], "firm long, pos int")
    sec = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b")], "firm long, sector string")
    got = {r["snap_date"]: r for r in ST.structure(g, snaps, uni, sec).collect()}
    a, b, c = got[d0], got[d1], got[d2]
    assert (a["edges"], a["max_degree"], a["isolated"], a["components"], a["largest_comp"]) == (4, 2, 1, 2, 3)
    assert a["density"] == pytest.approx(8 / 30) and a["mean_degree"] == pytest.approx(8 / 6)
    assert a["clustering"] == pytest.approx(0.6) and a["pct_within_sector"] == 50.0 and a["edge_persistence"] is None
    assert b["edge_persistence"] == 0.5 and b["components"] == 2
    assert (c["edges"], c["components"], c["clustering"], c["pct_within_sector"]) == (0, 0, 0.0, None)
    assert c["edge_persistence"] == 0.0
    d = {r["metric"]: r for r in ST.describe(ST.structure(g, snaps, uni, sec), ["edges"]).collect()}["edges"]
    assert (d["min"], d["median"], d["max"]) == (0.0, 3.0, 4.0)


def test_components_of_chains_and_hubs(spark):
    """A long chain and a hub holding most edges, several snapshots at once."""
    d0, d1 = D(2020, 1, 1), D(2020, 1, 21)
    chain = [(d0, i, i + 1, 1) for i in range(1, 60)]
    hub = [(d1, 1000, i, 1) for i in range(1, 120)] + [(d1, 2000, 2001, 1)]
    hub = [(d, min(a, b), max(a, b), w) for d, a, b, w in hub]
    got = ST.connected_components(edges(spark, chain + hub)).collect()
    assert {r["component"] for r in got if r["snap_date"] == d0} == {1}
    assert sorted({r["component"] for r in got if r["snap_date"] == d1}) == [1, 2000]
    assert len(got) == 60 + 122


def test_triangles_against_brute_force(spark):
    rng = np.random.default_rng(3)
    A = np.triu(rng.random((25, 25)) < 0.25, 1)
    A[0, 1:] = True  # a hub
    g = edges(spark, [(D(2020, 1, 1), int(i), int(j), 1) for i, j in zip(*np.nonzero(A))])
    S = (A | A.T).astype(int)
    deg, tri = S.sum(0), np.diag(S @ S @ S) / 2
    want = {i: (2 * tri[i] / (deg[i] * (deg[i] - 1)) if deg[i] > 1 else 0.0) for i in range(25) if deg[i]}
    got = {r["node"]: r["clustering"] for r in ST.clustering(g).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_rolling_snapshots_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = D(2020, 1, 1)
    raw = [(base + dt.timedelta(int(rng.integers(0, 90))), "L", 1, int(rng.integers(2, 4)), float(rng.random())) for _ in range(80)]
    e = spark.createDataFrame(raw, "date date, layer string, src long, dst long, conf double")
    got = {(r["snap_date"], r["win"], r["dst"]): r["weight"] for r in G.rolling_snapshots(e, "2020-01-01", (5, 30)).collect()}
    want = {}
    for i in range(0, 10):
        s = base + dt.timedelta(20 * i)
        for w in (5, 30):
            for d, _, _, dst, c in raw:
                if s - dt.timedelta(w) < d <= s:
                    want[s, w, dst] = want.get((s, w, dst), 0) + c
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_correlation_graph_and_gap(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(80, 8))
    X[:, 1] += X[:, 0]
    X[:, 3] -= 2 * X[:, 2]
    X[:, 7] = 1.0  # constant: correlates with nothing
    base = D(2020, 1, 1)
    cal = spark.createDataFrame([(base + dt.timedelta(t), t) for t in range(80)], "date date, t int")
    p = spark.createDataFrame([(t, i, i, float(X[t, i])) for t in range(80) for i in range(8)], "t int, pos int, firm long, x double")
    sector = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(8)], "firm long, sector string")
    snap = base + dt.timedelta(75)
    snaps = spark.createDataFrame([(snap, 252)], "snap_date date, win int")
    win = K.windows_before(Wn.firm_series(p).join(sector, "firm"), snaps, cal, 70)
    C = np.nan_to_num(np.abs(np.corrcoef(X[5:75, :7].T)))
    C = np.pad(C, ((0, 1), (0, 1)))
    top = K.corr_top_pairs(win, snaps.withColumn("k", F.lit(2))).collect()
    assert {(r["src"], r["dst"]) for r in top} == {(0, 1), (2, 3)}
    assert sorted(r["weight"] for r in top) == pytest.approx(sorted([C[0, 1], C[2, 3]]))
    linked = [(0, 1), (2, 3), (0, 2), (4, 5), (4, 6), (5, 6), (0, 4), (1, 5), (2, 6)]
    e = spark.createDataFrame([(snap, 252, "L", a, b) for a, b in linked], "snap_date date, win int, layer string, src long, dst long")
    r = K.stratified_gap(win, e).first()
    i, j = np.triu_indices(8, 1)
    on = np.array([(a, b) in linked for a, b in zip(i, j)])
    same = (i < 4) == (j < 4)
    c = C[i, j]
    assert r["n_linked"] == 9 and r["overall"] == pytest.approx(c[on].mean() - c[~on].mean())
    assert r["same_sector"] == pytest.approx(c[on & same].mean() - c[~on & same].mean())
    assert r["cross_sector"] == pytest.approx(c[on & ~same].mean() - c[~on & ~same].mean())
    assert K.stratified_gap(win, e.limit(4)).isEmpty()


def test_tail_probabilities():
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert student_two_sided(0.0, 5) == 1.0
    assert student_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)


def test_edges_before_the_base_date_count(spark):
    rows = [("1994-12-01", "L", 1, 2, 1.0), ("1995-01-01", "L", 1, 2, 1.0), ("1993-01-01", "L", 1, 2, 1.0)]
    e = spark.createDataFrame(rows, "date string, layer string, src long, dst long, conf double").withColumn("date", F.to_date("date"))
    got = {(str(r["snap_date"]), r["win"]): r["weight"] for r in G.rolling_snapshots(e, "1995-01-02", (20, 252), 20).collect()}
    assert got["1995-01-02", 252] == 2.0 and got["1995-01-02", 20] == 1.0 and ("1995-01-22", 20) not in got


def test_unknown_sectors_are_one_sector(spark):
    from firmament.operators import correlation as K
    series = spark.createDataFrame([(i, i, None if i < 2 else "A", [float((t * (i + 2)) % 7) for t in range(80)]) for i in range(4)],
                                   "pos int, firm long, sector string, xs array<double>")
    cal = spark.createDataFrame([(t,) for t in range(80)], "t int").select("t", F.date_add(F.to_date(F.lit("2020-01-01")), F.col("t")).alias("date"))
    snaps = spark.createDataFrame([(60,)], "win int").select(F.to_date(F.lit("2020-03-20")).alias("snap_date"), "win")
    w = K.windows_before(series, snaps, cal)
    edges = snaps.select("snap_date", "win", F.lit("L").alias("layer"), F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("src"), F.lit(b).cast("long").alias("dst"))
                                                                                       for a, b in ((0, 1), (0, 2), (2, 3))])).alias("e")).select("snap_date", "win", "layer", "e.*")
    same = {(r["src"], r["dst"]): r["same"] for r in K.linked_correlations(w, edges).collect()}
    assert same == {(0, 1): True, (0, 2): False, (2, 3): True}
    assert {r["same"]: r["pairs"] for r in K.strata_totals(w).collect()} == {True: 2, False: 4}


def test_windows_are_made_from_one_row_a_pair(spark):
    """Rows of the overlapping windows are neither shuffled nor aggregated, whatever days a pair has."""
    day = lambda n: D(2020, 1, 1) + dt.timedelta(days=n)
    rows = [(day(n), "x", 1, 2, float(n)) for n in (0, 0, 3, 7, 25, 90)] + [(day(3), "x", 2, 3, 0.5), (day(4), "x", 4, 5, None), (None, "x", 1, 2, 9.0)]
    e = spark.createDataFrame(rows, "date date, layer string, src long, dst long, conf double")
    snaps = G.rolling_snapshots(e, "2020-01-01", (5, 30))
    plan = snaps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")
    want = {}
    for win in (5, 30):
        for i in range(20):
            for d, _, a, b, c in rows:
                if d is not None and i * 20 - win < (d - day(0)).days <= i * 20:
                    key = (day(i * 20), win, a, b)
                    want[key] = c if want.get(key) is None else want[key] + (c or 0.0)
    assert {(r["snap_date"], r["win"], r["src"], r["dst"]): r["weight"] for r in snaps.collect()} == want


def test_edges_outside_the_universe_leave_their_days(spark):
    rows = [(D(2020, 1, 1), "x", 1, 2, 1.0), (D(2020, 1, 1), "x", 1, 2, 2.0), (D(2020, 3, 1), "x", 1, 9, 1.0), (D(2020, 3, 1), "y", 8, 9, 1.0),
            (D(2020, 6, 1), "x", 2, 1, 1.0)]
    e = spark.createDataFrame(rows, "date date, layer string, src long, dst long, conf double")
    uni = spark.createDataFrame([(0, 1), (1, 2)], "pos int, firm long")
    near = G.daily_inside(e, uni)
    got = sorted(((str(r["date"]), r["layer"], r["src"], r["dst"], r["conf"]) for r in near.collect()), key=str)
    assert got == [("2020-01-01", "x", 1, 2, 3.0), ("2020-03-01", None, None, None, None), ("2020-06-01", "x", 2, 1, 1.0)]
    key = lambda df: sorted((r["snap_date"], r["win"]) for r in df.collect())
    assert key(G.snapshots_of_days(near, "2020-01-01")) == key(G.snapshot_dates(G.rolling_snapshots(e, "2020-01-01")))
    whole, inside = G.rolling_snapshots(e, "2020-01-01"), G.rolling_snapshots(near.where("src is not null"), "2020-01-01")
    edges_of = lambda df: sorted(map(tuple, G.layer_graph(df, uni).collect()))
    assert edges_of(whole) == edges_of(inside) != []
