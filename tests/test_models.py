"""Models against published values, textbook solutions and their own identities."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmament.functions import linalg as L
from firmament.operators import windows as Wn
from firmament.plans import validation as V
from firmament.plans import walkforward as WF

# Published values for the seeded panels: (oos_r2, dir_acc), tolerance.
CHAIN = {
    "AR": (0.0019213087699682108, 0.5244444444444445, 1e-12),
    "VAR": (0.1671763068596882, 0.6088888888888889, 1e-12),
    "SparseVAR-LASSO": (0.18522390971248837, 0.6111111111111112, 1e-7),
    "SparseVAR-EN": (0.19400921972454244, 0.6111111111111112, 1e-7),
    "Factor(k=3)": (0.003872420359152251, 0.5133333333333333, 1e-12),
}
QUALITY = {
    "AR/none": (-0.0038029692556027506, 0.49833333333333335, 1e-12),
    "hard/true": (0.09737992395564532, 0.5425, 1e-12),
    "soft/true": (0.09969925891814058, 0.56, 1e-7),
    "hard/wrong": (-0.007107479489100399, 0.5, 1e-12),
    "soft/wrong": (0.09400960140560854, 0.5525, 1e-7),
}


def test_chain_matches_published(spark):
    got = {r["model"]: r for r in V.experiment_1(spark).collect()}
    for model, (r2, acc, tol) in CHAIN.items():
        assert got[model]["oos_r2"] == pytest.approx(r2, abs=tol), model
        assert got[model]["dir_acc"] == pytest.approx(acc, abs=1e-6), model
    assert 0.0 < got["NIRVAR"]["oos_r2"] < got["SparseVAR-EN"]["oos_r2"]


def test_graph_quality_matches_published(spark):
    got = {r["model"]: r for r in V.experiment_2(spark).collect()}
    for model, (r2, acc, tol) in QUALITY.items():
        assert got[model]["oos_r2"] == pytest.approx(r2, abs=tol), model
        assert got[model]["dir_acc"] == pytest.approx(acc, abs=1e-12), model


@pytest.fixture(scope="module")
def W():
    rng = np.random.default_rng(5)
    X = rng.normal(0, 0.01, (120, 6))
    X[1:, 1:] += 0.4 * X[:-1, :-1]
    return X


def test_isolated_firms_are_ar(W):
    none = np.zeros((6, 6), bool)
    for got, want in zip(L.fit_graph_hard(W, none), L.fit_ar(W)):
        assert np.allclose(got, want, atol=1e-12)


def test_full_graph_is_var(W):
    full = ~np.eye(6, dtype=bool)
    for got, want in zip(L.fit_graph_hard(W, full), L.fit_var(W)):
        assert np.allclose(got, want, atol=1e-10)


def test_soft_with_equal_penalties_is_lasso(W):
    soft = L.fit_graph_soft(W, np.zeros((6, 6), bool), alpha=2e-5, linked_penalty=1.0)
    plain = L.fit_sparse(W, 2e-5)
    assert np.allclose(soft[1], plain[1], atol=1e-10)


def test_sparse_satisfies_optimality(W):
    """Subgradient conditions of the penalised problem, with unequal weights and a ridge part."""
    w = np.random.default_rng(1).uniform(0.2, 2.0, (6, 6))
    alpha, l1 = 3e-5, 0.6
    a, B = L.fit_sparse(W, alpha, l1, weights=w)
    Z, Y = W[:-1], W[1:]
    resid = Y - a - Z @ B.T
    grad = resid.T @ (Z - Z.mean(0)) / len(Z) - alpha * (1 - l1) * w ** 2 * B
    bound = alpha * l1 * w
    on = B != 0
    assert np.allclose(grad[on], (bound * np.sign(B))[on], atol=1e-10)
    assert (np.abs(grad[~on]) <= bound[~on] + 1e-10).all()


def test_zero_weight_kills_the_coefficient(W):
    w = np.ones((6, 6))
    w[2, 1] = 0.0
    assert L.fit_sparse(W, 1e-7, weights=w)[1][2, 1] == 0.0


def test_sparse_agrees_with_ml(spark, W):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import LinearRegression

    Z, Y = W[:-1], W[1:]
    df = spark.createDataFrame([(Vectors.dense(z), float(y)) for z, y in zip(Z, Y[:, 3])], ["features", "label"])
    m = LinearRegression(regParam=2e-5, elasticNetParam=1.0, standardization=False, tol=1e-14, maxIter=5000).fit(df)
    assert np.allclose(m.coefficients.toArray(), L.fit_sparse(W, 2e-5)[1][3], atol=1e-5)


def test_factor_ignores_loading_sign(W):
    a, B = L.fit_factor(W, k=2)
    a2, B2 = L.fit_factor(-W, k=2)
    assert np.allclose(B, B2, atol=1e-10) and np.allclose(a, -a2, atol=1e-10)


def test_nirvar_finds_planted_blocks():
    rng = np.random.default_rng(0)
    f = rng.normal(size=(500, 3))
    member = np.repeat([0, 1, 2], 6)
    X = f[:, member] + 0.3 * rng.normal(size=(500, 18))
    d, labels = L.nirvar_labels(X)
    assert d == 3
    for g in range(3):
        assert len(set(labels[member == g])) == 1
    assert len(set(labels)) == 3
    a, B = L.fit_nirvar(X)
    assert not a.any() and not B[np.ix_(member == 0, member == 1)].any()


def test_corr_graph_keeps_edge_count(W):
    linked = np.zeros((6, 6), bool)
    linked[0, 1] = linked[1, 0] = linked[2, 3] = linked[3, 2] = True
    B = L.fit_corr_graph(W, linked)[1]
    assert (np.abs(B) > 0).sum() == 6 + 2 * 2


def _toy(spark, X):
    rows = [(t, i, i, float(v)) for t, r in enumerate(X) for i, v in enumerate(r)]
    return spark.createDataFrame(rows, "t int, pos int, firm long, x double")


def test_sql_ar_equals_numpy_ar(spark, W):
    s = Wn.firm_series(_toy(spark, W))
    key = lambda r: (r["t"], r["firm"])
    a = {key(r): r["pred"] for r in WF.ar_walk_forward(s, 60, 7).collect()}
    b = {key(r): r["pred"] for r in WF.forecast_rows(
        WF.walk_forward(s, [WF.BASELINES[0]], 60, 7)).collect()}
    assert a.keys() == b.keys() and len(a) == 60 * 6
    assert max(abs(a[k] - b[k]) for k in a) < 1e-12


def test_constant_series_takes_minimum_norm(spark):
    X = np.full((40, 2), 0.5)
    X[:, 1] = 0.0
    s = Wn.firm_series(_toy(spark, X))
    got = {r["firm"]: r["pred"] for r in WF.ar_walk_forward(s, 30, 20).where("t = 30").collect()}
    assert got[0] == pytest.approx(0.5) and got[1] == pytest.approx(0.0)
    row = Wn.with_ar_fit(Wn.refit_windows(s, 30, 20)).where("firm = 0").first()
    assert row["slope"] == pytest.approx(0.5 * 0.5 / 1.25) and row["intercept"] == pytest.approx(0.5 / 1.25)


def test_no_look_ahead(spark, W):
    """Changing rows from t on leaves every forecast up to t as it was."""
    cut = 80
    X2 = W.copy()
    X2[cut:] += 1.0
    specs = [WF.BASELINES[1], WF.BASELINES[4]]

    def run(X):
        s = Wn.firm_series(_toy(spark, X))
        out = WF.forecast_rows(WF.walk_forward(s, specs, 60, 7)).unionByName(WF.ar_walk_forward(s, 60, 7))
        return {(r["model"], r["t"], r["firm"]): r["pred"] for r in out.where(F.col("t") <= cut).collect()}

    a, b = run(W), run(X2)
    assert a.keys() == b.keys() and all(a[k] == b[k] for k in a)


def test_winsorized_quantiles_match_numpy(spark, W):
    s = Wn.firm_series(_toy(spark, W))
    got = Wn.with_winsorized(Wn.refit_windows(s, 101, 50)).where("refit = 101").orderBy("firm").collect()
    win = W[:101]
    want = np.clip(win, np.quantile(win, 0.01, axis=0), np.quantile(win, 0.99, axis=0))
    assert np.allclose(np.array([r["w"] for r in got]).T, want, atol=1e-15)


def test_late_start_keeps_its_days(spark):
    rows = [(t, 0, 0, float(t)) for t in range(5, 40)]
    s = Wn.firm_series(spark.createDataFrame(rows, "t int, pos int, firm long, x double"))
    w = {r["refit"]: r for r in Wn.refit_windows(s, 10, 4).collect()}
    assert min(w) == 18 and w[18]["w"] == [float(t) for t in range(8, 18)] and w[18]["y"] == [18.0, 19.0, 20.0, 21.0]


def test_gaps_and_repeats_are_refused(spark):
    for days in ([0, 1, 3], [0, 1, 1, 2], [0, 1, 1, 3]):
        df = spark.createDataFrame([(t, 0, 0, 1.0) for t in days], "t int, pos int, firm long, x double")
        with pytest.raises(Exception, match="gap"):
            Wn.firm_series(df).collect()


def test_missing_cells_stay_and_are_refused_by_fits(spark):
    x = [float(v) for v in range(100)]
    x[50] = None
    s = spark.createDataFrame([(0, 0, [*x, 1.0])], "pos int, firm long, xs array<double>")
    got = Wn.with_winsorized(Wn.refit_windows(s, 100, 1)).first()["w"]
    held = np.array([v for v in x if v is not None])
    want = np.clip(held, *np.quantile(held, [0.01, 0.99]))
    assert got[50] is None and np.allclose([v for v in got if v is not None], want)
    with pytest.raises(Exception, match="missing cells"):
        WF.walk_forward(s, WF.BASELINES[:1], 100, 1).collect()
    with pytest.raises(Exception, match="missing cells"):
        Wn.with_ar_fit(Wn.refit_windows(s, 100, 1)).collect()


def test_unfinished_fit_is_an_error():
    from firmament.functions import linalg as L
    rng = np.random.default_rng(0)
    with pytest.raises(ArithmeticError):
        L._finish(np.eye(4) + 0.1, rng.normal(size=4), np.full(4, 1e-6), np.zeros(4), np.ones(4, bool), 1)


def test_lead_lag_panel_follows_day_by_day(spark):
    from firmament.plans import validation as V
    got = np.zeros((30, 6))
    for r in V.lead_lag_panel(spark, 30, 6, 0.5, 4, seed=7).collect():
        got[r["t"], r["firm"]] = r["x"]
    want = np.random.default_rng(7).normal(0.0, 0.01, (30, 6))
    for t in range(1, 30):
        for i in range(1, 4):
            want[t, i] += 0.5 * want[t - 1, i - 1]
    assert np.allclose(got, want, atol=1e-15)


def test_degenerate_mixture_falls_back(monkeypatch, W):
    def degenerate(*_):
        raise np.linalg.LinAlgError("not positive definite")

    monkeypatch.setattr(L, "_mixture_labels", degenerate)
    d, labels = L.nirvar_labels(W)
    assert len(labels) == W.shape[1] and set(labels) <= set(range(d))


def test_horizon_blocks_count_from_the_first_t(spark):
    from firmament.plans.comparison import on_horizon

    days = [(dt.date(2020, 1, 1) + dt.timedelta(t), t, "a", float(t)) for t in range(3, 10)]
    blocks, calendar = on_horizon(spark.createDataFrame(days, "date date, t int, firm string, x double"), 3)
    assert sorted((r.t, r.x) for r in blocks.collect()) == [(0, 12.0), (1, 21.0), (2, 9.0)]
    assert sorted((r.t, r.date) for r in calendar.collect()) == [
        (0, dt.date(2020, 1, 4)), (1, dt.date(2020, 1, 7)), (2, dt.date(2020, 1, 10))]


def test_windows_are_shuffled_once(spark, W):
    """With neighbour lists too large to copy, windows still pass one exchange; the series' own is before them."""
    s = Wn.firm_series(_toy(spark, W))
    near = spark.createDataFrame([("g", r, 0, [1, 2]) for r in (60, 67, 5000)], "graph string, refit int, firm int, nbrs array<int>")
    specs = [WF.BASELINES[1], WF.Spec("hard", WF.L.fit_graph_hard, "g")]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = WF.walk_forward(s, specs, 60, 7, neighbours=near)
        plan = out._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Join" not in plan
    assert sum("(model#" in x for x in exchanges) == 2  # windows and neighbour lists
    hard = {(r["refit"], r["firm"]): np.array(r["coefs"]) for r in rows if r["model"] == "hard"}
    assert {r for r, _ in hard} == {r["refit"] for r in rows} and 5000 not in {r for r, _ in hard}
    for (refit, firm), b in hard.items():
        others = set(np.flatnonzero(b)) - {firm}
        assert others <= ({1, 2} if firm == 0 and refit in (60, 67) else set())
    assert {1, 2} <= set(np.flatnonzero(hard[60, 0]))
