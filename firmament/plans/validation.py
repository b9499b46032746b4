"""Known-structure panels for checking the models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament.functions import linalg as L
from firmament.operators import windows as Wn
from firmament.plans import walkforward as WF

LOOKBACK = 400
STEP = 5


def lead_lag_panel(spark: SparkSession, T: int = 700, N: int = 15, strength: float = 0.5,
                   n_linked: int | None = None, seed: int = 1) -> DataFrame:
    """``(t, pos, firm, x)``: firm i follows firm i-1 by one day among the first ``n_linked``."""
    noise = np.random.default_rng(seed).normal(0.0, 0.01, (T, N))
    linked = N if n_linked is None else n_linked
    x = noise.copy()
    for k in range(1, linked):  # what reaches a firm from the one k places before it
        x[k:, k:linked] += strength ** k * noise[:-k, :linked - k]
    t, pos = np.divmod(np.arange(T * N), N)
    return spark.createDataFrame(
        pd.DataFrame({"t": t.astype("int32"), "pos": pos.astype("int32"), "firm": pos, "x": x.ravel()}),
        "t int, pos int, firm long, x double")


def chain_edges(spark: SparkSession, first: int, last: int) -> list[tuple[int, int]]:
    return [(i - 1, i) for i in range(first + 1, last)]


EXPERIMENT_1 = [
    WF.Spec("AR", L.fit_ar),
    WF.Spec("VAR", L.fit_var),
    WF.Spec("SparseVAR-LASSO", L.fit_sparse, settings={"alpha": 2e-5}),
    WF.Spec("SparseVAR-EN", L.fit_sparse, settings={"alpha": 2e-5, "l1_ratio": 0.5}),
    WF.Spec("Factor(k=3)", L.fit_factor, settings={"k": 3}),
    WF.Spec("NIRVAR", L.fit_nirvar),
]


def experiment_2_specs() -> list[WF.Spec]:
    soft = {"alpha": 1e-5}
    return [
        WF.Spec("AR/none", L.fit_ar),
        WF.Spec("hard/true", L.fit_graph_hard, "true"), WF.Spec("soft/true", L.fit_graph_soft, "true", soft),
        WF.Spec("hard/wrong", L.fit_graph_hard, "wrong"), WF.Spec("soft/wrong", L.fit_graph_soft, "wrong", soft),
    ]


def score(forecasts: DataFrame) -> DataFrame:
    """OOS R2 and direction over the evaluated days (every cell counts)."""
    e = F.col("x") - F.col("pred")
    return forecasts.groupBy("model").agg(
        (1 - F.sum(e * e) / F.sum(F.col("x") * F.col("x"))).alias("oos_r2"),
        F.avg((F.signum("pred") == F.signum("x")).cast("double")).alias("dir_acc"))


def walk(series: DataFrame, specs: list[WF.Spec], neighbours: DataFrame | None = None) -> DataFrame:
    """Refit on every fifth day, forecast that day only, no winsorizing."""
    fitted = WF.walk_forward(series, specs, LOOKBACK, STEP, winsor=None, neighbours=neighbours)
    return score(WF.forecast_rows(fitted).where(F.col("t") == F.col("refit")))


def experiment_1(spark: SparkSession) -> DataFrame:
    return walk(Wn.firm_series(lead_lag_panel(spark, 700, 15, seed=1)), EXPERIMENT_1)


def experiment_2(spark: SparkSession) -> DataFrame:
    series = Wn.firm_series(lead_lag_panel(spark, 700, 20, n_linked=10, seed=3))
    refits = Wn.refit_windows(series, LOOKBACK, STEP).select("refit").distinct()
    rows = [(g, a, b) for g, pairs in (("true", chain_edges(spark, 0, 10)), ("wrong", chain_edges(spark, 11, 20)))
            for x, y in pairs for a, b in ((x, y), (y, x))]
    links = spark.createDataFrame(rows, "graph string, firm long, nb int").groupBy("graph", "firm").agg(
        F.array_sort(F.collect_set("nb")).alias("nbrs"))
    # the graph is the same on every refit day: attach each firm's row to the refit list
    per_refit = series.select("firm", F.explode(refits.agg(F.collect_list("refit")).scalar()).alias("refit"))
    return walk(series, experiment_2_specs(), links.join(per_refit, "firm"))
