"""Walk-forward forecasts: every refit of every model in one plan.

A refit is a key, not an iteration. Models see the winsorized window; forecasts
apply the frozen fit to the raw previous value until the next refit.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.functions import linalg as L
from firmament.operators import windows as Wn
from firmament.operators.graph import asof_snapshot, neighbour_lists


@dataclass(frozen=True)
class Spec:
    """One forecasting configuration: a fit, its settings, and the graph it reads (if any)."""

    label: str
    fit: Callable
    graph: str | None = None
    settings: dict = field(default_factory=dict)


BASELINES = [
    Spec("AR", L.fit_ar),
    Spec("VAR", L.fit_var),
    Spec("SparseVAR-LASSO", L.fit_sparse, settings={"alpha": 3.16e-5, "l1_ratio": 1.0}),
    Spec("SparseVAR-EN", L.fit_sparse, settings={"alpha": 1e-4, "l1_ratio": 0.5}),
    Spec("Factor", L.fit_factor),
    Spec("NIRVAR", L.fit_nirvar),
]


def graph_hard(graph: str, label: str | None = None) -> Spec:
    return Spec(label or f"GraphVAR-{graph}-hard", L.fit_graph_hard, graph)


def graph_soft(graph: str, label: str | None = None, alpha: float = 1e-4) -> Spec:
    return Spec(label or f"GraphVAR-{graph}-soft", L.fit_graph_soft, graph, {"alpha": alpha})


def corr_graph(graph: str = "news", label: str = "CorrGraphVAR-hard") -> Spec:
    return Spec(label, L.fit_corr_graph, graph)


def forecast_rows(fitted: DataFrame) -> DataFrame:
    """One row per (model, forecast day, firm) from the per-refit arrays."""
    return fitted.select(
        "model", "refit", "firm", F.posexplode(F.arrays_zip("pred", "y")).alias("step", "v")).select(
        "model", (F.col("refit") + F.col("step")).alias("t"), "refit", "firm",
        F.col("v.y").alias("x"), F.col("v.pred").alias("pred"))


def ar_walk_forward(series: DataFrame, lookback: int, refit_every: int, start: int = 0) -> DataFrame:
    """AR(1) per firm for any number of firms: no shuffle after the series, no Python."""
    w = Wn.with_winsorized(Wn.refit_windows(Wn.spread(series, "firm"), lookback, refit_every, start))
    fit = Wn.with_ar_fit(w)
    pred = F.transform("z", lambda v: F.col("intercept") + F.col("slope") * v)
    return forecast_rows(fit.select(F.lit("AR").alias("model"), "refit", "firm", pred.alias("pred"), "y"))


def refit_graphs(refits: DataFrame, calendar: DataFrame, graphs: dict[str, DataFrame], universe: DataFrame,
                 snaps: DataFrame | None = None) -> DataFrame:
    """``(graph, refit, firm, nbrs)``: neighbours in the snapshot in force on each refit day.

    All graphs come from one snapshot listing, so the day-to-snapshot mapping is
    shared; ``snaps`` gives the listing where a graph may be empty on some dates.
    """
    tagged = None
    for name, g in graphs.items():
        part = g.select(F.lit(name).alias("graph"), "snap_date", "src", "dst", "weight")
        tagged = part if tagged is None else tagged.unionByName(part)
    days = refits.join(calendar.withColumnRenamed("t", "refit"), "refit").select("refit", "date")
    listing = tagged if snaps is None else snaps
    force = asof_snapshot(days, listing.select("snap_date")).where(F.col("snap_date").isNotNull())
    live = tagged.join(force.select("refit", "snap_date"), "snap_date")
    return neighbour_lists(live, universe, ["graph", "refit"])


def walk_forward(series: DataFrame, specs: list[Spec], lookback: int = Wn.LOOKBACK,
                 refit_every: int = Wn.REFIT_EVERY, start: int = 0, winsor: float | None = Wn.WINSOR,
                 neighbours: DataFrame | None = None) -> DataFrame:
    """Coefficients and forecasts: ``(model, refit, pos, firm, intercept, coefs, pred, y)``.

    A group is one (model, refit): ``universe x lookback`` values. The joint
    models couple every firm with every other, so a group's memory is the square
    of the universe the caller lists. For a panel of unlimited width use
    :func:`ar_walk_forward`.
    """
    # The short series are dealt by firm, windows made and clipped where they lie, and shuffled once, by (model, refit).
    w = Wn.complete(Wn.refit_windows(Wn.spread(series, "firm"), lookback, refit_every, start))
    if winsor:
        w = Wn.with_winsorized(w, winsor)
    w = w.withColumn("model", F.explode(F.array(*[F.lit(s.label) for s in specs])))
    w = Wn.spread(w.select("model", "refit", "pos", "firm", "w", "z", "y"), "model", "refit")
    by_label = {s.label: s for s in specs}

    def fit_group(pdf: pd.DataFrame, near: pd.DataFrame | None = None) -> pd.DataFrame:
        if pdf.empty:  # neighbours of a refit day without windows
            return pd.DataFrame(columns=columns)
        pdf = pdf.sort_values("pos")
        spec = by_label[pdf["model"].iloc[0]]
        W = np.stack(pdf["w"].to_numpy()).T
        X = np.stack(pdf["z"].to_numpy())
        linked = np.zeros((len(pdf),) * 2, dtype=bool)
        if near is not None:
            row = {firm: i for i, firm in enumerate(pdf["firm"])}
            for firm, nb in zip(near["firm"], near["nbrs"], strict=True):
                if firm in row:
                    linked[row[firm], np.asarray(nb, dtype=int)] = True
        a, B = spec.fit(W, linked=linked, **spec.settings)
        pred = a[:, None] + B @ X
        return pd.DataFrame({
            "model": pdf["model"].to_numpy(), "refit": pdf["refit"].to_numpy(), "pos": pdf["pos"].to_numpy(),
            "firm": pdf["firm"].to_numpy(), "intercept": a, "coefs": list(B), "pred": list(pred),
            "y": pdf["y"].to_numpy()})

    firm_type = series.schema["firm"].dataType.simpleString()
    schema = (f"model string, refit int, pos int, firm {firm_type}, intercept double, "
              "coefs array<double>, pred array<double>, y array<double>")
    columns = [c.split()[0] for c in schema.split(", ")]
    groups = w.groupBy("model", "refit")
    graphs = {s.graph for s in specs if s.graph is not None}
    if neighbours is None or not graphs:
        return groups.applyInPandas(lambda pdf: fit_group(pdf), schema)
    users = F.create_map(*[x for g in sorted(graphs) for x in (F.lit(g), F.array(*[F.lit(s.label) for s in specs if s.graph == g]))])
    near = neighbours.select(F.explode(F.try_element_at(users, F.col("graph"))).alias("model"), "refit", "firm", "nbrs")
    return groups.cogroup(near.groupBy("model", "refit")).applyInPandas(lambda pdf, near: fit_group(pdf, near), schema)
