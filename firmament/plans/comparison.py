"""Model comparisons: baselines, graphs against controls, layers one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.functions.stats import student_p
from firmament.operators import graph as G
from firmament.operators import metrics as M
from firmament.operators import panel as P
from firmament.operators import windows as Wn
from firmament.operators.correlation import stratified_gap, windows_before
from firmament.plans import walkforward as WF
from firmament.session import materialize

# The configurations, and the pairs that are tested against each other.
COMPARISON = [
    WF.BASELINES[0],
    WF.BASELINES[2],
    WF.BASELINES[5],
    WF.graph_hard("news"),
    WF.graph_soft("news"),
    WF.graph_hard("sector"),
    WF.graph_soft("sector"),
    WF.corr_graph(),
]
COMPARISON_PAIRS = [
    ("GraphVAR-news-hard", "AR"), ("GraphVAR-news-soft", "AR"), ("GraphVAR-news-soft", "NIRVAR"),
    ("GraphVAR-news-soft", "GraphVAR-sector-soft"), ("GraphVAR-news-hard", "GraphVAR-sector-hard"),
    ("GraphVAR-news-hard", "CorrGraphVAR-hard"),
]
WIDE = [WF.BASELINES[0], WF.BASELINES[1], WF.BASELINES[5], WF.graph_hard("news"), WF.graph_hard("sector"),
        WF.corr_graph()]
WIDE_PAIRS = [
    ("GraphVAR-news-hard", "AR"), ("GraphVAR-news-hard", "GraphVAR-sector-hard"),
    ("GraphVAR-news-hard", "CorrGraphVAR-hard"), ("VAR", "AR"),
]
BASELINE_PAIRS = [(s.label, "AR") for s in WF.BASELINES if s.label != "AR"]


def news_and_sector(snapshots: DataFrame, universe: DataFrame, win: int = G.WINDOW) -> dict[str, DataFrame]:
    s = snapshots.where(F.col("win") == win)
    return {"news": G.layer_graph(s, universe),
            "sector": G.layer_graph(s, universe, types=G.SECTOR_TYPES, exclude=[])}


def layer_graphs(snapshots: DataFrame, universe: DataFrame, layers: list[str], win: int = G.WINDOW) -> DataFrame:
    """Each business layer as its own graph, layer kept as a column."""
    s = snapshots.where(F.col("win") == win).withColumn("layer", G.canonical_layer(F.col("layer")))
    return G.in_universe(s.where(F.col("layer").isin(layers)), universe).groupBy(
        *G.SNAPSHOT_KEY, "layer", "src", "dst").agg(F.sum("weight").alias("weight"))


def run(series: DataFrame, specs: list[WF.Spec], calendar: DataFrame, universe: DataFrame,
        graphs: dict[str, DataFrame] | None = None, snaps: DataFrame | None = None,
        lookback: int = Wn.LOOKBACK, refit_every: int = Wn.REFIT_EVERY, start: int = 0) -> DataFrame:
    """Long forecasts ``(model, t, refit, firm, x, pred)`` of all configurations, as one plan."""
    series = materialize(series, "series")  # sized, listed for refits and cut into windows: read, not recomputed
    nb = None
    if graphs:
        refits = Wn.refit_windows(series, lookback, refit_every, start).select("refit").distinct()
        nb = WF.refit_graphs(refits, calendar, graphs, universe, snaps)
    return WF.forecast_rows(WF.walk_forward(series, specs, lookback, refit_every, start, neighbours=nb))


def on_horizon(panel: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``horizon`` rows counted from the panel's first t, and their calendar ``(t, date)``.

    A target starts when its trailing mean is known, so its first t is not the
    calendar's. A block is dated, and meets its graph, on its first day.
    """
    panel = materialize(panel.select("date", "t", "firm", "x"), "target")  # read for its start, its blocks and their dates
    first = panel.agg(F.min("t")).scalar()
    blocks = P.horizon_blocks(panel.withColumn("t", (F.col("t") - first).cast("int")), horizon)
    return blocks, blocks.groupBy("t").agg(F.min("date").alias("date"))


def experiment(panel: DataFrame, universe: DataFrame, snapshots: DataFrame, specs: list[WF.Spec], horizon: int = 1,
               lookback: int | None = None, refit_every: int = Wn.REFIT_EVERY, listed: DataFrame | None = None) -> DataFrame:
    """Forecasts of all configurations for one target ``(date, t, firm, x)`` at one horizon, graphs on block dates.

    ``listed`` gives the listing where ``snapshots`` may lack some dates.
    """
    listed = G.snapshot_dates(snapshots) if listed is None else listed
    blocks, calendar = on_horizon(panel, horizon)
    series = Wn.firm_series(blocks.join(universe.select("pos", "firm"), "firm"))
    return run(series, specs, calendar, universe, news_and_sector(snapshots, universe), listed,
               lookback or P.scaled_lookback(horizon), refit_every)


def metric_table(forecasts: DataFrame, periods_per_year: float = 252.0) -> DataFrame:
    return M.statistical_metrics(forecasts).join(M.economic_metrics(forecasts, 1.0, periods_per_year), "model")


def layer_comparison(forecasts: DataFrame, layers: DataFrame, asof: DataFrame) -> DataFrame:
    """Hard graph per layer against AR, scored on the firms the layer ever connects.

    ``forecasts`` holds AR and one model per layer (named after it), ``layers``
    the layer graphs, ``asof`` the snapshot in force per day.
    """
    used = asof.where(F.col("snap_date").isNotNull()).select("snap_date").distinct()
    live = layers.where(F.col("weight") > 0).join(used, "snap_date", "left_semi")
    covered = G.both_ways(live.select("layer", "src", "dst")).select("layer", F.col("src").alias("firm")).distinct()
    firms = covered.groupBy("layer").agg(F.count("*").alias("n_firms")).where(F.col("n_firms") >= 3)
    per_snap = live.groupBy("layer", "snap_date").agg(F.count("*").alias("edges"))
    days = asof.where(F.col("snap_date").isNotNull())
    n_days = days.agg(F.count("*")).scalar()
    density = per_snap.join(days.groupBy("snap_date").agg(F.count("*").alias("days")), "snap_date").groupBy(
        "layer").agg((F.sum(F.col("edges") * F.col("days")) / n_days).alias("edges_per_day"))
    shared = covered.join(firms.select("layer"), "layer", "left_semi")
    own = forecasts.join(shared.withColumnRenamed("layer", "model"), ["model", "firm"], "left_semi").select(
        F.col("model").alias("layer"), F.lit("graph").alias("model"), "t", "firm", "x", "pred")
    ar = forecasts.where(F.col("model") == "AR").drop("model").join(shared, "firm").select(
        "layer", F.lit("AR").alias("model"), "t", "firm", "x", "pred")
    both = own.unionByName(ar)
    m = M.statistical_metrics(both, by=("layer", "model"))

    def side(model, prefix):
        return m.where(F.col("model") == model).select(
            "layer", F.col("oos_r2").alias(f"{prefix}_r2"), F.col("dir_acc").alias(f"{prefix}_dir_acc"))

    dm = M.diebold_mariano(both, [("graph", "AR")], by=("layer",), a_better="graph better", b_better="AR better")
    return (
        firms.join(density, "layer").join(side("graph", "graph"), "layer").join(side("AR", "ar"), "layer")
        .join(dm.select("layer", "dm", "p_value", "verdict"), "layer")
    )


def layer_gaps(series: DataFrame, layer_edges: DataFrame, snaps: DataFrame, calendar: DataFrame,
               window: int, min_snaps: int = 5) -> DataFrame:
    """Linked-minus-unlinked |correlation| per layer, with one-sample t-tests over snapshots.

    ``series`` carries ``(firm, pos, sector, xs)``; ``snaps`` the strided snapshots.
    """
    gaps = stratified_gap(windows_before(series, snaps, calendar, window), layer_edges)
    return gap_tests(gaps, min_snaps)


def gap_tests(gaps: DataFrame, min_snaps: int = 5) -> DataFrame:
    cols = ["overall", "same_sector", "cross_sector"]
    aggs = [F.count("*").alias("n_snapshots"), F.avg("n_linked").alias("mean_linked_pairs"),
            F.avg("linked_corr").alias("corr_linked"), F.avg("unlinked_corr").alias("corr_unlinked")]
    for c in cols:
        aggs += [F.avg(c).alias(f"d_{c}"), F.stddev_samp(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}")]
    t = gaps.groupBy("layer").agg(*aggs).where(F.col("n_snapshots") >= min_snaps)
    for c in cols:
        n, s = F.col(f"_n_{c}"), F.col(f"_s_{c}")
        t = t.withColumn(f"t_{c}", F.when((n >= 5) & (s > 0), F.col(f"d_{c}") / (s / F.sqrt(n))))
        t = t.withColumn(f"p_{c}", student_p(F.col(f"t_{c}"), (n - 1).cast("double")))
    return t.drop(*[f"_{k}_{c}" for c in cols for k in "sn"])


def overlap_study(news: DataFrame, sector: DataFrame, corr: DataFrame, snaps: DataFrame, universe: DataFrame) -> DataFrame:
    """Mean structure of the news graph and its controls, and their overlap with it."""
    out = None
    for name, g in (("news", news), ("sector", sector), ("corr", corr)):
        s = G.edge_summary(g, snaps, universe).join(G.edge_overlap(g, news, snaps), G.SNAPSHOT_KEY)
        row = s.groupBy(F.lit(name).alias("graph")).agg(
            *[F.avg(c).alias(c) for c in ("edges", "density", "mean_degree", "isolated", "overlap_pct")])
        out = row if out is None else out.unionByName(row)
    return out
