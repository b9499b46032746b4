"""Every operator as a query over the driver's tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament.functions import text as X
from firmament.operators import correlation as K
from firmament.operators import graph as G
from firmament.operators import mentions as MN
from firmament.operators import metrics as M
from firmament.operators import news as NW
from firmament.operators import panel as P
from firmament.operators import resolve as R
from firmament.operators import scoring as SC
from firmament.operators import structure as ST
from firmament.operators import targets as TG
from firmament.operators import windows as Wn
from firmament.plans import comparison as C
from firmament.plans import derive as D
from firmament.plans import tuning as TU
from firmament.plans import walkforward as WF
from firmament.session import materialize, shared_dir, ship_package
from firmament.sources import extractor as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LAYERS = ["COMPETES_WITH", "PARTNERS_WITH", "SUPPLIES_TO", "ACQUIRES"]
STUDY_START, STUDY_END, DENSE_END = "1996-01-01", "2001-06-30", "1998-12-31"
LAST_NEWS_DAY = "2000-12-31"
PERIODS = 52.0


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def rd(col: str | Column, n: int = 6) -> Column:
    """Rounded for comparison across engines, without negative zeros."""
    return F.round(col, n) + F.lit(0.0)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: rd(c, n) for c, n in digits.items()})


def dates(col: str = "date"):
    return F.col(col).between(F.to_date(F.lit(STUDY_START)), F.to_date(F.lit(STUDY_END)))


# ---- panel -------------------------------------------------------------------

@query
def panel_weekly(spark, sf):
    return rounded(D.cells(spark, sf), volume=2, qty=2)


@query
def wide_unpivot(spark, sf):
    """The wide matrix (one row per firm, one column per week) turned long again."""
    c = materialize(D.cells(spark, sf).select("date", "firm", "volume"), "wide-cells")
    weeks = [r["date"] for r in P.calendar_of(c).orderBy("t").collect()]
    wide = P.pivot_matrix(c, "volume", weeks)
    return rounded(P.unpivot_matrix(wide, "firm", "value"), value=2)


def _days(spark, sf):
    """Days on which each supplier's lines shipped, against the days orders were taken."""
    shipped = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("firm"), F.to_date("l_shipdate").alias("date"))
    ordered = D.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return shipped, ordered


@query
def calendar_missing(spark, sf):
    """Order days inside a supplier's range on which it shipped nothing."""
    shipped, ordered = _days(spark, sf)
    return P.gaps_by_firm(shipped, ordered)


@query
def calendar_extra(spark, sf):
    """Ship days on which no order was taken."""
    shipped, ordered = _days(spark, sf)
    return P.calendar_extra(shipped, ordered)


@query
def sector_coalesce(spark, sf):
    return D.sectors(spark, sf)


@query
def universe_topn(spark, sf):
    return rounded(P.top_by_mean(D.cells(spark, sf), D.sectors(spark, sf), D.UNIVERSE_N), mean_value=3)


@query
def excess_returns(spark, sf):
    return rounded(D.market(spark, sf).excess.select("t", "date", "firm", "r", "x"), r=6, x=6)


@query
def horizon_blocks(spark, sf):
    return rounded(P.horizon_blocks(D.market(spark, sf).excess, 5), x=6)


@query
def panel_slice(spark, sf):
    m = D.market(spark, sf)
    return rounded(P.slice_rows(m.excess.select("date", "t", "firm", "x"), m.calendar,
                                "1998-01-01", "1999-12-31", warmup=30), x=6)


@query
def target_absret(spark, sf):
    return rounded(TG.absret_target(D.market(spark, sf).returns).select("t", "firm", "target"), target=6)


@query
def target_volume(spark, sf):
    return rounded(TG.volume_target(D.market(spark, sf).returns).select("t", "firm", "target"), target=6)


@query
def target_rv(spark, sf):
    return rounded(TG.rv_target(D.market(spark, sf).returns).select("t", "firm", "target"), target=6)


@query
def lag1_autocorr(spark, sf):
    """Mean lag-1 autocorrelation of each activity target."""
    r = materialize(D.market(spark, sf).returns, "returns")
    parts = None
    for name, target in TG.TARGETS.items():
        if target is not None:
            part = target(r).select(F.lit(name).alias("name"), "t", "firm", "target")
            parts = part if parts is None else parts.unionByName(part)
    per = TG.lag1_autocorr(parts, "target", ["name", "firm"])
    return rounded(per.groupBy("name").agg(F.avg("autocorr").alias("autocorr")), autocorr=6)


# ---- walk-forward ------------------------------------------------------------

def _series(m: D.Market) -> DataFrame:
    return Wn.firm_series(m.excess)


@query
def winsorized_windows(spark, sf):
    w = Wn.with_winsorized(Wn.refit_windows(_series(D.market(spark, sf)), D.LOOKBACK, D.REFIT_EVERY))
    return rounded(w.select("refit", "firm", F.array_min("w").alias("lo"), F.array_max("w").alias("hi"),
                            (F.aggregate("w", F.lit(0.0), lambda a, v: a + v) / F.size("w")).alias("mean")),
                   lo=6, hi=6, mean=6)


def _ar(spark, sf) -> DataFrame:
    return WF.ar_walk_forward(_series(D.market(spark, sf)), D.LOOKBACK, D.REFIT_EVERY)


@query
def ar_walkforward(spark, sf):
    return rounded(_ar(spark, sf), x=6, pred=6)


@query
def ar_all_firms(spark, sf):
    """AR over every firm with a known sector: no universe, no Python."""
    m = D.market(spark, sf, n=None)
    f = WF.ar_walk_forward(Wn.firm_series(m.excess, keys=("firm",)), D.LOOKBACK, D.REFIT_EVERY)
    return rounded(f.groupBy("firm").agg(
        F.count("*").alias("days"), F.avg("pred").alias("mean_pred"),
        F.avg(F.pow(F.col("x") - F.col("pred"), 2.0)).alias("mse")), mean_pred=6, mse=6)


@query
def ar_statistical_metrics(spark, sf):
    return rounded(M.statistical_metrics(_ar(spark, sf)), oos_r2=6, mse=6, mae=6, dir_acc=6)


@query
def ar_pnl(spark, sf):
    return rounded(M.daily_pnl(_ar(spark, sf)), pnl=6)


@query
def ar_pnl_topfrac(spark, sf):
    return rounded(M.daily_pnl(_ar(spark, sf), top_frac=0.25), pnl=6)


@query
def sharpe_moments(spark, sf):
    m = M.sharpe_moments(M.daily_pnl(_ar(spark, sf)))
    return rounded(m.select("model", "n", "sharpe", "skew", "kurt", "z"), sharpe=6, skew=6, kurt=6, z=6)


@query
def ar_economic_metrics(spark, sf):
    return rounded(M.economic_metrics(_ar(spark, sf), 1.0, PERIODS), ann_sharpe=6, sharpe_p=6, ppt_bps=4, hit_ratio=6)


def _baselines(spark, sf, labels: list[str] | None = None) -> DataFrame:
    m = D.market(spark, sf)
    specs = [s for s in WF.BASELINES if labels is None or s.label in labels]
    return C.run(_series(m), specs, m.calendar, m.universe, lookback=D.LOOKBACK, refit_every=D.REFIT_EVERY)


@query
def var_walkforward(spark, sf):
    return rounded(_baselines(spark, sf, ["VAR"]), x=6, pred=6)


@query
def lasso_walkforward(spark, sf):
    return rounded(_baselines(spark, sf, ["SparseVAR-LASSO"]), x=6, pred=6)


@query
def en_walkforward(spark, sf):
    return rounded(_baselines(spark, sf, ["SparseVAR-EN"]), x=6, pred=6)


@query
def factor_walkforward(spark, sf):
    return rounded(_baselines(spark, sf, ["Factor"]), x=6, pred=6)


@query
def nirvar_walkforward(spark, sf):
    return rounded(_baselines(spark, sf, ["NIRVAR"]), x=6, pred=6)


@query
def baseline_table(spark, sf):
    """All six baselines with both metric families."""
    f = materialize(_baselines(spark, sf), "forecasts")
    return rounded(C.metric_table(f, PERIODS), oos_r2=6, mse=6, mae=6, dir_acc=6, ann_sharpe=6, sharpe_p=6,
                   ppt_bps=4, hit_ratio=6)


@query
def baseline_dm(spark, sf):
    return rounded(M.diebold_mariano(_baselines(spark, sf), C.BASELINE_PAIRS), dm=6, p_value=6)


@query
def dm_test(spark, sf):
    """VAR against AR: the statistic, its p-value and the verdict."""
    return rounded(M.diebold_mariano(_baselines(spark, sf, ["AR", "VAR"]), [("VAR", "AR")]), dm=6, p_value=6)


# ---- graph -------------------------------------------------------------------

def _snapshots(spark, sf, windows=(20, 60, 252)) -> DataFrame:
    return G.rolling_snapshots(D.raw_edges(spark, sf), D.BASE_DATE, windows)


@query
def graph_snapshot_edges(spark, sf):
    return rounded(_snapshots(spark, sf), weight=6)


def _universe(spark, sf) -> DataFrame:
    top = P.top_by_mean(D.cells(spark, sf), D.sectors(spark, sf), D.UNIVERSE_N)
    return materialize(top.select("pos", "firm"), "universe")


def _universe_snapshots(spark, sf, universe, windows=(G.WINDOW,)) -> tuple[DataFrame, DataFrame]:
    """Snapshots of the universe's edges alone, and the listing of all snapshots: one pass over the line items."""
    e = materialize(G.daily_inside(D.raw_edges(spark, sf), universe), "universe-edges")
    snap = G.rolling_snapshots(e.where(F.col("src").isNotNull()), D.BASE_DATE, windows)
    return materialize(snap, "snapshots"), G.snapshots_of_days(e, D.BASE_DATE, windows)


def _listing(spark, sf) -> DataFrame:
    return G.snapshots_of_days(D.raw_edges(spark, sf), D.BASE_DATE, (G.WINDOW,))


def _news_graph(spark, sf):
    """Universe, its business-layer graph and the snapshot listing."""
    uni = _universe(spark, sf)
    snap, listed = _universe_snapshots(spark, sf, uni)
    return uni, materialize(G.layer_graph(snap, uni), "news-graph"), listed


@query
def graph_layer_filter(spark, sf):
    """Business layers summed inside the universe, aliases folded first."""
    uni = _universe(spark, sf)
    return rounded(G.layer_graph(_universe_snapshots(spark, sf, uni)[0], uni), weight=6)


@query
def graph_asof_days(spark, sf):
    cal = P.calendar_of(D.cells(spark, sf))
    snaps = _listing(spark, sf)
    # a gap in coverage: no snapshot in the second half of 1997 and after the study period
    kept = snaps.where(~F.col("snap_date").between(F.to_date(F.lit("1997-01-01")), F.to_date(F.lit("1997-12-31"))))
    return G.asof_snapshot(cal.select("date"), kept)


@query
def time_audit(spark, sf):
    cal = P.calendar_of(D.cells(spark, sf)).where(dates())
    snaps = _listing(spark, sf)
    return G.time_audit(G.asof_snapshot(cal.select("date"), snaps))


@query
def graph_summary(spark, sf):
    uni, news, snaps = _news_graph(spark, sf)
    return rounded(G.edge_summary(news, snaps, uni), mean_degree=6, density=6)


@query
def edge_persistence(spark, sf):
    _, news, snaps = _news_graph(spark, sf)
    return rounded(G.edge_persistence(news, snaps), edge_persistence=6)


@query
def clustering_coefficient(spark, sf):
    """Per firm and snapshot on the whole business graph, 60-day windows."""
    g = materialize(G.layer_graph(_snapshots(spark, sf, (60,))), "graph60")
    return rounded(ST.clustering(g), clustering=6)


@query
def connected_components(spark, sf):
    """Per firm and snapshot on the whole business graph, 20-day windows."""
    return ST.connected_components(G.layer_graph(_snapshots(spark, sf, (20,))))


@query
def sector_share(spark, sf):
    g = G.layer_graph(_snapshots(spark, sf, (60,)))
    return rounded(ST.sector_share(g, D.sectors(spark, sf)), pct_within_sector=6)


def _structure(spark, sf) -> DataFrame:
    uni, news, snaps = _news_graph(spark, sf)
    return ST.structure(news, snaps.where(dates("snap_date")), uni, D.sectors(spark, sf))


STRUCTURE_DIGITS = dict(density=6, mean_degree=6, clustering=6, pct_within_sector=6, edge_persistence=6)


@query
def graph_structure(spark, sf):
    return rounded(_structure(spark, sf), **STRUCTURE_DIGITS)


@query
def structure_describe(spark, sf):
    return rounded(ST.describe(_structure(spark, sf), ST.STRUCTURE_METRICS), mean=6, std=6, min=6, median=6, max=6)


@query
def structure_by_year(spark, sf):
    cols = ["edges", "mean_degree", "isolated", "largest_comp", "clustering", "pct_within_sector"]
    return rounded(ST.mean_by_year(_structure(spark, sf), cols), **{c: 6 for c in cols})


@query
def window_length_study(spark, sf):
    """Mean structure by window length over the dense years."""
    uni = _universe(spark, sf)
    snap, every = _universe_snapshots(spark, sf, uni, (20, 60, 252))
    news = materialize(G.layer_graph(snap, uni), "news-graph")
    listed = every.where(
        F.col("snap_date").between(F.to_date(F.lit(STUDY_START)), F.to_date(F.lit(DENSE_END))))
    t = (
        G.edge_summary(news, listed, uni)
        .join(ST.sector_share(news, D.sectors(spark, sf)), G.SNAPSHOT_KEY, "left")
        .join(G.edge_persistence(news, listed), G.SNAPSHOT_KEY, "left")
    )
    cols = ["edges", "isolated", "pct_within_sector", "edge_persistence"]
    return rounded(t.groupBy("win").agg(F.count("*").alias("snapshots"), *[F.avg(c).alias(c) for c in cols]),
                   **{c: 6 for c in cols})


def _corr_inputs(spark, sf, window=D.LOOKBACK):
    """Raw simple returns, strided snapshots, and the news and sector graphs on them."""
    m = D.market(spark, sf)
    series = Wn.firm_series(m.returns, "r").join(m.sectors, "firm", "left")
    snap, listed = _universe_snapshots(spark, sf, m.universe)
    strided = materialize(G.every_nth(listed.where(dates("snap_date")), 12), "strided")
    at = snap.join(strided, G.SNAPSHOT_KEY, "left_semi")
    return m, series, at, strided, K.windows_before(series, strided, m.calendar, window)


@query
def corr_graph_topk(spark, sf):
    """As many of the most correlated pairs as the news graph has edges, per strided snapshot."""
    m, _, at, _, windows = _corr_inputs(spark, sf)
    k = G.layer_graph(at, m.universe).groupBy(*G.SNAPSHOT_KEY).agg(F.count("*").alias("k"))
    return rounded(K.corr_top_pairs(windows, k), weight=6)


@query
def control_overlap(spark, sf):
    m, _, at, strided, windows = _corr_inputs(spark, sf)
    graphs = {k: materialize(g, f"{k}-graph") for k, g in C.news_and_sector(at, m.universe).items()}
    k = graphs["news"].groupBy(*G.SNAPSHOT_KEY).agg(F.count("*").alias("k"))
    corr = materialize(K.corr_top_pairs(windows, k), "corr-graph")
    t = C.overlap_study(graphs["news"], graphs["sector"], corr, strided, m.universe)
    return rounded(t, edges=6, density=6, mean_degree=6, isolated=6, overlap_pct=6)


def _layer_edges(at, uni) -> DataFrame:
    all_news = G.layer_graph(at, uni).select(*G.SNAPSHOT_KEY, F.lit("ALL_NEWS").alias("layer"), "src", "dst")
    return all_news.unionByName(C.layer_graphs(at, uni, LAYERS).select(*G.SNAPSHOT_KEY, "layer", "src", "dst"))


@query
def stratified_corr_gap(spark, sf):
    m, _, at, _, windows = _corr_inputs(spark, sf)
    g = K.stratified_gap(windows, _layer_edges(at, m.universe))
    return rounded(g, **{c: 6 for c in ("linked_corr", "unlinked_corr", "overall", "same_sector", "cross_sector")})


@query
def layer_ttest(spark, sf):
    m, _, at, _, windows = _corr_inputs(spark, sf)
    t = C.gap_tests(K.stratified_gap(windows, _layer_edges(at, m.universe)))
    return rounded(t, **{c: 6 for c in t.columns if c not in ("layer", "n_snapshots")})


# ---- graph models ------------------------------------------------------------

def _graph_run(spark, sf, specs: list[WF.Spec], n: int = D.UNIVERSE_N) -> DataFrame:
    m = D.market(spark, sf, n=n)
    snap, listed = _universe_snapshots(spark, sf, m.universe)
    graphs = C.news_and_sector(snap, m.universe)
    return C.run(_series(m), specs, m.calendar, m.universe, graphs, listed, D.LOOKBACK, D.REFIT_EVERY)


@query
def graphvar_hard_walkforward(spark, sf):
    return rounded(_graph_run(spark, sf, [WF.graph_hard("news"), WF.graph_hard("sector")]), x=6, pred=6)


@query
def graphvar_soft_walkforward(spark, sf):
    return rounded(_graph_run(spark, sf, [WF.graph_soft("news"), WF.graph_soft("sector")]), x=6, pred=6)


@query
def corrgraph_walkforward(spark, sf):
    return rounded(_graph_run(spark, sf, [WF.corr_graph()]), x=6, pred=6)


METRIC_DIGITS = dict(oos_r2=6, mse=6, mae=6, dir_acc=6, ann_sharpe=6, sharpe_p=6, ppt_bps=4, hit_ratio=6)


@query
def graph_comparison(spark, sf):
    """Eight configurations on one window."""
    f = materialize(_graph_run(spark, sf, C.COMPARISON), "forecasts")
    return rounded(C.metric_table(f, PERIODS), **METRIC_DIGITS)


@query
def graph_comparison_dm(spark, sf):
    return rounded(M.diebold_mariano(_graph_run(spark, sf, C.COMPARISON), C.COMPARISON_PAIRS), dm=6, p_value=6)


@query
def wide_universe_dm(spark, sf):
    """The fast models on a universe three times as wide."""
    return rounded(M.diebold_mariano(_graph_run(spark, sf, C.WIDE, n=60), C.WIDE_PAIRS), dm=6, p_value=6)


@query
def wide_universe_table(spark, sf):
    """Both metric families of the models on the wide universe that have SQL."""
    specs = [s for s in C.WIDE if s.label != "NIRVAR"]
    f = materialize(_graph_run(spark, sf, specs, n=60), "forecasts")
    return rounded(C.metric_table(f, PERIODS), **METRIC_DIGITS)


def _experiment(spark, sf, target: str, horizon: int) -> DataFrame:
    """AR and the hard graphs on days summed to ``horizon``; a day without trade has volume 0."""
    m = D.market(spark, sf, grain="day")
    snap, listed = _universe_snapshots(spark, sf, m.universe)
    make = TG.TARGETS[target]
    if make is None:
        panel = m.excess
    else:
        panel = make(m.returns.withColumn("volume", F.coalesce("volume", F.lit(0.0)))).withColumnRenamed("target", "x")
    specs = [WF.BASELINES[0], WF.graph_hard("news"), WF.graph_hard("sector")]
    f = materialize(C.experiment(panel, m.universe, snap, specs, horizon, listed=listed), "forecasts")
    return rounded(C.metric_table(f, P.periods_per_year(horizon)), **METRIC_DIGITS)


@query
def comparison_returns_h5(spark, sf):
    return _experiment(spark, sf, "returns", 5)


@query
def comparison_returns_h21(spark, sf):
    return _experiment(spark, sf, "returns", 21)


@query
def comparison_volume_h5(spark, sf):
    return _experiment(spark, sf, "volume", 5)


@query
def graph_vs_ar_layer(spark, sf):
    m = D.market(spark, sf)
    snap, snaps = _universe_snapshots(spark, sf, m.universe)
    layers = materialize(C.layer_graphs(snap, m.universe, LAYERS), "layers")
    graphs = {x: layers.where(F.col("layer") == x).drop("layer") for x in LAYERS}
    specs = [WF.BASELINES[0]] + [WF.graph_hard(x, label=x) for x in LAYERS]
    f = materialize(C.run(_series(m), specs, m.calendar, m.universe, graphs, snaps, D.LOOKBACK, D.REFIT_EVERY), "forecasts")
    t = C.layer_comparison(f, layers, G.asof_snapshot(m.calendar.select("date"), snaps))
    return rounded(t, **{c: 6 for c in ("edges_per_day", "graph_r2", "graph_dir_acc", "ar_r2", "ar_dir_acc", "dm", "p_value")})


# ---- tuning ------------------------------------------------------------------

def _tuned(spark, sf) -> DataFrame:
    m = D.market(spark, sf)
    series = Wn.firm_series(P.excess(m.returns, None))
    return TU.tune(series, D.LOOKBACK)


@query
def tune_alpha_grid(spark, sf):
    return rounded(_tuned(spark, sf), r2=6, dir_acc=6, nonzero_per_firm=6)


@query
def tune_curve(spark, sf):
    t = TU.mean_curve(_tuned(spark, sf), "dir_acc")
    return rounded(t, **{c: 6 for c in t.columns if c != "alpha"})


@query
def tune_choice(spark, sf):
    return rounded(TU.choose_alpha(_tuned(spark, sf)), score=6, nonzero_per_firm=6)


# ---- news and text -----------------------------------------------------------

def _known_firms(spark, sf) -> DataFrame:
    return D.sectors(spark, sf).where(F.col("sector") != P.UNKNOWN).select("firm")


def _news(spark, sf) -> DataFrame:
    return NW.filter_news(D.news_rows(spark, sf), _known_firms(spark, sf), LAST_NEWS_DAY)


@query
def news_filter(spark, sf):
    return _news(spark, sf)


def _articles(spark, sf) -> DataFrame:
    return NW.article_table(_news(spark, sf), ["Date", "source_row", "Stock_symbol"])


@query
def article_table(spark, sf):
    return _articles(spark, sf).withColumn("tickers", F.array_join(F.transform("tickers", lambda t: t.cast("string")), ","))


@query
def junk_flag(spark, sf):
    """Every document's whole text against the junk patterns."""
    d = D.table(spark, sf, "documents")
    return d.select("doc_id", X.is_junk(F.col("text")).alias("junk"))


@query
def classify(spark, sf):
    """First relation pattern found in each article title and each document."""
    a = materialize(_articles(spark, sf), "articles").where(F.col("title").isNotNull()).select(
        "article_id", X.is_junk(F.col("title")).alias("junk"), X.classify(F.col("title")).alias("relation"))
    d = D.table(spark, sf, "documents").select(
        F.concat(F.lit("doc/"), "doc_id").alias("article_id"), X.is_junk(F.col("text")).alias("junk"),
        X.classify(F.col("text")).alias("relation"))
    return a.unionByName(d)


@query
def name_variants(spark, sf):
    """The dictionary of every firm: long names and case-sensitive short ones."""
    s = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("firm"), F.col("s_suppkey").alias("pos"))
    n = D.names(spark, sf, s)
    return (
        MN.long_names(n).select(F.lit("long").alias("kind"), "name", "firm")
        .unionByName(MN.short_names(n).select(F.lit("short").alias("kind"), "name", "firm"))
    )


def _titles(spark, sf) -> DataFrame:
    return D.headlines(spark, sf).select("article_id", "title", F.col("ts").alias("date"), "label", "panel")


@query
def mentions_pairs(spark, sf):
    """Mentions of universe firms in every headline, one row each."""
    n = materialize(D.names(spark, sf, _universe(spark, sf)), "names")
    m = MN.find_mentions(materialize(_titles(spark, sf).select("article_id", "title"), "titles"), n)
    return m.select("article_id", F.explode("mentions").alias("m")).select("article_id", "m.start", "m.stop", "m.firm")


def _rule_edges(spark, sf) -> DataFrame:
    n = materialize(D.names(spark, sf, _universe(spark, sf)), "names")
    return MN.rule_edges(_titles(spark, sf), n)


@query
def edges_rules(spark, sf):
    return _rule_edges(spark, sf)


@query
def relation_counts(spark, sf):
    return _rule_edges(spark, sf).groupBy("relation").agg(F.count("*").alias("n"))


@query
def candidate_headlines(spark, sf):
    """Articles tagged with two universe firms and naming one in the title."""
    uni = _universe(spark, sf)
    n = materialize(D.names(spark, sf, uni), "names")
    articles = materialize(_articles(spark, sf), "articles")
    return MN.candidates(articles, uni, n).select("article_id", "date", "title", "n_tickers")


def _written(spark, sf) -> DataFrame:
    """Every supplier's name as a journalist might write it."""
    n = D.display_name()
    forms = F.array(F.concat(F.lit("The "), n, F.lit(", Inc.")), F.concat(n, F.lit(" Europe")),
                    F.concat(F.lit("New "), n, F.lit(" Holdings")), F.lower(n), F.concat(n, F.lit("x")))
    return D.table(spark, sf, "supplier").select(F.explode(forms).alias("name"))


@query
def resolve_names(spark, sf):
    n = materialize(D.names(spark, sf, _universe(spark, sf)), "names")
    return R.resolve_names(_written(spark, sf), n)


def _model_cache(spark, sf):
    titles = materialize(_titles(spark, sf), "titles")
    cache = materialize(E.extract(E.uncached(titles, None)), "extractor-cache")
    return titles, cache


@query
def model_edges(spark, sf):
    """Relations the pluggable extractor reads from every headline, through its cache."""
    titles, cache = _model_cache(spark, sf)
    return E.model_edges(titles, cache).drop("ord")


@query
def resolve_edges(spark, sf):
    titles, cache = _model_cache(spark, sf)
    n = materialize(D.names(spark, sf, _universe(spark, sf)), "names")
    e = materialize(E.model_edges(titles, cache), "model-edges")
    return R.resolve_edges(e, n).select("article_id", "firm_a", "firm_b", "relation", "ticker_a", "ticker_b", "n_universe")


@query
def universe_edge_counts(spark, sf):
    """How many model edges have none, one or both ends in the universe."""
    titles, cache = _model_cache(spark, sf)
    n = materialize(D.names(spark, sf, _universe(spark, sf)), "names")
    e = materialize(E.model_edges(titles, cache), "model-edges")
    return R.resolve_edges(e, n).groupBy("n_universe").agg(F.count("*").alias("n"))


@query
def cache_key_diff(spark, sf):
    """Headlines of the second half not already cached from the first."""
    t = _titles(spark, sf)
    half = F.to_timestamp_ntz(F.lit("1998-06-01 00:00:00"))
    done = t.where(F.col("date") < half).select(X.cache_key(F.col("title")).alias("key"))
    return E.uncached(t.where(F.col("date") >= half), done)


@query
def label_parse(spark, sf):
    t = SC.parse_labels(_titles(spark, sf))
    return t.select("article_id", "label", "has_relation", "true_type")


def _predictions(spark, sf):
    titles = materialize(_titles(spark, sf), "titles")
    n = materialize(D.names(spark, sf, _universe(spark, sf)), "names")
    cache = materialize(E.extract(E.uncached(titles, None)), "extractor-cache")
    rules = SC.rules_prediction(titles, n)
    return titles, materialize(rules, "rules"), materialize(E.last_relations(titles, cache), "model")


@query
def score_extraction(spark, sf):
    titles, rules, model = _predictions(spark, sf)
    labels = SC.parse_labels(titles).select("article_id", "panel", "has_relation", "true_type")
    both = rules.withColumn("extractor", F.lit("rules")).unionByName(model.withColumn("extractor", F.lit("model")))
    each = labels.withColumn("extractor", F.explode(F.array(F.lit("rules"), F.lit("model"))))
    scored = each.join(both.withColumnRenamed("relation", "predicted"), ["article_id", "extractor"], "left")
    return rounded(SC.score(scored), precision=6, recall=6, f1=6)


@query
def extractor_disagreement(spark, sf):
    _, rules, model = _predictions(spark, sf)
    return SC.disagreements(rules, model)


@query
def label_rule_scores(spark, sf):
    """Labelled documents against the junk rule, per source and overall."""
    d = D.table(spark, sf, "documents").join(D.table(spark, sf, "labels"), "doc_id")
    p = d.select(
        F.lit("rules").alias("extractor"), F.col("source").alias("panel"),
        (F.col("quality") == 1).alias("has_relation"), F.lit("clean").alias("true_type"),
        F.when(~X.is_junk(F.col("text")), "clean").alias("predicted"))
    return rounded(SC.score(p), precision=6, recall=6, f1=6)
