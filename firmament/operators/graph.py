"""Dated typed edges, snapshots, and the snapshot in force on a day.

Edges are sparse and undirected: one row per pair with ``src < dst``. Adjacency
matrices exist only inside model windows.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Relation types and the spellings folded into them.
SECTOR_TYPES = ["SECTOR_PEER"]
NON_BUSINESS_TYPES = ["ANALYST_COVERS", "EARNINGS_COMPARED_TO", "REGULATES"]
BUSINESS_LAYERS = [
    "COMPETES_WITH", "PARTNERS_WITH", "SUPPLIES_TO", "INVESTS_IN", "ACQUIRES", "ADVISES",
    "COUNTERPARTY_OF", "LENDER_TO", "EXECUTIVE_MOVES", "BIDS_FOR", "CONTAGION_TO", "SPINS_OFF",
]
TYPE_FIXES = {
    "ANALyst_COVERS": "ANALYST_COVERS",
    "ANALYTIC_COVERS": "ANALYST_COVERS",
    "ANALYT_COVERS": "ANALYST_COVERS",
    "ANALYSIS_COVERS": "ANALYST_COVERS",
    "ANALYZES": "ANALYST_COVERS",
    "ANALYSIS": "ANALYST_COVERS",
}

WINDOW = 252
MAX_AGE_DAYS = 183
SNAPSHOT_KEY = ["snap_date", "win"]


def _covered_by(day: Column, win: int, stride: int) -> Column:
    """Numbers of the snapshots whose window holds ``day``, counted from the base date; empty where it is NULL."""
    first = F.greatest(F.ceil(day / stride), F.lit(0)).cast("int")
    last = F.floor((day + win - 1) / stride).cast("int")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _snap_date(base_date: str, i: Column, stride: int) -> Column:
    return F.date_add(F.to_date(F.lit(base_date)), i * stride)


def rolling_snapshots(edges: DataFrame, base_date: str, windows: tuple[int, ...] = (20, 60, 252),
                      stride: int = 20) -> DataFrame:
    """Trailing-window graphs every ``stride`` days from dated edges ``(date, layer, src, dst, conf)``.

    The snapshot at S covers dates in ``(S - win, S]``; weight is count times
    mean confidence. Days are summed first. A pair's days, no more than the
    calendar has, then come together in one row, and the overlapping windows are
    made from that row: what is replicated to windows is neither shuffled nor aggregated.
    """
    daily = edges.groupBy("date", "layer", "src", "dst").agg(F.sum("conf").cast("double").alias("c"))
    offset = F.datediff("date", F.to_date(F.lit(base_date)))
    pairs = daily.groupBy("layer", "src", "dst").agg(F.collect_list(F.struct(offset.alias("day"), "c")).alias("d"))
    alone, only = F.size("d") == 1, F.get("d", F.lit(0))

    def weight(w: int, i: Column) -> Column:
        held = F.filter("d", lambda x: x["day"].between(i * stride - (w - 1), i * stride))
        total = F.aggregate(held, F.lit(None).cast("double"), lambda acc, x: F.coalesce(acc + x["c"], acc, x["c"]))
        return F.when(alone, only["c"]).otherwise(total)

    def of_window(w: int) -> Column:
        every = F.array_distinct(F.flatten(F.transform("d", lambda x: _covered_by(x["day"], w, stride))))
        at = F.when(alone, _covered_by(only["day"], w, stride)).otherwise(every)
        return F.transform(at, lambda i: F.struct(F.lit(w).alias("win"), i.alias("i"), weight(w, i).alias("weight")))

    return (
        pairs.select("layer", "src", "dst", F.explode(F.concat(*[of_window(w) for w in windows])).alias("_s"))
        .select(_snap_date(base_date, F.col("_s.i"), stride).alias("snap_date"), "_s.win", "layer", "src", "dst", "_s.weight")
    )


def snapshots_of_days(edges: DataFrame, base_date: str, windows: tuple[int, ...] = (20, 60, 252), stride: int = 20) -> DataFrame:
    """The listing of ``rolling_snapshots``, from the edges' days alone."""
    day = F.datediff("date", F.to_date(F.lit(base_date)))
    covered = F.concat(*[F.transform(_covered_by(day, w, stride), lambda i: F.struct(F.lit(w).alias("win"), i.alias("i"))) for w in windows])
    return edges.select("date").distinct().select(F.explode(covered).alias("_s")).select(
        _snap_date(base_date, F.col("_s.i"), stride).alias("snap_date"), "_s.win").distinct()


def daily_inside(edges: DataFrame, universe: DataFrame) -> DataFrame:
    """Edges between universe firms, summed by day; all others leave one row without ends for each day.

    One pass gives what snapshots of the universe need: its edges, and the days of every edge for the listing.
    """
    u = universe.select("firm").distinct()
    marked = edges
    for end in ("src", "dst"):
        marked = marked.join(u.select(F.col("firm").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    both = F.col("_src").isNotNull() & F.col("_dst").isNotNull()
    inside = marked.select("date", *[F.when(both, F.col(c)).alias(c) for c in ("layer", "src", "dst", "conf")])
    return inside.groupBy("date", "layer", "src", "dst").agg(F.sum("conf").alias("conf"))


def canonical_layer(layer):
    fixes = F.create_map(*[F.lit(v) for v in chain.from_iterable(TYPE_FIXES.items())])
    return F.coalesce(fixes[layer], layer)


def in_universe(edges: DataFrame, universe: DataFrame) -> DataFrame:
    """Drop self edges and edges leaving the universe; order the pair."""
    u = universe.select("firm")
    return (
        edges.where(F.col("src") != F.col("dst"))
        .join(u.withColumnRenamed("firm", "src"), "src", "left_semi")
        .join(u.withColumnRenamed("firm", "dst"), "dst", "left_semi")
        .withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    )


def layer_graph(snapshots: DataFrame, universe: DataFrame | None = None, types: list[str] | None = None,
                exclude: list[str] | None = None) -> DataFrame:
    """``(snap_date, win, src, dst, weight)`` of the chosen layers summed.

    With neither ``types`` nor ``exclude`` the sector and non-business layers are
    left out. Inside one raw layer a repeated pair keeps its last row (by
    ``seq``, when the input has it) and layers then add up.
    """
    if types is None and exclude is None:
        exclude = SECTOR_TYPES + NON_BUSINESS_TYPES
    g = snapshots.withColumn("canon", canonical_layer(F.col("layer")))
    if types is not None:
        g = g.where(F.col("canon").isin(types))
    if exclude:
        g = g.where(~F.col("canon").isin(exclude))
    if universe is not None:
        g = in_universe(g, universe)
    if "seq" in snapshots.columns:
        g = g.groupBy(*SNAPSHOT_KEY, "layer", "src", "dst").agg(F.max_by("weight", "seq").alias("weight"))
    return g.groupBy(*SNAPSHOT_KEY, "src", "dst").agg(F.sum("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each pair from both ends, in one pass over the input."""
    ends = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
                   F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    keep = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(*keep, F.explode(ends).alias("_e")).select(
        *keep, F.col("_e.a").alias("src"), F.col("_e.b").alias("dst"))


def snapshot_dates(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(*SNAPSHOT_KEY).distinct()


def asof_snapshot(days: DataFrame, snaps: DataFrame, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """``days`` plus the latest ``snap_date`` strictly before each, NULL beyond ``max_age_days``.

    A snapshot is laid out over the days it may serve and the latest one per day
    wins: an equi-join and a hash aggregate instead of a sort over all days.
    """
    serve = snaps.select("snap_date").distinct().select(
        "snap_date",
        F.explode(F.sequence(F.date_add("snap_date", 1), F.date_add("snap_date", max_age_days))).alias("date"))
    return days.join(serve.groupBy("date").agg(F.max("snap_date").alias("snap_date")), "date", "left")


def time_audit(asof: DataFrame) -> DataFrame:
    """Ages of the snapshots in force and the number that look ahead."""
    age = F.datediff("date", "snap_date")
    return asof.agg(
        F.count("*").alias("days"),
        F.count("snap_date").alias("days_with_graph"),
        F.count_if(F.col("snap_date").isNull()).alias("days_without_graph"),
        F.count_if(F.col("snap_date") >= F.col("date")).alias("violations"),
        F.min(age).alias("min_age"),
        F.percentile(age, F.lit(0.5)).alias("median_age"),
        F.max(age).alias("max_age"),
    )


def edge_summary(graph: DataFrame, snaps: DataFrame, universe: DataFrame) -> DataFrame:
    """Edges, mean degree, isolated firms and density of every snapshot, empty ones too."""
    n = universe.agg(F.count("*").alias("n")).scalar()
    deg = degrees(graph)
    per_snap = deg.groupBy(*SNAPSHOT_KEY).agg(
        (F.sum("degree") / 2).cast("long").alias("edges"), F.count("*").alias("touched"),
        F.max("degree").alias("max_degree"))
    e = F.coalesce("edges", F.lit(0))
    return (
        snaps.join(per_snap, SNAPSHOT_KEY, "left").withColumn("_n", n)
        .select(*SNAPSHOT_KEY, e.alias("edges"),
                (2 * e / F.col("_n")).alias("mean_degree"),
                F.coalesce("max_degree", F.lit(0)).alias("max_degree"),
                (F.col("_n") - F.coalesce("touched", F.lit(0))).alias("isolated"),
                F.try_divide(2 * e, F.col("_n") * (F.col("_n") - 1)).alias("density"))
    )


def degrees(graph: DataFrame) -> DataFrame:
    return both_ways(graph.where(F.col("weight") > 0).select(*SNAPSHOT_KEY, "src", "dst")).groupBy(
        *SNAPSHOT_KEY, F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def previous_snapshot(snaps: DataFrame) -> DataFrame:
    """Adds ``prev``. The window sees snapshot dates, a few per month of calendar."""
    return snaps.withColumn("prev", F.lag("snap_date").over(W.partitionBy("win").orderBy("snap_date")))


def edge_persistence(graph: DataFrame, snaps: DataFrame) -> DataFrame:
    """Share of the previous snapshot's edges still present; NULL for the first.

    Each edge is also moved to the next snapshot date, so kept edges are those
    counted twice for a pair: one aggregation, no join of two edge sets.
    """
    order = previous_snapshot(snaps)
    nxt = order.where(F.col("prev").isNotNull()).select(
        F.col("prev").alias("snap_date"), "win", F.col("snap_date").alias("next"))
    e = graph.where(F.col("weight") > 0).select(*SNAPSHOT_KEY, "src", "dst")
    moved = e.join(nxt, SNAPSHOT_KEY).select(F.col("next").alias("snap_date"), "win", "src", "dst")
    pair = (
        e.withColumn("now", F.lit(1)).withColumn("was", F.lit(0))
        .unionByName(moved.withColumn("now", F.lit(0)).withColumn("was", F.lit(1)))
        .groupBy(*SNAPSHOT_KEY, "src", "dst").agg(F.max("now").alias("now"), F.max("was").alias("was"))
        .groupBy(*SNAPSHOT_KEY).agg(F.sum(F.col("now") * F.col("was")).alias("kept"), F.sum("was").alias("was"))
    )
    return (
        order.join(pair, SNAPSHOT_KEY, "left")
        .select(*SNAPSHOT_KEY, F.when(
            F.col("prev").isNotNull(),
            F.coalesce("kept", F.lit(0)) / F.greatest(F.coalesce("was", F.lit(0)), F.lit(1))).alias("edge_persistence"))
    )


def edge_overlap(graph: DataFrame, reference: DataFrame, snaps: DataFrame) -> DataFrame:
    """Percent of ``reference`` edges that ``graph`` also has, per snapshot."""
    key = [*SNAPSHOT_KEY, "src", "dst"]
    ref = reference.where(F.col("weight") > 0).select(*key)
    hit = graph.where(F.col("weight") > 0).select(*key).withColumn("hit", F.lit(1))
    per = ref.join(hit, key, "left").groupBy(*SNAPSHOT_KEY).agg(
        F.count("*").alias("n"), F.count("hit").alias("h"))
    return snaps.join(per, SNAPSHOT_KEY, "left").select(
        *SNAPSHOT_KEY,
        (100 * F.coalesce("h", F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("overlap_pct"))


def every_nth(snaps: DataFrame, n: int) -> DataFrame:
    """Every ``n``-th snapshot of each window length, the first included."""
    i = F.row_number().over(W.partitionBy("win").orderBy("snap_date")) - 1
    return snaps.withColumn("_i", i).where(F.col("_i") % n == 0).drop("_i")


def neighbour_lists(edges: DataFrame, universe: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, firm, nbrs)`` with the sorted universe positions of linked firms."""
    pos = universe.select(F.col("firm").alias("dst"), "pos")
    return both_ways(edges.where(F.col("weight") > 0).select(*keys, "src", "dst")).join(pos, "dst").groupBy(
        *keys, F.col("src").alias("firm")).agg(F.array_sort(F.collect_set("pos")).alias("nbrs"))
