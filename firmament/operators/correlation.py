"""Correlation graphs and linked-versus-unlinked correlation gaps.

Products are made in tiles of firms (``tiles``). Pairs are never written out: tiles emit what passes the threshold of
the strongest ``k`` pairs, or sums per stratum and the |correlation| of linked pairs, which come to their tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.operators.graph import SNAPSHOT_KEY
from firmament.operators.panel import UNKNOWN
from firmament.operators.tiles import TILE, tile_sums, top_pairs
from firmament.session import materialize

MIN_ROWS = 60
MIN_LINKED = 5
MIN_STRATUM = 3


def windows_before(series: DataFrame, snaps: DataFrame, calendar: DataFrame, window: int | None = None) -> DataFrame:
    """Each firm's last ``window`` rows strictly before each snapshot date.

    ``window=None`` takes the snapshot's own ``win``. The number of rows before a
    date comes from laying the calendar's steps over the snapshot dates.
    """
    length = F.lit(window) if window else F.col("win")
    if "sector" in series.columns:
        series = series.withColumn("sector", F.coalesce("sector", F.lit(UNKNOWN)))
    ends = rows_before(snaps, calendar).where(F.col("end") > 0)
    size = F.least(F.col("end"), length)
    # snapshot dates are listed once per row of the small side and attached to every series
    listed = ends.agg(F.collect_list(F.struct("snap_date", "win", "end")).alias("s")).select("s").scalar()
    return (
        series.withColumn("_e", F.explode(listed))
        .select(*[c for c in series.columns if c != "xs"], "xs", "_e.*")
        .select(*SNAPSHOT_KEY, *[c for c in series.columns if c != "xs"],
                F.slice("xs", F.col("end") - size + 1, size).alias("w"))
    )


def rows_before(snaps: DataFrame, calendar: DataFrame) -> DataFrame:
    """``end`` = number of calendar dates before each ``snap_date``.

    Calendar dates and snapshot dates are merged and counted in date order; both
    are bounded by the calendar.
    """
    from pyspark.sql import Window as W

    marks = calendar.select("date", F.lit(1).alias("day")).unionByName(
        snaps.select(F.col("snap_date").alias("date"), F.lit(0).alias("day")).distinct())
    at = marks.groupBy("date").agg(F.sum("day").alias("day"), F.min("day").alias("lo"))
    before = F.coalesce(F.sum("day").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = at.withColumn("end", before.cast("int"))
    return snaps.join(ranked.select(F.col("date").alias("snap_date"), "end"), "snap_date")


def corr_top_pairs(windows: DataFrame, k: DataFrame, tile: int = TILE) -> DataFrame:
    """The ``k`` most correlated pairs before each snapshot; ``k`` is ``(snap_date, win, k)``."""
    return top_pairs(windows, k, tile)


def strata_totals(windows: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs and summed |correlation| before each snapshot, per same/cross sector."""
    return _strata(tile_sums(windows, tile=tile))


def _strata(sums: DataFrame) -> DataFrame:
    return sums.where("layer is null").groupBy(*SNAPSHOT_KEY, "same").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"))


def linked_correlations(windows: DataFrame, edges: DataFrame, tile: int = TILE) -> DataFrame:
    """|correlation| of each linked pair and whether its firms share a sector."""
    return _linked(tile_sums(windows, edges, tile))


def _linked(sums: DataFrame) -> DataFrame:
    return sums.where("layer is not null").select(*SNAPSHOT_KEY, "layer", "src", "dst", F.col("total").alias("corr"), "same")


def stratified_gap(windows: DataFrame, edges: DataFrame, tile: int = TILE) -> DataFrame:
    """Mean |correlation| of linked minus unlinked pairs per (snapshot, layer).

    ``overall``, ``same_sector`` and ``cross_sector``; a stratum needs three pairs
    on either side, a snapshot five linked pairs and 60 rows.
    """
    sums = materialize(tile_sums(windows.where(F.size("w") >= MIN_ROWS), edges, tile), "corr-sums")
    linked = _linked(sums).groupBy(*SNAPSHOT_KEY, "layer").agg(
        *[F.count_if(F.col("same") == f).alias(f"n_{s}") for s, f in (("same", True), ("cross", False))],
        *[F.coalesce(F.sum(F.when(F.col("same") == f, F.col("corr"))), F.lit(0.0)).alias(f"l_{s}")
          for s, f in (("same", True), ("cross", False))])
    tot = _strata(sums).groupBy(*SNAPSHOT_KEY).agg(
        *[F.sum(F.when(F.col("same") == f, F.col(c))).alias(f"{p}_{s}")
          for s, f in (("same", True), ("cross", False)) for c, p in (("pairs", "all"), ("total", "sum"))])

    def gap(n, l, N, T):
        return l / n - F.try_divide(T - l, N - n)

    n_all, l_all = F.col("n_same") + F.col("n_cross"), F.col("l_same") + F.col("l_cross")
    N_all, T_all = F.col("all_same") + F.col("all_cross"), F.col("sum_same") + F.col("sum_cross")

    def stratum(s):
        n, N = F.col(f"n_{s}"), F.col(f"all_{s}")
        return F.when((n >= MIN_STRATUM) & (N - n >= MIN_STRATUM), gap(n, F.col(f"l_{s}"), N, F.col(f"sum_{s}")))

    return (
        linked.join(tot, SNAPSHOT_KEY).where(n_all >= MIN_LINKED)
        .select(*SNAPSHOT_KEY, "layer", n_all.alias("n_linked"), (l_all / n_all).alias("linked_corr"),
                F.try_divide(T_all - l_all, N_all - n_all).alias("unlinked_corr"),
                gap(n_all, l_all, N_all, T_all).alias("overall"),
                stratum("same").alias("same_sector"), stratum("cross").alias("cross_sector"))
    )
