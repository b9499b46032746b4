"""Panel ETL: wide matrices, calendars, sectors, universes, returns.

The canonical panel is long: ``(date, firm, value)``. ``t`` is the dense ordinal
of a date among the panel's dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def unpivot_matrix(wide: DataFrame, id_col: str = "ticker", value: str = "value", firm: str = "firm") -> DataFrame:
    """Day columns named ``X20000103`` to one row per (date, firm)."""
    days = [c for c in wide.columns if c != id_col]
    return (
        wide.unpivot([id_col], days, "day", value)
        .select(F.to_date(F.ltrim("day", F.lit("X")), "yyyyMMdd").alias("date"),
                F.col(id_col).alias(firm),
                F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias(value))
    )


def pivot_matrix(panel: DataFrame, value: str, dates: list, firm: str = "firm") -> DataFrame:
    """The inverse: one row per firm, one column per date in ``dates``."""
    return (
        panel.withColumn("day", F.concat(F.lit("X"), F.date_format("date", "yyyyMMdd")))
        .groupBy(firm).pivot("day", [f"X{d:%Y%m%d}" for d in dates]).agg(F.first(value))
    )


def calendar_of(panel: DataFrame) -> DataFrame:
    """``(date, t)``. The window sees distinct dates only: a DATE column has at
    most one row per calendar day however many rows the panel has."""
    return panel.select("date").distinct().select("date", (F.row_number().over(W.orderBy("date")) - 1).alias("t"))


def searchsorted_left(calendar: DataFrame, day: Column) -> DataFrame:
    """One row with the number of calendar dates before ``day``."""
    return calendar.agg(F.count_if(F.col("date") < day).cast("int").alias("pos"))


def calendar_extra(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Panel dates that are not trading days."""
    return panel.select("date").distinct().join(calendar.select("date"), "date", "left_anti")


def calendar_missing(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trading days inside the panel's range that the panel lacks."""
    span = panel.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    inside = calendar.select("date").where(
        F.col("date").between(span.select("lo").scalar(), span.select("hi").scalar()))
    return inside.join(panel.select("date").distinct(), "date", "left_anti")


def gaps_by_firm(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """``firm, date``: the trading days between a firm's first and last day that it lacks.

    A firm's days and the calendar are arrays no longer than the calendar, so a firm is one row of the aggregate.
    """
    days = calendar.agg(F.array_sort(F.collect_set("date")).alias("c")).select("c").scalar()
    firm = panel.where(F.col("date").isNotNull()).groupBy("firm").agg(F.collect_set("date").alias("own"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    inside = F.filter("days", lambda d: d.between(F.col("lo"), F.col("hi")))
    return firm.withColumn("days", days).select("firm", F.explode(F.array_except(inside, "own")).alias("date"))


def validate_panel(panel: DataFrame, calendar: DataFrame, value: str = "value",
                   max_missing_days: int = 10, max_missing_cells: int = 50) -> DataFrame:
    """Raise on a broken panel, else return it with missing cells set to 0."""
    extra = calendar_extra(panel, calendar).count()
    if extra:
        raise ValueError(f"{extra} panel dates are not trading days")
    missing = calendar_missing(panel, calendar).count()
    if missing > max_missing_days:
        raise ValueError(f"panel lacks {missing} trading days")
    nulls = panel.where(F.col(value).isNull() | F.isnan(value)).count()
    if nulls > max_missing_cells:
        raise ValueError(f"panel has {nulls} missing values")
    return panel.withColumn(value, F.coalesce(F.nanvl(value, F.lit(None)), F.lit(0.0)))


def resolve_sector(firms: DataFrame, preferred: DataFrame, fallback: DataFrame, market: str = "SPY") -> DataFrame:
    """``preferred`` label, else ``fallback`` (its market rows removed), else Unknown."""
    fb = fallback.where(F.col("sector") != market).select("firm", F.col("sector").alias("fb"))
    return (
        firms.select("firm")
        .join(preferred.select("firm", F.col("sector").alias("pf")), "firm", "left")
        .join(fb, "firm", "left")
        .select("firm", F.coalesce("pf", "fb", F.lit(UNKNOWN)).alias("sector"))
    )


def top_by_mean(panel: DataFrame, sectors: DataFrame, n: int = 100, value: str = "volume") -> DataFrame:
    """``(pos, firm)`` of the ``n`` firms with the largest mean, sector known.

    ``limit`` plans as a distributed top-k; the ordinal window that follows sees
    the ``n`` rows it returned.
    """
    known = sectors.where(F.col("sector") != UNKNOWN)
    top = (
        panel.groupBy("firm").agg(F.avg(value).alias("mean_value"))
        .where(F.col("mean_value").isNotNull())
        .join(known, "firm", "left_semi")
        .orderBy(F.desc("mean_value"), "firm").limit(n)
    )
    order = W.orderBy(F.desc("mean_value"), "firm")
    return top.select((F.row_number().over(order) - 1).alias("pos"), "firm", "mean_value")


def dense_grid(firms: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every (firm, t) of the given firms, generated per firm rather than cross joined."""
    return firms.withColumn("_last", calendar.agg(F.max("t")).scalar()).select(
        *firms.columns, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("t"))


def simple_returns(prices: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``r = price / last known price - 1`` per firm; a missing cell returns 0."""
    by = by or ["firm"]
    before = W.partitionBy(*by).orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    prev = F.last("price", ignorenulls=True).over(before)
    return prices.withColumn("r", F.coalesce(F.col("price") / prev - 1, F.lit(0.0)))


def excess(returns: DataFrame, market: DataFrame | None) -> DataFrame:
    """``x = log1p(r) - log1p(market r)``; unhedged when ``market`` is None."""
    if market is None:
        return returns.withColumn("x", F.log1p("r"))
    return (
        returns.join(market.select("t", F.col("r").alias("mkt_r")), "t", "left")
        .withColumn("x", F.log1p("r") - F.log1p("mkt_r")).drop("mkt_r")
    )


def horizon_blocks(panel: DataFrame, horizon: int, value: str = "x") -> DataFrame:
    """Sum runs of ``horizon`` rows; the last block may be shorter. Labelled by its first date."""
    if horizon == 1:
        return panel.select("date", "t", "firm", value)
    block = F.floor(F.col("t") / horizon).cast("int")
    return panel.groupBy(block.alias("t"), "firm").agg(
        F.min("date").alias("date"), F.sum(value).alias(value)).select("date", "t", "firm", value)


def slice_rows(panel: DataFrame, calendar: DataFrame, start: str, end: str, warmup: int = 4 * 252 + 10) -> DataFrame:
    """Rows ``[pos(start) - warmup, pos(end)]`` inclusive, renumbered from 0."""
    lo = searchsorted_left(calendar, F.to_date(F.lit(start))).select(
        F.greatest(F.lit(0), F.col("pos") - warmup)).scalar()
    hi = searchsorted_left(calendar, F.to_date(F.lit(end))).scalar()
    return panel.where(F.col("t").between(lo, hi)).withColumn("t", (F.col("t") - lo).cast("int"))


def scaled_lookback(horizon: int) -> int:
    return max(60, int(4 * 252 / horizon))


def periods_per_year(horizon: int) -> float:
    return 252 / horizon
