"""Activity targets: log activity against its own trailing mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmament.functions.scalars import log_eps

DEMEAN_WINDOW = 63
DEMEAN_MIN = 21


def log_demeaned(panel: DataFrame, value: str, out: str = "target") -> DataFrame:
    """``log(value + eps)`` minus the mean of the 63 rows before it (at least 21 known).

    Needs the full row grid of each firm. Dates on which no firm has a target
    are dropped, single missing cells are kept as NULL.
    """
    trailing = W.partitionBy("firm").orderBy("t").rowsBetween(-DEMEAN_WINDOW, -1)
    logged = panel.withColumn("_l", log_eps(F.col(value)))
    mean = F.when(F.count("_l").over(trailing) >= DEMEAN_MIN, F.avg("_l").over(trailing))
    scored = logged.withColumn(out, F.col("_l") - mean).drop("_l")
    live = scored.where(F.col(out).isNotNull()).select("t").distinct()
    return scored.join(live, "t", "left_semi")


def absret_target(returns: DataFrame) -> DataFrame:
    return log_demeaned(returns.withColumn("a", F.abs(F.log1p("r"))), "a")


def volume_target(volume: DataFrame) -> DataFrame:
    return log_demeaned(volume, "volume")


def rv_target(returns: DataFrame, window: int = 21) -> DataFrame:
    """Root mean square of the last ``window`` log returns, only where all are known."""
    span = W.partitionBy("firm").orderBy("t").rowsBetween(-(window - 1), 0)
    sq = returns.withColumn("_q", F.pow(F.log1p("r"), 2.0))
    rv = F.when(F.count("_q").over(span) == window, F.sqrt(F.avg("_q").over(span)))
    return log_demeaned(sq.withColumn("rv", rv).drop("_q"), "rv")


TARGETS = {"returns": None, "absret": absret_target, "volume": volume_target, "rv": rv_target}


def lag1_autocorr(panel: DataFrame, value: str = "x", by: list[str] | None = None) -> DataFrame:
    """Lag-1 autocorrelation per firm."""
    by = by or ["firm"]
    prev = F.lag(value).over(W.partitionBy(*by).orderBy("t"))
    return panel.withColumn("_p", prev).groupBy(*by).agg(F.corr(value, "_p").alias("autocorr"))
