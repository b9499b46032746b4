"""Training windows as arrays.

A firm's history is one row holding an array in time order (its length is the
calendar's, not the data's). Windows are then slices, made without another
shuffle and without a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.functions.scalars import array_quantile, array_sum, clip_array, let

LOOKBACK = 4 * 252
REFIT_EVERY = 20
WINSOR = 0.01


def firm_series(panel: DataFrame, value: str = "x", keys: tuple[str, ...] = ("pos", "firm")) -> DataFrame:
    """One row per firm; ``xs[i]`` is the value at t = i, NULL before the firm's first t.

    From its first to its last t a firm needs one row for each t; a gap or a
    repeated t is an error. Values may be NULL.
    """
    pairs = F.sort_array(F.collect_list(F.struct("t", F.col(value).alias("v"))))
    made = panel.groupBy(*keys).agg(F.transform(pairs, lambda s: s["v"]).alias("xs"), F.min("t").alias("_lo"),
                                    F.max("t").alias("_hi"), F.count_distinct("t").alias("_n"))
    dense = (F.size("xs") == F.col("_hi") - F.col("_lo") + 1) & (F.size("xs") == F.col("_n"))
    lead = F.array_repeat(F.lit(None).cast(panel.schema[value].dataType), F.col("_lo").cast("int"))
    xs = F.when(dense, F.concat(lead, "xs")).otherwise(F.raise_error(F.lit("a firm's series has a gap or a repeated t")))
    return made.select(*keys, xs.alias("xs"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over the session's full shuffle width.

    Windows multiply their input by lookback / refit_every; sized by the bytes
    going in, that work would be coalesced into too few tasks.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys)


def refit_windows(series: DataFrame, lookback: int = LOOKBACK, refit_every: int = REFIT_EVERY,
                  start: int = 0) -> DataFrame:
    """One row per (firm, refit day).

    ``w``   the ``lookback`` values strictly before the refit day,
    ``z``   the value before each forecast day, ``y`` the value on it; both
            cover the days until the next refit.

    A series that starts late gets its first refit ``lookback`` values after its
    start, on the same grid of refit days.
    """
    first = F.coalesce(F.array_position(F.transform("xs", lambda v: v.isNotNull()), True), F.lit(1)).cast("int") - 1
    base = max(lookback, start)
    late = F.greatest(first + F.lit(lookback - base), F.lit(0))
    t0 = F.lit(base) + F.ceil(late / F.lit(refit_every)).cast("int") * refit_every
    last = F.size("xs") - 1
    refits = F.when(last >= t0, F.sequence(t0, last, F.lit(refit_every)))
    keys = [c for c in series.columns if c != "xs"]
    r = F.col("refit")
    n = F.least(F.lit(refit_every), F.size("xs") - r)
    return series.select(*keys, "xs", F.explode(refits).alias("refit")).select(
        *keys, "refit",
        F.slice("xs", r - lookback + 1, F.lit(lookback)).alias("w"),
        F.slice("xs", r, n).alias("z"),
        F.slice("xs", r + 1, n).alias("y"),
    )


def winsorized(w: Column, q: float = WINSOR) -> Column:
    """Clip an array at its own interpolated ``q`` and ``1 - q`` quantiles; NULLs take no part and stay."""
    def clip(s):
        ends = F.struct(array_quantile(s, q).alias("lo"), array_quantile(s, 1.0 - q).alias("hi"))
        return let(ends, lambda e: clip_array(w, e["lo"], e["hi"]))

    return let(F.sort_array(F.array_compact(w)), clip)


def complete(windows: DataFrame) -> DataFrame:
    """Refuses windows with missing cells: a fit on them would be silently wrong."""
    missing = F.exists("w", lambda v: v.isNull())
    return windows.withColumn("w", F.when(missing, F.raise_error(F.lit("a training window has missing cells"))).otherwise(F.col("w")))


def with_winsorized(windows: DataFrame, q: float = WINSOR) -> DataFrame:
    return windows.withColumn("w", winsorized(F.col("w"), q))


def with_ar_fit(windows: DataFrame) -> DataFrame:
    """Add ``intercept`` and ``slope`` of each window's regression on its own lag.

    Where the lag is constant (to rounding) the minimum-norm solution is used.
    """
    windows = complete(windows)
    m = F.size("w") - 1
    mz, my = array_sum(F.col("_z")) / m, array_sum(F.col("_y")) / m
    dev = F.zip_with("_z", "_y", lambda z, y: F.struct(
        (z - F.col("_mz")).alias("z"), (y - F.col("_my")).alias("y")))
    zero = F.struct(F.lit(0.0).alias("zz"), F.lit(0.0).alias("zy"))
    moments = F.aggregate(dev, zero, lambda acc, d: F.struct(
        (acc["zz"] + d["z"] * d["z"]).alias("zz"), (acc["zy"] + d["z"] * d["y"]).alias("zy")))
    c = F.col("_mz")
    flat = F.col("_m.zz") <= F.pow(m * F.lit(2.220446049250313e-16), 2.0) * m * F.pow(1 + c * c, 2.0)
    norm = F.col("_my") / (1 + c * c)
    slope = F.when(flat, norm * c).otherwise(F.col("_m.zy") / F.col("_m.zz"))
    return (
        windows.withColumn("_z", F.slice("w", F.lit(1), m)).withColumn("_y", F.slice("w", F.lit(2), m))
        .withColumn("_mz", mz).withColumn("_my", my).withColumn("_m", moments)
        .withColumn("slope", slope)
        .withColumn("intercept", F.when(flat, norm).otherwise(F.col("_my") - F.col("slope") * c))
        .drop("_z", "_y", "_mz", "_my", "_m")
    )
