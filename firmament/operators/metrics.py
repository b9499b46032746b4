"""Scores of long forecast tables ``(model, t, firm, x, pred)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmament.functions.scalars import verdict
from firmament.functions.stats import normal_p


def statistical_metrics(forecasts: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Pooled scores against a zero forecast; direction ignores zero forecasts."""
    err = F.col("x") - F.col("pred")
    called = F.col("pred") != 0
    return (
        forecasts.where(F.col("x").isNotNull() & F.col("pred").isNotNull())
        .groupBy(*by).agg(
            (1 - F.sum(err * err) / F.sum(F.col("x") * F.col("x"))).alias("oos_r2"),
            F.avg(err * err).alias("mse"),
            F.avg(F.abs(err)).alias("mae"),
            F.avg(F.when(called, (F.signum("pred") == F.signum("x")).cast("double"))).alias("dir_acc"),
        )
    )


def nth_largest(values: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """``by, least``: of each group of ``values`` (``by, size``) the ``k``-th largest size; ``wanted`` is ``(by, k)``.

    Sizes are counted in bins of 1/64 of a power of two, so tasks merge counts and not rows; the bin that holds the k-th is
    then resolved by its distinct sizes. Windows see bins and those sizes, never a group's rows.
    """
    binned = values.withColumn("bin", F.coalesce(F.floor(F.log2(F.nullif("size", F.lit(0.0))) * 64), F.lit(-(1 << 20))))

    def upto(counts: DataFrame, order: str) -> DataFrame:
        run = F.sum("n").over(W.partitionBy(*by).orderBy(F.desc(order)))
        return counts.join(wanted, by).withColumn("upto", run).where(F.col("upto") >= F.col("k"))

    first = upto(binned.groupBy(*by, "bin").agg(F.count("*").alias("n")), "bin").groupBy(*by).agg(
        F.max_by(F.struct("bin", (F.col("k") - F.col("upto") + F.col("n")).alias("k")), "bin").alias("at"))
    first = first.select(*by, "at.bin", "at.k")
    inside = binned.join(first.select(*by, "bin"), [*by, "bin"]).groupBy(*by, "size").agg(F.count("*").alias("n"))
    run = F.sum("n").over(W.partitionBy(*by).orderBy(F.desc("size")))
    return inside.join(first.select(*by, "k"), by).withColumn("upto", run).where(F.col("upto") >= F.col("k")).groupBy(*by).agg(
        F.max("size").alias("least"))


def positions(forecasts: DataFrame, top_frac: float = 1.0, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Sign bets. Below 1, only the day's strongest ``ceil(top_frac * N)`` signals, ties kept."""
    f = forecasts.withColumn("pred", F.coalesce("pred", F.lit(0.0))).withColumn("x", F.coalesce("x", F.lit(0.0)))
    if top_frac < 1.0:
        day = [*by, "t"]
        k = f.groupBy(*day).agg(F.greatest(F.lit(1), F.ceil(F.lit(top_frac) * F.count("*"))).alias("k"))
        bound = nth_largest(f.select(*day, F.abs("pred").alias("size")), k, day)
        f = f.join(bound, day).withColumn("pred", F.when(F.abs("pred") >= F.col("least"), F.col("pred")).otherwise(0.0)).drop("least")
    return f.withColumn("bet", F.signum("pred"))


def daily_pnl(forecasts: DataFrame, top_frac: float = 1.0, by: tuple[str, ...] = ("model",)) -> DataFrame:
    bets = positions(forecasts, top_frac, by)
    return bets.groupBy(*by, "t").agg(
        F.sum(F.col("bet") * F.col("x")).alias("pnl"),
        F.count_if(F.col("bet") != 0).alias("trades"),
        F.count_if((F.col("bet") != 0) & (F.col("bet") == F.signum("x"))).alias("hits"),
    )


def sharpe_moments(pnl: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Per-period Sharpe ratio with the statistic that allows for skew and fat tails."""
    sr, g3, g4 = F.col("sharpe"), F.col("skew"), F.col("kurt")
    spread = F.sqrt((1 - g3 * sr + (g4 - 1) * sr * sr / 4) / (F.col("n") - 1))
    return (
        pnl.groupBy(*by).agg(
            F.count("*").alias("n"), F.avg("pnl").alias("mean_pnl"), F.stddev_samp("pnl").alias("sd_pnl"),
            F.skewness("pnl").alias("skew"), (F.kurtosis("pnl") + 3).alias("kurt"),
            F.sum("pnl").alias("total_pnl"), F.sum("trades").alias("trades"), F.sum("hits").alias("hits"),
        )
        .withColumn("sharpe", F.when(F.col("sd_pnl") > 0, F.col("mean_pnl") / F.col("sd_pnl")))
        .withColumn("z", sr / spread)
    )


def economic_metrics(forecasts: DataFrame, top_frac: float = 1.0, periods_per_year: float = 252.0,
                     by: tuple[str, ...] = ("model",)) -> DataFrame:
    m = sharpe_moments(daily_pnl(forecasts, top_frac, by), by)
    return m.select(
        *by,
        (F.col("sharpe") * F.sqrt(F.lit(float(periods_per_year)))).alias("ann_sharpe"),
        normal_p("z").alias("sharpe_p"),
        (F.col("total_pnl") / F.greatest("trades", F.lit(1)) * 1e4).alias("ppt_bps"),
        F.try_divide("hits", "trades").alias("hit_ratio"),
    )


def loss_differentials(forecasts: DataFrame, pairs: list[tuple[str, str]],
                       by: tuple[str, ...] = ()) -> DataFrame:
    """Mean squared-error difference per day for each named pair, on common days.

    Each forecast row is sent to the pairs it takes part in, signed by its side,
    so one aggregation serves all pairs and no forecast table is joined to itself.
    """
    roles: dict[str, list] = {}
    for a, b in pairs:
        roles.setdefault(a, []).append((a, b, 1.0))
        roles.setdefault(b, []).append((a, b, -1.0))
    role = F.lit(None)
    for model, parts in roles.items():
        arr = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.lit(s).alias("side"))
                        for a, b, s in parts])
        role = F.when(F.col("model") == model, arr).otherwise(role)
    cell = (
        forecasts.where(F.col("model").isin(sorted(roles)))
        .withColumn("_r", F.explode(role))
        .select(*by, "_r.model_a", "_r.model_b", "_r.side", "t", "firm",
                F.pow(F.col("pred") - F.col("x"), 2.0).alias("se"))
        .groupBy(*by, "model_a", "model_b", "t", "firm")
        .agg(F.sum(F.col("side") * F.col("se")).alias("d"), F.count("se").alias("_n"))
        .where(F.col("_n") == 2)
    )
    return cell.groupBy(*by, "model_a", "model_b", "t").agg(F.avg("d").alias("d"))


def diebold_mariano(forecasts: DataFrame, pairs: list[tuple[str, str]], by: tuple[str, ...] = (),
                    a_better: str = "model_a better", b_better: str = "model_b better") -> DataFrame:
    """Equal-accuracy statistic per pair, no autocorrelation correction; negative favours ``model_a``."""
    var = F.var_samp("d")
    return (
        loss_differentials(forecasts, pairs, by).groupBy(*by, "model_a", "model_b")
        .agg(F.count("*").alias("days"), F.when(var > 0, F.avg("d") / F.sqrt(var / F.count("*"))).alias("dm"))
        .withColumn("p_value", normal_p("dm"))
        .withColumn("verdict", verdict(F.col("dm"), F.col("p_value"), a_better, b_better))
    )
