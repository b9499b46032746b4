"""Penalty choice by expanding-window validation; every grid point is its own group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.functions.linalg import fit_sparse

ALPHAS = [float(a) for a in np.logspace(-6, -2, 9)]
L1_RATIOS = [1.0, 0.5]
N_WINDOWS = 6
N_SPLITS = 4


def expanding_folds(n: int, k: int = N_SPLITS) -> list[tuple[int, int]]:
    """``(train rows, validation end)`` per fold; validation always follows training."""
    size = n // (k + 1)
    first = n - k * size
    return [(first + i * size, first + (i + 1) * size) for i in range(k)]


def fold_sums(pred: np.ndarray, truth: np.ndarray) -> dict[str, float]:
    """What the scores of a fold are made of: squares of errors and values, calls and those that were right."""
    return {"sse": float(np.square(truth - pred).sum()), "sst": float(np.square(truth).sum()),
            "calls": float(np.count_nonzero(pred)), "hits": float(np.count_nonzero((pred * truth > 0) & (pred != 0)))}


def fold_scores() -> dict[str, Column]:
    """Scores of a fold from its sums; without a call, direction is a coin's."""
    return {"r2": 1 - F.col("sse") / F.col("sst"),
            "dir_acc": F.when(F.col("calls") > 0, F.col("hits") / F.col("calls")).otherwise(0.5)}


def tuning_windows(series: DataFrame, lookback: int, n_windows: int = N_WINDOWS) -> DataFrame:
    """One row per (firm, window): the windows' ends are spread evenly over the sample."""
    T = F.size("xs")
    step = (T - 1 - lookback) / F.lit(float(n_windows - 1))
    ends = F.transform(F.sequence(F.lit(0), F.lit(n_windows - 1)),
                       lambda i: F.floor(F.lit(lookback) + i * step).cast("int"))
    return series.select("pos", "firm", "xs", F.posexplode(ends).alias("window", "window_end")).select(
        "pos", "firm", "window", "window_end", F.slice("xs", F.col("window_end") - lookback + 1, lookback).alias("w"))


def tune(series: DataFrame, lookback: int, alphas: list[float] = ALPHAS, l1_ratios: list[float] = L1_RATIOS,
         n_windows: int = N_WINDOWS) -> DataFrame:
    """Mean validation scores and coefficients kept, per (l1_ratio, window, alpha).

    ``series`` has unhedged log returns; windows are not winsorized.
    """
    grid = F.array(*[F.struct(F.lit(l).alias("l1_ratio"), F.lit(a).alias("alpha")) for l in l1_ratios for a in alphas])
    jobs = tuning_windows(series, lookback, n_windows).withColumn("g", F.explode(grid)).select(
        "g.l1_ratio", "g.alpha", "window", "window_end", "pos", "w")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        l1, alpha = float(pdf["l1_ratio"].iloc[0]), float(pdf["alpha"].iloc[0])
        W = np.stack(pdf["w"].to_numpy()).T
        Z, Y = W[:-1], W[1:]
        kept = (fit_sparse(W, alpha, l1)[1] != 0).sum() / W.shape[1]
        rows = []
        for train, end in expanding_folds(len(Z)):
            a, B = fit_sparse(W[: train + 1], alpha, l1)
            rows.append({"l1_ratio": l1, "window": int(pdf["window"].iloc[0]), "window_end": int(pdf["window_end"].iloc[0]),
                         "alpha": alpha, "nonzero_per_firm": float(kept), **fold_sums(a + Z[train:end] @ B.T, Y[train:end])})
        return pd.DataFrame(rows)

    folds = jobs.groupBy("l1_ratio", "window", "alpha").applyInPandas(
        score, "l1_ratio double, window int, window_end int, alpha double, nonzero_per_firm double, "
               "sse double, sst double, calls double, hits double")
    return folds.groupBy("l1_ratio", "window", "window_end", "alpha").agg(
        *(F.avg(c).alias(name) for name, c in fold_scores().items()), F.first("nonzero_per_firm").alias("nonzero_per_firm")).drop("window")


def mean_curve(scores: DataFrame, criterion: str) -> DataFrame:
    """alpha by l1_ratio table of the mean score, and of the coefficients kept per firm."""
    ratios = [str(r) for r in L1_RATIOS]
    kept = "nonzero_per_firm"
    wide = scores.groupBy("alpha").pivot("l1_ratio", L1_RATIOS).agg(F.avg(criterion).alias("score"), F.avg(kept).alias("kept"))
    return wide.select("alpha", *[F.col(f"`{r}_{a}`").alias(f"{b}_{r.replace('.', '_')}") for a, b in (("score", "l1"), ("kept", "kept"))
                                  for r in ratios])


def choose_alpha(scores: DataFrame, criterion: str = "dir_acc") -> DataFrame:
    """Peak of the averaged curve per l1_ratio; the smallest alpha wins a tie."""
    curve = scores.groupBy("l1_ratio", "alpha").agg(
        F.avg(criterion).alias("score"), F.avg("nonzero_per_firm").alias("nonzero_per_firm"))
    best = F.max_by(F.struct("alpha", "score", "nonzero_per_firm"), F.struct("score", -F.col("alpha"))).alias("b")
    return curve.groupBy("l1_ratio").agg(best).select("l1_ratio", "b.*")
