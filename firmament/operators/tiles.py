"""Correlations of any number of firms, in tiles.

The firms of a window are cut into blocks of ``TILE``. A block is one row of a table: its standardised series as a matrix. Each block
is sent to the tiles it takes part in, one for each pair of blocks, and a task holds two blocks and their product whatever
the width of the universe. What tiles give is mergeable: histograms of |correlation| give the threshold of the ``k``
strongest pairs, so that a tile emits only what passes it; sums per stratum are added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmament.functions.linalg import unit_columns
from firmament.operators.graph import SNAPSHOT_KEY
from firmament.operators.panel import UNKNOWN
from firmament.session import materialize

TILE = 256
BINS = 4096
BLOCK = "snap_date date, win int, block int, rows int, pos binary, firms binary, sectors array<string>, unit binary"


def blocks(windows: DataFrame, tile: int = TILE) -> DataFrame:
    """One row per window and block of ``tile`` universe positions: positions, firms, sectors and the standardised series."""
    sector = F.coalesce("sector", F.lit(UNKNOWN)) if "sector" in windows.columns else F.lit(UNKNOWN)
    cut = windows.select(*SNAPSHOT_KEY, F.floor(F.col("pos") / tile).cast("int").alias("block"), F.col("pos").cast("long").alias("pos"),
                         F.col("firm").cast("long").alias("firm"), sector.alias("sector"), "w")

    def pack(key, rows):
        pos = rows.column("pos").to_numpy()
        by = np.argsort(pos, kind="stable")
        W = np.stack([np.asarray(w, dtype=np.float64) for w in rows.column("w").to_pylist()])[by]
        sector = rows.column("sector").to_pylist()
        return pa.table({
            "snap_date": [key[0].as_py()], "win": pa.array([key[1].as_py()], pa.int32()), "block": pa.array([key[2].as_py()], pa.int32()),
            "rows": pa.array([W.shape[1]], pa.int32()), "pos": [pos[by].astype(np.int64).tobytes()],
            "firms": [rows.column("firm").to_numpy()[by].astype(np.int64).tobytes()], "sectors": [[sector[i] for i in by]],
            "unit": [np.ascontiguousarray(unit_columns(W.T).T).tobytes()]})

    return cut.groupBy(*SNAPSHOT_KEY, "block").applyInArrow(pack, BLOCK)


def tiles(blocked: DataFrame) -> DataFrame:
    """``blocked`` with ``a`` and ``b``, a row for each tile the block is in: at most two rows a tile."""
    last = blocked.groupBy(*SNAPSHOT_KEY).agg(F.max("block").alias("last"))
    each = blocked.join(last, SNAPSHOT_KEY).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return each.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("last", "other")


class Tile:
    """The product of one tile's blocks. ``at`` are the pairs it answers for: all of two blocks, those above the diagonal of one."""

    def __init__(self, a: int, b: int, rows: pa.Table):
        at = {n: i for i, n in enumerate(rows.column("block").to_pylist())}
        self.whole = a in at and b in at
        if self.whole:
            self.pos, self.firm, self.sector, unit = zip(*(self._side(rows, at[x]) for x in (a, b)), strict=True)
            self.corr = np.clip(unit[0] @ unit[1].T, -1.0, 1.0)
            self.strength = np.round(np.abs(self.corr), 12)
            self.at = np.nonzero(self.pos[0][:, None] < self.pos[1][None, :])

    @staticmethod
    def _side(rows: pa.Table, i: int):
        pos, firm = (np.frombuffer(rows.column(c)[i].as_py(), np.int64) for c in ("pos", "firms"))
        unit = np.frombuffer(rows.column("unit")[i].as_py(), np.float64).reshape(len(pos), rows.column("rows")[i].as_py())
        return pos, firm, np.array(rows.column("sectors")[i].as_py(), dtype=object), unit


def _bins(strength: np.ndarray) -> np.ndarray:
    return np.minimum((strength * BINS).astype(np.int64), BINS - 1)


def top_pairs(windows: DataFrame, k: DataFrame, tile: int = TILE) -> DataFrame:
    """The ``k`` most correlated pairs of each window, ties by position; ``k`` is ``(snap_date, win, k)``."""
    wanted = k.where(F.col("k") > 0).select(*SNAPSHOT_KEY, F.col("k").cast("long").alias("k"))
    blocked = materialize(blocks(windows.join(wanted, SNAPSHOT_KEY, "left_semi"), tile), "corr-blocks")

    def histogram(key, rows):
        t = Tile(key[2].as_py(), key[3].as_py(), rows)
        n = np.bincount(_bins(t.strength[t.at]), minlength=BINS) if t.whole else np.zeros(0, np.int64)
        bins = np.flatnonzero(n)
        return pa.table({"snap_date": pa.array([key[0].as_py()] * len(bins), pa.date32()), "win": pa.array([key[1].as_py()] * len(bins), pa.int32()),
                         "bin": pa.array(bins, pa.int32()), "n": pa.array(n[bins], pa.int64())})

    keys = [*SNAPSHOT_KEY, "a", "b"]
    hist = tiles(blocked).groupBy(*keys).applyInArrow(histogram, "snap_date date, win int, bin int, n long").groupBy(*SNAPSHOT_KEY, "bin").agg(F.sum("n").alias("n"))
    # At most BINS rows a window.
    above = F.sum("n").over(Window.partitionBy(*SNAPSHOT_KEY).orderBy(F.desc("bin")))
    cum = hist.join(wanted, SNAPSHOT_KEY).withColumn("upto", above)
    bound = cum.groupBy(*SNAPSHOT_KEY).agg(
        F.coalesce(F.max(F.when(F.col("upto") >= F.col("k"), F.col("bin"))), F.lit(-1)).alias("least"), F.first("k").alias("k"),
        F.coalesce(F.max(F.when(F.col("upto") < F.col("k"), F.col("upto"))), F.lit(0)).alias("surer"))
    bound = materialize(bound, "corr-bounds")

    def passing(key, rows):
        t = Tile(key[2].as_py(), key[3].as_py(), rows)
        if not t.whole:
            return pa.table({c: pa.array([], x) for c, x in PASSED.items()})
        least = rows.column("least")[0].as_py()
        i, j = t.at
        bins = _bins(t.strength[i, j])
        i, j, bins = (x[bins >= least] for x in (i, j, bins))
        cols = ([key[0].as_py()] * len(i), [key[1].as_py()] * len(i), t.pos[0][i], t.pos[1][j], t.firm[0][i], t.firm[1][j],
                np.abs(t.corr[i, j]), t.strength[i, j], bins > least)
        return pa.table({c: pa.array(v, x) for (c, x), v in zip(PASSED.items(), cols, strict=True)})

    found = tiles(blocked).join(bound.select(*SNAPSHOT_KEY, "least"), SNAPSHOT_KEY).groupBy(*keys).applyInArrow(
        passing, "snap_date date, win int, i long, j long, x long, y long, weight double, strength double, sure boolean")
    found = materialize(found, "corr-passing")
    # Only pairs in the threshold's own bin are ranked.
    rank = F.row_number().over(Window.partitionBy(*SNAPSHOT_KEY).orderBy(F.desc("strength"), "i", "j"))
    edge = found.where(~F.col("sure")).withColumn("rank", rank).join(bound, SNAPSHOT_KEY).where(F.col("rank") <= F.col("k") - F.col("surer"))
    cols = [*SNAPSHOT_KEY, F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "weight"]
    return found.where("sure").select(*cols).unionByName(edge.select(*cols))


PASSED = {"snap_date": pa.date32(), "win": pa.int32(), "i": pa.int64(), "j": pa.int64(), "x": pa.int64(), "y": pa.int64(),
          "weight": pa.float64(), "strength": pa.float64(), "sure": pa.bool_()}
SUMS = {"snap_date": pa.date32(), "win": pa.int32(), "layer": pa.string(), "src": pa.int64(), "dst": pa.int64(), "same": pa.bool_(),
        "pairs": pa.int64(), "total": pa.float64()}


def tile_sums(windows: DataFrame, edges: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """``snap_date, win, layer, src, dst, same, pairs, total``: one pass over all tiles.

    Rows without ``layer`` are pairs and summed |correlation| of a tile within and across sectors; the others are the ``edges``
    (``snap_date, win, layer, src, dst``) whose firms both have a window, with their |correlation|.
    """
    where = windows.select(*SNAPSHOT_KEY, F.col("firm").cast("long").alias("firm"), F.floor(F.col("pos") / tile).cast("int").alias("block"))
    if edges is None:
        edges = windows.sparkSession.createDataFrame([], "snap_date date, win int, layer string, src long, dst long")
    ends = edges.select(*SNAPSHOT_KEY, "layer", "src", "dst")
    for end, block in (("src", "p"), ("dst", "q")):
        ends = ends.join(where.withColumnsRenamed({"firm": end, "block": block}), [*SNAPSHOT_KEY, end])
    ends = ends.select(*SNAPSHOT_KEY, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "layer", F.col("src").cast("long").alias("src"),
                       F.col("dst").cast("long").alias("dst"))

    def sums(key, rows, linked):
        t = Tile(key[2].as_py(), key[3].as_py(), rows) if rows.num_rows else None
        if t is None or not t.whole:
            return pa.table({c: pa.array([], x) for c, x in SUMS.items()})
        same = t.sector[0][:, None] == t.sector[1][None, :]
        size, on = np.abs(t.corr), same[t.at]
        out = [(None, None, None, flag, int((on == flag).sum()), float(size[t.at][on == flag].sum())) for flag in (True, False)]
        row, col = ({int(f): n for n, f in enumerate(side)} for side in t.firm)
        for layer, src, dst in zip(*(linked.column(c).to_pylist() for c in ("layer", "src", "dst")), strict=True):
            i, j = (row[src], col[dst]) if src in row and dst in col else (row[dst], col[src])
            out.append((layer, src, dst, bool(same[i, j]), 1, float(size[i, j])))
        cols = [[key[0].as_py()] * len(out), [key[1].as_py()] * len(out), *zip(*out, strict=True)]
        return pa.table({c: pa.array(v, x) for (c, x), v in zip(SUMS.items(), cols, strict=True)})

    keys = [*SNAPSHOT_KEY, "a", "b"]
    blocked = materialize(blocks(windows, tile), "corr-blocks")
    return tiles(blocked).groupBy(*keys).cogroup(ends.groupBy(*keys)).applyInArrow(
        sums, "snap_date date, win int, layer string, src long, dst long, same boolean, pairs long, total double")
