"""What several text operators share: reading, size-checked joins, words in SQL and in numpy."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament.session import materialize, ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# A set of ids up to this many rows (16 bytes each) is copied to every executor; a larger one is joined by shuffle.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def join_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner",
               rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join that copies ``right`` to the executors only if it was counted and is small; else both sides are shuffled.

    ``right`` has a few fixed-width columns and should be cheap to count (a written table).
    """
    small = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if small else right, on, how)


def measured_bytes(df: DataFrame) -> int:
    """The bytes of all values of ``df``, a written table: strings by their length, eight for the rest."""
    wide = ("string", "binary", "array", "map", "struct")
    size = sum((F.coalesce(F.octet_length(F.col(f.name) if f.dataType.typeName() in wide[:2] else F.to_json(F.struct(f.name))), F.lit(0)) + 16
                if f.dataType.typeName() in wide else F.lit(8)) for f in df.schema.fields)
    return df.agg(F.sum(size)).first()[0] or 0


def join_measured(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Join that copies ``right``, a written table, to the executors if its values take at most ``most`` bytes; else a shuffle."""
    return left.join(F.broadcast(right) if measured_bytes(right) <= most else right, on, how)


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, or it with underscores behind it: a working column that no column of ``frames`` clashes with."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def body(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(w: Column) -> Column:
    """Lower-cases A-Z alone; ``lower`` does it wherever no other letter is there."""
    return F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased, in order."""
    plain = F.array_remove(F.split(F.lower(text), NOT_WORD), "")
    mixed = F.transform(F.array_remove(F.split(text, NOT_WORD), ""), ascii_lower)
    return F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(mixed)


# ---- numpy, inside tasks -------------------------------------------------------

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half the output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.cache
def _weights() -> np.ndarray:
    return mix(np.arange(1, 4097, dtype=U64)) | U64(1)


@functools.cache
def _letters() -> np.ndarray:
    """0 for what parts words, the lower-cased code below 128, 1 for all code points from 128 on."""
    out = np.array([p if chr(p).isalnum() else 0 for p in range(128)] + [1], dtype=np.uint32)
    out[65:91] += 32
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def segment_hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment of ``points``; segments touch, ``starts`` has their first positions."""
    if not len(starts):
        return np.empty(0, dtype=U64)
    lens = np.diff(np.append(starts, len(points)))
    inside = (np.arange(len(points)) - np.repeat(starts, lens)) & 4095
    return mix(np.add.reduceat(points * _weights()[inside], starts) + lens.astype(U64) * _ODD)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each lower-cased word of a text, in order."""
    return word_hash_lists([text])[0]


def word_hash_lists(texts: list[str]) -> list[np.ndarray]:
    """``word_hashes`` of several texts, in one pass over their characters."""
    a = code_points("\n".join(texts))
    low = _letters()[np.minimum(a, 128)]
    at = np.flatnonzero(low)
    if not len(at):
        return [np.empty(0, dtype=U64) for _ in texts]
    points = low[at]
    points = np.where(points == 1, a[at], points)
    starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    h = segment_hashes(points.astype(U64), starts)
    edges = np.cumsum([len(t) + 1 for t in texts])[:-1]
    return np.split(h, np.searchsorted(at[starts], edges))


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns memory that numpy and Arrow have freed to the system; a reused Python worker would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def text_groups(texts: list[str], size: int = 1 << 18):
    """Runs of texts of some ``size`` characters, one longer text alone."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def column_groups(column, rows: int = 1000):
    """``text_groups`` of an Arrow column, of which only some ``rows`` are Python strings at a time."""
    for lo in range(0, len(column), rows):
        yield from text_groups(column.slice(lo, rows).to_pylist())


__all__ = ["BROADCAST_BYTES", "BROADCAST_ROWS", "ascii_lower", "body", "code_points", "column_groups", "free_name", "give_back", "join_measured", "join_small", "materialize", "mix", "segment_hashes",
           "ship_package", "table", "word_hashes", "words"]
