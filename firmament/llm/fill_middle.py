"""Fill-in-the-middle training texts, cut at token ends.

A text's tokens are runs of white space with the word after them (white space at the end is a token of its own). The ends
of its tokens are kept in a boundary set laid out like a Roaring bitmap: positions are dealt by their upper 16 bits to
containers, each of which is a sorted array, a bitmap or a list of runs, whichever takes least, with the cumulative
cardinalities of the containers beside them. The end of the k-th token is then a search for the container and a select
inside it. Two draws from a hash of seed and id say after how many tokens prefix and middle end, two more the form.

``plain`` is the text; ``psm`` is ``<P>prefix<S>suffix<M>middle``; ``spm`` is ``<S>suffix<P>prefix<M>middle``. Texts that
are empty or hold one of the three marks stay plain, so the marks of an output are its own and the text can be rebuilt.

Null texts count as empty. Rows without an id are drawn as the id of no digits, so equal texts without ids are cut alike.
Repeated rows give repeated results. Texts of any length are cut whole, in the task that reads them; an empty table
gives an empty one. Only id and text are read: other columns may have any name and do not appear in the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import body, code_points, ship_package

SEED, RATE, SPM_SHARE = 42, 50, 80  # per cent of the texts, and of the transformed ones
MARKS = ("<P>", "<S>", "<M>")
ARRAY, BITMAP, RUNS = range(3)
WORDS64 = 1 << 10  # 64-bit words of a bitmap container


class BoundarySet:
    """A set of positions below 2 ** 32, made of ascending ``positions``; ``select`` gives the k-th of them."""

    __slots__ = ("before", "containers", "keys")

    def __init__(self, positions: np.ndarray):
        positions = np.asarray(positions, dtype=np.int64)
        self.keys, first, counts = np.unique(positions >> 16, return_index=True, return_counts=True)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        low = (positions & 0xFFFF).astype(np.uint16)
        self.containers = [self._container(low[a:a + n]) for a, n in zip(first.tolist(), counts.tolist(), strict=True)]

    @staticmethod
    def _container(low: np.ndarray) -> tuple:
        """The smallest of the three forms: two bytes a value, 8 KiB, or four bytes a run."""
        starts = np.flatnonzero(np.diff(low.astype(np.int32), prepend=-2) != 1)
        if 4 * len(starts) < min(2 * len(low), 8 * WORDS64):
            lens = np.diff(np.append(starts, len(low)))
            return RUNS, low[starts], np.concatenate([[0], np.cumsum(lens)])
        if 2 * len(low) <= 8 * WORDS64:
            return ARRAY, low
        bits = np.zeros(WORDS64, dtype=np.uint64)
        np.bitwise_or.at(bits, low >> 6, np.uint64(1) << (low & 63).astype(np.uint64))
        return BITMAP, bits, np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The ``k``-th smallest position, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        c = int(np.searchsorted(self.before, k, side="right")) - 1
        return (int(self.keys[c]) << 16) | self._local(self.containers[c], k - int(self.before[c]))

    @staticmethod
    def _local(container: tuple, k: int) -> int:
        kind, data = container[:2]
        if kind == ARRAY:
            return int(data[k])
        at = int(np.searchsorted(container[2], k, side="right")) - 1  # the run, or the word of the bitmap
        k -= int(container[2][at])
        if kind == RUNS:
            return int(data[at]) + k
        word = int(data[at])
        for _ in range(k):
            word &= word - 1
        return (at << 6) + (word & -word).bit_length() - 1


def token_ends(text: str) -> np.ndarray:
    """The positions in code points at which the tokens of a text end, ascending; the last is its length."""
    a = code_points(text)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    last = np.append(space[1:], True) & ~space  # the last character of each word
    if len(a):
        last[-1] = True
    return np.flatnonzero(last) + 1


def cuts(text: str, a: int, b: int) -> tuple[int, int, int]:
    """How many tokens a text has and where its prefix and its middle end, given two draws."""
    bounds = BoundarySet(token_ends(text))
    n = len(bounds)
    units = sorted((a % (n + 1), b % (n + 1)))
    return n, *(bounds.select(u - 1) if u else 0 for u in units)


def cut_offsets(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = [cuts(*row) for row in zip(texts, a, b, strict=True)]
    return pd.DataFrame(rows, columns=["n", "first", "second"])


def draws(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four 32-bit numbers from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
                   spm_share: int = SPM_SHARE) -> DataFrame:
    """Per row: id, ``text`` (null as empty), ``n`` tokens, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``."""
    ship_package(docs.sparkSession)
    h = draws(F.col(id_col), seed)
    src = docs.select(F.col(id_col).alias("_id"), body(text_col).alias("text"), *[x.alias(f"_h{i}") for i, x in enumerate(h)])
    cut = src.withColumn("_cut", F.pandas_udf(cut_offsets, "n long, first int, second int")("text", "_h0", "_h1"))
    marked = F.lit(False)
    for m in MARKS:
        marked |= F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (F.col("_h2") % 100 >= rate)
    cut = cut.select("_id", "text", "_cut.*", F.when(plain, "plain").when(F.col("_h3") % 100 < spm_share, "spm").otherwise("psm").alias("form"))
    end = F.length("text")
    prefix = F.substring("text", F.lit(1), F.col("first"))
    middle = F.substring("text", F.col("first") + 1, F.col("second") - F.col("first"))
    suffix = F.substring("text", F.col("second") + 1, end - F.col("second"))
    p, s, m = map(F.lit, MARKS)
    output = (F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .otherwise(F.concat(s, suffix, p, prefix, m, middle)))
    moved = F.col("form") != "plain"
    return cut.select(F.col("_id").alias(id_col), "text", "n", "form", F.when(moved, F.col("first").cast("long")).alias("prefix_chars"),
                      F.when(moved, (F.col("second") - F.col("first")).cast("long")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of, from output and form alone."""
    p, s, m = map(F.lit, MARKS)
    one, two = F.lit(1), F.lit(2)

    def between(a: Column, b: Column) -> Column:
        return F.split_part(F.split_part(output, a, two), b, one)

    middle = F.split_part(output, m, two)
    return (F.when(form == "plain", output).when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
            .otherwise(F.concat(between(p, m), middle, between(s, p))))
