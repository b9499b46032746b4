"""A toxicity classifier that does not lean on the groups a text names.

A logistic model over words and word beginnings is fitted to labelled texts. For every fitted text that names a group, a
second version names another group instead, and the squared change of the score between the two is penalised, so mentions
of a group by themselves move a score little.

The fit uses at most ``SAMPLE`` labelled rows (those with the smallest hash of their id) and ``VOCABULARY`` features, the
most telling by likelihood ratio; only their feature numbers reach the driver, never texts. Rows with a null label or id
are not fitted, repeated labels of an id count once (the larger). Every text is scored whole; null counts as empty, and an
empty text gets the model's base score. Without labelled texts of both kinds every score is the base rate, 0 without any.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import body, join_small, materialize, ship_package

SAMPLE, VOCABULARY = 24_000, 1024
LEAST_TEXTS = 4  # a feature must be in so many fitted texts
THRESHOLD = 0.7
RIDGE, SWAP_PENALTY, STEPS, RATE = 2e-5, 10.0, 400, 0.1
TOKEN = re.compile(r"[^\W_]+")
BEGINNINGS = (3, 4, 5)
# Terms that name groups of people; a term is exchanged for the next of its own line.
GROUPS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["female", "male"], ["mothers", "fathers"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "arab", "african", "european"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["immigrants", "natives"], ["refugees", "citizens"], ["old", "young"], ["deaf", "blind", "disabled"],
    ["american", "mexican", "chinese", "russian", "french", "german", "indian", "turkish"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"], ["frauen", "männer"], ["muslime", "christen", "juden"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"],
]
EXCHANGE = {a: line[(i + 1) % len(line)] for line in GROUPS for i, a in enumerate(line)}


def tokens(text: str) -> set[str]:
    return set(TOKEN.findall(text.lower()))


def features(found: set[str]) -> set[str]:
    """Words as they are and, with a hyphen, their beginnings."""
    out = set(found)
    for n in BEGINNINGS:
        out.update([w[:n] + "-" for w in found if len(w) > n])
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Ids whose crc32, as text, leaves 1 when divided by 3 never take part in a fit."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def telling(sample: DataFrame, vocabulary: int = VOCABULARY) -> list[str]:
    """The features of ``sample`` (text, toxic) that tell the two kinds apart best."""

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[toxic].update(features(tokens(text)))
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield rows(seen)
                seen = {0: Counter(), 1: Counter()}
        yield rows(seen)

    def rows(seen):
        both = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([seen[k][f] for f in both], pa.int64()) for k in (0, 1))],
                                          ["feature", "clean", "toxic"])

    n0, n1 = (F.lit(float(n)) for n in sample.agg(F.sum(1 - F.col("toxic")), F.sum("toxic")).first())
    counts = sample.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    both = F.col("clean") + F.col("toxic")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n = n0 + n1
    ratio = (part(F.col("toxic"), both * n1 / n) + part(F.col("clean"), both * n0 / n)
             + part(n1 - F.col("toxic"), (n - both) * n1 / n) + part(n0 - F.col("clean"), (n - both) * n0 / n))
    best = counts.where(both >= LEAST_TEXTS).orderBy(F.desc(ratio), "feature").limit(vocabulary)
    return [r.feature for r in best.select("feature").collect()]


def numbers(found: set[str], place: dict[str, int]) -> list[int]:
    return sorted(place[f] for f in features(found) if f in place)


def encoded(sample: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per row: label, feature numbers, and those of the version that names other groups (null if it names none)."""
    place = {f: i for i, f in enumerate(vocabulary)}
    many = pa.list_(pa.int32())

    def encode(batches):
        for b in batches:
            own, other = [], []
            for text in b.column(0).to_pylist():
                found = tokens(text)
                named = found & EXCHANGE.keys()
                own.append(numbers(found, place))
                other.append(numbers(found - named | {EXCHANGE[w] for w in named}, place) if named else None)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(own, many), pa.array(other, many)], ["toxic", "own", "other"])

    return sample.mapInArrow(encode, "toxic int, own array<int>, other array<int>")


class Rows:
    """A sparse 0/1 matrix."""

    def __init__(self, rows: list, width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if rows else np.empty(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)


def fit(toxic: np.ndarray, own: list, other: list, width: int) -> tuple[np.ndarray, float]:
    """Weights and base of the logistic model, by gradient steps with running scales."""
    x = Rows(own, width)
    at = [i for i, o in enumerate(other) if o is not None]
    x0, x1 = Rows([own[i] for i in at], width), Rows([other[i] for i in at], width)
    rate = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3))
    w = np.zeros(width + 1)
    w[-1] = np.log(rate / (1 - rate))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        err = (1 / (1 + np.exp(-(x.dot(w[:-1]) + w[-1]))) - toxic) / len(toxic)
        g = np.append(x.back(err) + RIDGE * w[:-1], err.sum())
        if at:
            gap = 2 * SWAP_PENALTY * (x0.dot(w[:-1]) - x1.dot(w[:-1])) / len(toxic)
            g[:-1] += x0.back(gap) - x1.back(gap)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (1 - t / (STEPS + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """Feature weights and base from labelled texts (``labels``: id, ``toxic``)."""
    ship_package(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = materialize(known.orderBy(F.xxhash64("_id"), "_id").limit(sample), "toxic-ids")
    texts = docs.select(F.col(id_col).alias("_id"), body(text_col).alias("_t")).where(F.col("_id").isNotNull())
    rows = materialize(join_small(texts, known, "_id").select("_t", "toxic"), "toxic-sample")
    kinds = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if set(kinds) != {0, 1}:
        rate = np.clip(kinds.get(1, 0) / max(1, sum(kinds.values())), 1e-6, 1 - 1e-6)
        return {}, float(np.log(rate / (1 - rate)))
    vocabulary = telling(rows)
    held = encoded(rows, vocabulary).toPandas()  # at most ``sample`` rows of feature numbers
    weights, base = fit(held.toxic.to_numpy(float), list(held.own), [o if isinstance(o, np.ndarray) else None for o in held.other], len(vocabulary))
    return dict(zip(vocabulary, weights.tolist(), strict=True)), base


def toxicity_scores(docs: DataFrame, model: tuple[dict[str, float], float], text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` in 0..1 and ``predicted``, 1 from ``threshold`` on."""
    ship_package(docs.sparkSession)
    weights, base = model
    whole = {f: w for f, w in weights.items() if not f.endswith("-")}
    begun = [(n, {f[:-1]: w for f, w in weights.items() if f.endswith("-") and len(f) == n + 1}) for n in BEGINNINGS]

    def value(text: str) -> float:
        found = tokens(text)
        z = base + sum(whole[w] for w in found & whole.keys())
        for n, table in begun:
            if table:
                z += sum(table[w] for w in {w[:n] for w in found if len(w) > n} & table.keys())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(value)

    out = docs.withColumn("score", score(body(text_col)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
