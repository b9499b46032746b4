"""Mixing by soft membership: document rates whose expected token totals by domain match target weights.

A naive Bayes classifier over hashed words, fitted on a bounded sample of labelled rows, gives each document its
probabilities of the domains (softened, so that a long text does not turn them into zeros and ones). The rates are then
the nonnegative solution of a least-squares problem: the sum over documents of rate x tokens x probability should be the
target of each domain, with a slight pull (``RIDGE``) towards rate one that settles which of many solutions it is. Gradients
lie in the span of the probabilities, so all rates are ``max(least, 1 - p . s)`` with one number ``s`` per domain, the sum of the
steps taken. A step is scaled by the curvature of the documents that are not at the bound, a matrix of domains by domains,
and halved until it brings the totals nearer; it needs a few sums over a table of a few numbers per document. Steps
end when the projected gradient is nothing; ``Rates.error`` is how far the totals then are from the targets.

Null and empty texts have no tokens, the domains' shares in the sample as probabilities, and the rate those give; texts of
any length are read whole. Rows with a null domain are not fitted. A domain outside the targets is no domain. Without labelled
rows all domains are equally likely. Repeated rows are documents of their own. An empty table gives an empty one. Columns
called ``rate`` or ``copy`` are replaced in a mixture; all others may have any name and stay as they are.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import body, join_small, materialize, words

BINS, SAMPLE = 1024, 20_000  # hashed words; labelled rows that are fitted
WEIGHT = 12.0  # a text counts as so many words, however long
STEPS, TOLERANCE, RIDGE = 100, 1e-6, 1e-4


def binned(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: (F.pmod(F.xxhash64(w), F.lit(BINS)) + 1).cast("int"))


class Membership:
    """Log shares of hashed words in each domain, and of the domains."""

    def __init__(self, domains: list[str], prior: list[float], table: list[list[float]]):
        self.domains, self.prior, self.table = domains, prior, table

    @classmethod
    def fit(cls, docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text",
            domain_col: str = "lang", sample: int = SAMPLE) -> Membership:
        """``labelled`` has the ids of rows whose ``domain_col`` may be trusted; ``sample`` of them are fitted."""
        ids = labelled.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
        ids = materialize(ids.orderBy(F.xxhash64("_id"), "_id").limit(sample), "mix-ids")
        src = docs.select(F.col(id_col).alias("_id"), F.col(domain_col).alias("_k"), body(text_col).alias("_t"))
        src = join_small(src.where(F.col("_k").isin(domains)), ids, "_id").select("_k", words(F.col("_t")).alias("_w"))
        counts = src.select("_k", F.explode(F.concat(F.array(F.lit(0)), binned(F.col("_w")))).alias("bin")).groupBy("_k", "bin").count()
        table = [[0.0] * (BINS + 1) for _ in domains]  # bin 0 counts documents
        for r in counts.collect():  # at most domains x (BINS + 1) rows
            table[domains.index(r._k)][r.bin] = float(r["count"])
        n = sum(t[0] for t in table)
        prior = [math.log((t[0] + 1) / (n + len(domains))) for t in table]
        return cls(domains, prior, [[math.log((c + 0.5) / (sum(t[1:]) + 0.5 * BINS)) for c in t[1:]] for t in table])

    def add_to(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with ``n_tokens`` and a probability ``p_<i>`` for the i-th domain."""
        own = docs.columns
        out = docs.withColumn("_w", words(body(text_col)))
        out = out.select(*own, F.size("_w").cast("long").alias("n_tokens"), binned(F.col("_w")).alias("_b"))

        def total(row: list[float]) -> Column:
            shares = F.split(F.lit(",".join(f"{v:.6f}" for v in row)), ",").cast("array<double>")  # folded when planned
            return F.aggregate("_b", F.lit(0.0), lambda s, b: s + F.element_at(shares, b))

        scale = F.least(F.lit(1.0), WEIGHT / F.greatest(F.size("_b"), F.lit(1)))
        out = out.withColumns({f"_s{i}": F.lit(p) + scale * total(row) for i, (p, row) in enumerate(zip(self.prior, self.table, strict=True))})
        top = F.greatest(*(F.col(f"_s{i}") for i in range(len(self.domains)))) if len(self.domains) > 1 else F.col("_s0")
        out = out.withColumn("_top", top)
        out = out.withColumns({f"_e{i}": F.exp(F.col(f"_s{i}") - F.col("_top")) for i in range(len(self.domains))})
        norm = reduce(add, (F.col(f"_e{i}") for i in range(len(self.domains))))
        return out.select(*own, "n_tokens", *((F.col(f"_e{i}") / norm).alias(f"p_{i}") for i in range(len(self.domains))))


class Rates:
    """The sum of the steps taken; a document's rate is what it makes of its probabilities."""

    def __init__(self, steps: list[float], least: float, totals: list[float], target: list[float], slope: float = 0.0):
        self.steps, self.least, self.totals, self.target, self.slope = steps, least, totals, target, slope

    @property
    def error(self) -> float:
        """The largest difference of a domain's tokens from its target, as a share of all tokens wanted."""
        return max((abs(a - b) for a, b in zip(self.totals, self.target, strict=True)), default=0.0) / max(sum(self.target), 1.0)

    def column(self) -> Column:
        moved = reduce(add, (F.col(f"p_{i}") * v for i, v in enumerate(self.steps)), F.lit(0.0))
        return F.greatest(F.lit(self.least), F.lit(max(1.0, self.least)) - moved)

    @classmethod
    def fit(cls, members: DataFrame, weights: list[float], least: float = 0.0, tokens: float | None = None) -> Rates:
        """``members`` (n_tokens, p_0..): a written table, read once a step. ``tokens``: the wanted total; by default the
        smallest at which no domain has to be cut, so scarce domains are repeated and none is thinned."""
        k = len(weights)
        share = np.array(weights) / sum(weights)
        n = F.col("n_tokens").cast("double")

        def sums(rates: Rates) -> tuple[np.ndarray, np.ndarray]:
            """Totals by domain, and the curvature of the documents whose rate is above ``least``."""
            r = rates.column()
            free = F.when(r > rates.least, n).otherwise(0.0)
            row = members.agg(*(F.sum(n * F.col(f"p_{i}") * r).alias(f"t{i}") for i in range(k)),
                              *(F.sum(free * F.col(f"p_{i}") * F.col(f"p_{j}")).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k))).first()
            return (np.array([row[f"t{i}"] or 0.0 for i in range(k)]),
                    np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]))

        start, curve = sums(cls([0.0] * k, -1.0, [], []))
        if not start.sum():
            return cls([0.0] * k, least, start.tolist(), start.tolist())
        tokens = float(np.max(start / share)) if tokens is None else tokens
        target = tokens * share
        # Each domain's error is weighed by its own curvature, which makes the problem well-conditioned.
        weigh = np.maximum(np.diag(curve), 1e-9)
        at = np.zeros(k)
        totals, curve = sums(cls(at.tolist(), least, [], []))

        def off(at: np.ndarray, totals: np.ndarray) -> np.ndarray:
            """What is left of the gradient, in tokens."""
            return totals - target - RIDGE * at * weigh

        for _ in range(STEPS):
            left = off(at, totals)
            if np.abs(left).max() <= TOLERANCE * tokens:
                break
            step, size = np.linalg.solve(curve + 1.00001 * RIDGE * np.diag(weigh), left), 1.0
            while True:
                then, curve_then = sums(cls((at + size * step).tolist(), least, [], []))
                now = off(at + size * step, then)
                if size < 1e-3 or now @ (now / weigh) < (1 - 1e-4 * size) * (left @ (left / weigh)):
                    break
                size /= 2
            at, totals, curve = at + size * step, then, curve_then
        return cls(at.tolist(), least, totals.tolist(), target.tolist(), float(np.abs(off(at, totals)).max() / tokens))


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
                 domain_col: str = "lang", least: float = 0.0) -> tuple[DataFrame, Membership, Rates]:
    """Per row: id, ``n_tokens``, ``p_<i>`` by domain and ``rate``; and the fitted classifier and rates."""
    member = Membership.fit(docs, labelled, list(targets), id_col, text_col, domain_col)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    table = materialize(member.add_to(src, "_text").drop("_text"), "mix-members")
    rates = Rates.fit(table, list(targets.values()), least)
    return table.withColumn("rate", rates.column()).withColumnRenamed("_id", id_col), member, rates


def copies(rate: Column, *key: Column) -> Column:
    """A whole number with mean ``rate``: what is over a whole decides by a hash of the key."""
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(rate + u).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
          domain_col: str = "lang", least: float = 1.0) -> DataFrame:
    """``docs`` with each row repeated by its rate: ``rate`` and ``copy`` (from 0) are added."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("rate", "copy")])
    _, member, rates = mixing_rates(docs, labelled, targets, id_col, text_col, domain_col, least)
    whole = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = member.add_to(whole, "_text").withColumn("rate", rates.column())
    n = copies(F.col("rate"), F.col("_id"), F.col("_text"))
    out = out.withColumn("copy", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    return out.select("_row.*", "rate", "copy")
