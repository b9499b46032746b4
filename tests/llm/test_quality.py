"""Perplexity, thresholds and acceptance against a brute-force word model."""

import collections
import functools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from firmament.llm import common
from firmament.llm import kneser_ney as kn


def brute_tokens(text):
    out = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[!-/:-@\[-`{-~]+", text)
    return [re.sub("[0-9]", "0", t) for t in out]


def brute_discounts(counts):
    n = collections.Counter(min(c, 5) for c in counts)
    out = [0.0]
    for k in (1, 2, 3):
        raw = k - (k + 1) * n[1] / (n[1] + 2 * n[2]) * n[k + 1] / n[k] if n[k] and n[1] + n[2] else -1
        out.append(raw if 0.01 <= raw <= k else 0.5 * k)
    return out


class Brute:
    """Interpolated modified Kneser-Ney over pairs of tokens, straight from the formulas."""

    def __init__(self, texts, number):
        self.number = number
        self.pairs = collections.Counter(p for t in texts for p in self.split(t))
        self.cut = brute_discounts(self.pairs.values())
        self.before = collections.Counter(w for _, w in self.pairs)
        self.low = brute_discounts(self.before.values())
        self.total, self.spare = collections.Counter(), collections.Counter()
        for (c, _), n in self.pairs.items():
            self.total[c] += n
            self.spare[c] += self.cut[min(n, 3)]
        self.mean = sum(n * self.logp(p, 0) for p, n in self.pairs.items()) / sum(self.pairs.values())

    def split(self, text):
        s = [0, *map(self.number, brute_tokens(text)), 0]
        return list(zip(s, s[1:]))

    def logp(self, pair, own):
        c, w = pair
        k, total = self.before[w], sum(self.before.values())
        base = (k - self.low[min(k, 3)]) / total if k else 0.0
        base += sum(self.low[min(n, 3)] for n in self.before.values()) / total / kn.VOCABULARY
        back = self.spare[c] / self.total[c] if self.total[c] else 1.0
        n = self.pairs[pair] - own
        return math.log((max(n - self.cut[min(n, 3)], 0) / self.total[c] if n else 0) + back * base)

    def perplexity(self, text, own):
        pairs = self.split(text)
        mine = collections.Counter(pairs) if own else {}
        s = sum(self.logp(p, mine.get(p, 0)) for p in pairs)
        return math.exp(-(s + kn.PSEUDO * self.mean) / (len(pairs) + kn.PSEUDO))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["the", "The", "of", "wait...", "12", "95", "süß", "end.", "(x)", "—", "a-b"]
    texts = [(i, " ".join(rng.choices(words, range(11, 0, -1), k=rng.randrange(1, 60))), "en" if i % 3 else "de") for i in range(60)]
    odd = [(60, "the the the the", "en"), (61, "%%% ### zz qq", "xx"), (62, None, None), (63, "", "en"), (64, " \n", "de"), (65, "the " * 30_000, "en"),
           (None, "no id", None), (3, texts[3][1], "de"), (66, "never. Seen, words", None)]
    return texts + odd


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, lang string, id int, digest string, perplexity double")


@pytest.mark.parametrize("known", [kn.KNOWN, 4])
def test_scores_equal_a_brute_force_model(spark, frame, rows, known, monkeypatch):
    trusted = [r for r in rows if r[0] is not None and r[0] < 40]
    counts = collections.Counter(t for r in trusted for t in brute_tokens(r[1]))
    hashes = {t: int(kn.token_lists([t])[0][0]) for r in rows for t in brute_tokens(r[1] or "")}
    monkeypatch.setattr(kn.known_tokens, "__defaults__", (known,))
    top = sorted(sorted(counts, key=lambda t: (-counts[t], np.uint64(hashes[t]).astype(np.int64)))[:known], key=hashes.get)
    number = {t: 1 + i for i, t in enumerate(top)}
    brute = Brute([r[1] for r in trusted], lambda t: number.get(t, 1 + kn.KNOWN + hashes[t] % kn.OTHERS))
    ids = spark.createDataFrame([(i,) for i in [*range(40), None, 5]], "doc_id long")
    want = {r[:2]: brute.perplexity(r[1], r[0] is not None and r[0] < 40) if r[1] else None for r in rows}
    got = kn.judged(frame, ids)
    assert got.columns == ["doc_id", "text", "lang", "id", "digest", "perplexity", "threshold", "accepted"] and got.count() == len(rows)
    own = collections.defaultdict(list)
    for r in trusted:
        own[r[2]].append(want[r[:2]])
        own["all"].append(want[r[:2]])
    limit = {k: sorted(v)[math.ceil(kn.QUANTILE * len(v)) - 1] * kn.MARGIN for k, v in own.items()}
    for r in got.collect():
        p = want[r.doc_id, r.text]
        if p is None:
            assert r.perplexity is None and not r.accepted
            continue
        t = limit.get(r.lang, limit["all"])
        assert math.isclose(r.perplexity, p, rel_tol=1e-9) and math.isclose(r.threshold, t, rel_tol=1e-9) and r.accepted == (r.perplexity <= r.threshold)
    thin = kn.quality_scores(frame, ids)
    assert sorted((str(r.doc_id), r.accepted) for r in thin.collect()) == sorted((str(r.doc_id), r.accepted) for r in got.collect())


def test_probabilities_of_a_context_sum_to_one(spark, frame):
    known, parts, model, _ = kn.fit(frame.where("doc_id < 40"), 4)
    grams = np.concatenate([kn.unpacked(r.grams, True) for r in parts.collect()])
    counts = np.concatenate([kn.unpacked(r.counts) for r in parts.collect()])
    every = np.arange(kn.VOCABULARY, dtype=np.uint32)
    for c in sorted(set((grams >> 16).tolist()))[:6]:
        n = np.zeros(kn.VOCABULARY, np.int64)
        n[grams[grams >> 16 == c] & 0xFFFF] = counts[grams >> 16 == c]
        p = np.exp(model.gain(every | np.uint32(c << 16), n) + model.back[c] + model.single)
        assert math.isclose(p.sum(), 1, rel_tol=1e-9)


def test_arrays_survive_packing():
    x = np.array([0, 5, 5, 70_000, 2 ** 32 - 1], dtype=np.uint32)
    assert kn.unpacked(kn.packed(x)).tolist() == kn.unpacked(kn.packed(x, True), True).tolist() == x.tolist()
    assert not len(kn.unpacked(kn.packed(x[:0])))
    where, first = np.array([0, 0, 4095, 7, 7, 9, 3, 0]), np.array([0, 3, 6, 7])
    of, place = kn.unpacked_runs(kn.packed_runs(where, first))
    assert place.tolist() == where.tolist() and of.tolist() == [0, 0, 0, 1, 1, 1, 2, 3]
    parts = np.array([0.1, -3e-200, 7.0])
    assert kn.unpacked(kn.packed(parts.view(np.uint64), kind=np.uint64), kind=np.uint64).view(float).tolist() == parts.tolist()


def test_rows_without_anything_to_judge_by(spark, frame):
    ids = spark.createDataFrame([(1,)], "doc_id long")
    none = kn.judged(frame, ids.where("false"))
    assert none.where("accepted").count() == frame.where("length(text) > 0").count() and none.where("perplexity is not null").isEmpty()
    assert kn.judged(frame.where("false"), ids).isEmpty() and kn.quality_scores(frame.where("false"), ids).isEmpty()
    assert kn.judged(frame.where("doc_id in (62, 63)"), ids).where(F.col("accepted") | F.col("perplexity").isNotNull()).isEmpty()


def test_merged_shards_give_the_same_scores(spark, frame, monkeypatch):
    """However many shards the counts have, a text is answered for by a bounded number of them."""
    rows = frame.where("length(text) > 0").select(F.col("doc_id").alias("id"), F.col("text").alias("t"), F.coalesce(F.col("doc_id") < 40, F.lit(False)).alias("own"))
    rows = common.materialize(rows.repartition(5), "rows")
    trained = kn.fit(rows.where("own"), 14, "t")
    plain, merged = ({(r.id, round(r.perplexity, 9)) for r in kn.scored(rows, trained, 14, most=most).collect()} for most in (64, 4))
    assert plain == merged and len(plain) > 60
    for shards in (1, 4, 28, 64, 65, 1700, 20_000):
        blocks, each = kn.layout(shards)
        assert each <= kn.MOST_SHARDS and shards <= blocks * each < shards + blocks
        assert shards > kn.MOST_SHARDS or (blocks, each) == (1, shards)


def test_accepted_rows_are_those_that_are_judged_so(spark, frame):
    """Also where an id has both verdicts, rows without an id and equal rows."""
    more = [(i, t, lang, 1, "x", 2.0) for i, t, lang in [
        (None, "%%% ### zz qq", "xx"), (None, None, None), (3, "", "de"), (5, "%%% ### zz qq", "xx"), (61, "%%% ### zz qq", "xx"), (70, None, "en"), (70, "the of", None)]]
    both = common.materialize(frame.unionByName(spark.createDataFrame(more, frame.schema)), "both")
    ids = spark.createDataFrame([(i,) for i in [*range(40), None]], "doc_id long")
    for trusted in (ids, ids.where("false")):
        want = kn.judged(both, trusted).where("accepted").select("doc_id", "text", "lang")
        got = kn.keep_accepted(both, trusted)
        assert got.columns == both.columns and {r.perplexity for r in got.collect()} == {2.0}
        got, want = (collections.Counter(map(tuple, df.select("doc_id", "text", "lang").collect())) for df in (got, want))
        assert got == want and (3, "", "de") not in got and sum(got.values()) < both.count()
    assert kn.keep_accepted(both.where("false"), ids).isEmpty()


def test_texts_are_not_shuffled_for_many_verdicts(spark, tmp_path, monkeypatch):
    """The quality stage sends the few rejected ids to the texts, however many verdicts there are."""
    texts = [(i, " ".join(f"word{(i + j) % 9}" for j in range(30)) if i % 50 else "", "en") for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(kn, "join_measured", functools.partial(common.join_measured, most=4096))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        good = corpus_pipeline.quality(spark, docs, str(tmp_path))
        plan = good._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert {r.doc_id for r in good.collect()} == {i for i in range(600) if i % 50}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
