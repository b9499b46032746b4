"""The exact join of what shares a bucket, against brute force, and how its pairs grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmament.llm import common, order_minhash


def similar(a, b):
    x, y = set(a.tolist()), set(b.tolist())
    return bool(x) and bool(y) and len(x & y) >= 0.8 * len(x | y) - 1e-9


def opened(spark, texts):
    """``unmet`` with one bucket of all texts and no classes yet."""
    src = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sizes = [(i, len(x), 7) for i, x in enumerate(order_minhash.kmer_lists(texts))]
    keyed = spark.createDataFrame(sizes, "b long, n int, key long").where("n > 0")
    none = spark.createDataFrame([], "id long, class_id long")
    return order_minhash.unmet(src, keyed, none, spark.createDataFrame([], "a long, b long"))


def boilerplate(n):
    shared = " ".join(f"common{i}" for i in range(176))
    return [f"{shared} {' '.join(f'own{k}x{i}' for i in range(40))}" for k in range(n)]


def test_every_link_within_a_bucket_is_a_candidate(spark):
    rng = np.random.default_rng(3)
    texts = ["", "one", "one", "a b c d e f g h", "a b c d e f g h i"]
    for k in range(60):
        base = rng.integers(0, 40 if k % 3 else 4000, rng.integers(5, 250))
        for _ in range(3):
            some = base.copy()
            at = rng.integers(0, len(some), rng.integers(0, 4))
            some[at] = rng.integers(0, 4000, len(at))
            texts.append(" ".join(f"w{x}" for x in some[: len(some) - rng.integers(0, 3)]))
    texts += boilerplate(30)
    got = {(r.a, r.b) for r in opened(spark, texts).collect()}
    lists = list(order_minhash.kmer_lists(texts))
    want = {(a, b) for b in range(len(texts)) for a in range(b) if similar(lists[a], lists[b])}
    assert want <= got and len(want) > 60 and len(got) < len(want) + 0.1 * len(texts) ** 2 / 2


def test_unrelated_texts_with_a_common_passage_give_few_pairs(spark):
    few, many = (opened(spark, boilerplate(n)).count() for n in (100, 400))
    assert many <= 10 * max(few, 1) and many < 400


def test_frequent_kmers_are_bounded(spark):
    lists = [np.arange(k, dtype=np.uint64) for k in (3, 5, 9, 9, 9)]
    seqs = spark.createDataFrame([(x.tobytes(),) for x in lists], "seq binary")
    kmer, c = order_minhash.frequent(seqs, 100)
    assert kmer.tolist() == list(range(9)) and c.tolist() == [5, 5, 5, 4, 4, 3, 3, 3, 3]
    kmer, c = order_minhash.frequent(seqs, 5)
    assert kmer.tolist() == [0, 1, 2, 3, 4] and c.min() >= 4
    assert not len(order_minhash.frequent(seqs.where("false"))[0])


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_no_link_is_lost(spark, sf):
    """Classes over a whole table against all pairs of its texts."""
    docs = common.table(spark, f"/root/testdata/{sf}", "documents")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    seqs = dict(zip([i for i, _ in rows], order_minhash.kmer_lists([t for _, t in rows]), strict=True))
    held: dict = {}
    for i, x in seqs.items():
        for k in x.tolist():
            held.setdefault(k, set()).add(i)
    missed = 0
    for i, x in seqs.items():
        near = {j for k in x.tolist() for j in held[k] if j < i}
        missed += sum(similar(x, seqs[j]) and order_minhash.aligned(x, seqs[j]) >= 0.8 and got[i] != got[j] for j in near)
    texts: dict = {}
    for i, t in rows:
        texts.setdefault(t, set()).add(got[i])
    assert missed == 0 and all(len(c) == 1 for c in texts.values())


def test_one_row_of_each_class_stays_whatever_the_other_columns(spark, docs):
    clash = docs.withColumns({"_digest": F.lit("mine"), "class_id": F.lit(5), "copy_of": F.lit("c"), "n": F.lit(1), "t": F.lit("t"),
                              "count": F.lit(2), "omh": F.lit(0)})
    kept = order_minhash.keep_one(clash)
    assert kept.columns == clash.columns and {r._digest for r in kept.collect()} == {"mine"}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 6, 8, 9, 10, None, 11, 12]))
    twin = docs.withColumnRenamed("digest", "_digest").union(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    assert order_minhash.keep_one(twin).count() == kept.count() and order_minhash.keep_one(twin.where("false")).isEmpty()
