"""Benchmark passages in documents, by winnowed fingerprints that are then checked and extended.

The smallest hash of every ``GUARD`` neighbouring runs of ``RUN`` words is a fingerprint, on both sides. Two texts that
share ``RUN + GUARD - 1`` words in a row, which is the length of a window, share a fingerprint, so the join misses
nothing. Texts met by an item are looked at again: every place of a met fingerprint is extended to the windows around it,
and those are compared word by word.

Items with fewer words than a window are windows of their own length, found by the hash of all runs of that length. Null
and empty texts have no words and no hits; items without words never occur. Equal texts are examined once. Items without
an id are found but not listed; repeated items count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import body, free_name, join_measured, join_small, materialize, words

WINDOW, RUN = 10, 5
GUARD = WINDOW - RUN + 1


def runs(w: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n))))


def winnow(g: Column) -> Column:
    """The smallest of each ``GUARD`` neighbours."""
    least = F.transform(F.sequence(F.lit(1), F.size(g) - (GUARD - 1)), lambda i: F.array_min(F.slice(g, i, GUARD)))
    return F.when(F.size(g) >= GUARD, F.array_distinct(least))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``items`` (ids met, sorted as text)."""
    bench = items.select(F.col(item_id).cast("string").alias("item"), words(body(item_text)).alias("iw")).where(F.size("iw") > 0).distinct()
    bench = bench.withColumn("key", F.xxhash64("item", "iw"))
    short = F.size("iw") < WINDOW
    bench = bench.withColumn("g", F.when(short, F.array(F.xxhash64("iw"))).otherwise(runs(F.col("iw"), RUN)))
    bench = bench.withColumn("fps", F.when(short, F.col("g")).otherwise(winnow(F.col("g"))))
    bench = materialize(bench.select("key", "item", "iw", "fps"), "bench")
    lengths = [r.n for r in bench.where(short).select(F.size("iw").alias("n")).distinct().collect()]  # nine at most

    src = docs.select(F.col(id_col).alias("_id"), body(text_col).alias("t"))
    src = src.select("_id", "t", F.md5("t").alias("digest"))
    tokens = src.select("digest", words(F.col("t")).alias("w"))
    grams = tokens.select("digest", runs(F.col("w"), RUN).alias("g"), *(runs(F.col("w"), n).alias(f"g{n}") for n in lengths))
    none = F.array().cast("array<bigint>")
    prints = reduce(F.concat, [F.coalesce(winnow(F.col("g")), none), *(F.coalesce(F.col(f"g{n}"), none) for n in lengths)])
    seeds = grams.select("digest", F.explode(prints).alias("fp"))
    marks = materialize(bench.select("key", F.explode("fps").alias("fp")), "bench-prints")
    met = join_small(seeds, marks, "fp").groupBy("digest", "key").agg(F.collect_set("fp").alias("met"))
    met = materialize(met, "bench-met")

    texts = materialize(met.select("digest").distinct(), "bench-texts")
    full = join_small(src, texts, "digest").select("digest", "t").groupBy("digest").agg(F.first("t").alias("t"))
    full = materialize(full.select("digest", words(F.col("t")).alias("w")), "bench-words")
    pair = met.join(full, "digest").join(bench.select("key", "item", "iw"), "key")
    size = F.least(F.size("iw"), F.lit(WINDOW))
    pair = pair.select("digest", "item", "w", "met", size.alias("n"), F.transform(
        F.sequence(F.lit(1), F.size("iw") - size + 1), lambda s: F.array_join(F.slice("iw", s, size), " ")).alias("windows"))
    # Where a met fingerprint stands, every window that covers its run may be shared.
    last = F.size("w") - F.col("n") + 1
    run = F.least(F.col("n"), F.lit(RUN))
    run = F.when(F.col("n") < WINDOW, F.col("n")).otherwise(run)
    pair = pair.withColumn("run", run).where(last >= 1)
    at = F.filter(F.sequence(F.lit(1), F.size("w") - F.col("run") + 1),
                  lambda i: F.array_contains(F.col("met"), F.xxhash64(F.slice(F.col("w"), i, F.col("run")))))
    pair = pair.withColumn("at", at).where(F.size("at") > 0)
    around = F.flatten(F.transform("at", lambda p: F.sequence(F.greatest(F.lit(1), p - (F.col("n") - F.col("run"))), F.least(p, F.size("w") - F.col("n") + 1))))
    pair = pair.where(F.size("w") >= F.col("n")).withColumn("around", F.array_distinct(F.filter(around, lambda s: s <= F.size("w") - F.col("n") + 1)))
    hits = F.filter("around", lambda s: F.array_contains(F.col("windows"), F.array_join(F.slice(F.col("w"), s, F.col("n")), " ")))
    pair = pair.select("digest", "item", "n", hits.alias("hits")).where(F.size("hits") > 0)
    spans = pair.select("digest", "item", F.transform("hits", lambda s: F.struct(s.alias("a"), (s + F.col("n")).alias("b"))).alias("spans"))
    by_text = spans.groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                                          F.array_sort(F.collect_set("item")).alias("items"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", start, lambda s, x: F.struct(
        F.greatest(s.end, x.b).alias("end"), (s.n + F.greatest(F.lit(0), x.b - F.greatest(s.end, x.a))).alias("n")))
    by_text = materialize(by_text.select("digest", covered.n.cast("long").alias("n_hit"), "items"), "bench-hits")
    counted = src.select("_id", "digest", F.size(words(F.col("t"))).cast("long").alias("n_words"))
    out = join_small(counted, by_text, "digest", "left")
    return out.select(F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a window of an item; rows are told apart by their text.

    All columns stay as they are, whatever their names.
    """
    texts = docs.select(F.md5(body(text_col)).alias("_digest"), F.col(text_col).alias("text"))
    found = contamination(texts, items, "_digest")
    digest = free_name("digest", docs)
    hit = materialize(found.where("n_hit > 0").select(F.col("_digest").alias(digest)).distinct(), "bench-drop")
    return join_measured(docs.withColumn(digest, F.md5(body(text_col))), hit, digest, "left_anti").drop(digest)
