"""Company names back to universe firms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.functions.text import boundary_spans, clean_mention, piece_counts
from firmament.operators.mentions import long_names
from firmament.session import materialize


def resolve_names(written: DataFrame, names: DataFrame) -> DataFrame:
    """``(name, firm)`` for the distinct names of ``written``; NULL outside the universe.

    The shorter of text and dictionary entry must stand as whole words inside
    the longer. Both directions are equality joins on word-bounded spans: of the
    text where it is the longer, of the entry where that is. The longest shorter
    side wins, then the first entry.
    """
    entries = long_names(names)
    distinct = written.select("name").distinct().withColumn("text", clean_mention(F.col("name")))
    texts = distinct.where(F.col("text") != "")
    inside_text = (
        boundary_spans(texts.select("name", "text"), "text", piece_counts(entries))
        .select("name", F.col("span").alias("entry"))
        .join(entries.withColumnRenamed("name", "entry"), "entry")
        .select("name", F.length("entry").alias("score"), "ord", "firm")
    )
    entry_spans = (
        boundary_spans(entries.select("firm", "ord", "name"), "name", piece_counts(texts, "text"))
        .where(F.length("span") < F.length("name"))
        .select(F.col("span").alias("text"), "firm", "ord").distinct()
    )
    inside_entry = texts.join(entry_spans, "text").select("name", F.length("text").alias("score"), "ord", "firm")
    best = (
        inside_text.unionByName(inside_entry)
        .groupBy("name").agg(F.min_by("firm", F.struct(-F.col("score"), "ord")).alias("firm"))
    )
    return distinct.join(best, "name", "left").select("name", "firm")


def resolve_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``ticker_a``, ``ticker_b`` and how many of them are in the universe."""
    written = edges.select(F.explode(F.array("firm_a", "firm_b")).alias("name")).where(F.col("name").isNotNull())
    found = materialize(resolve_names(materialize(written.distinct(), "names-written"), names), "names-resolved")
    a = found.select(F.col("name").alias("firm_a"), F.col("firm").alias("ticker_a"))
    b = found.select(F.col("name").alias("firm_b"), F.col("firm").alias("ticker_b"))
    return edges.join(a, "firm_a", "left").join(b, "firm_b", "left").withColumn(
        "n_universe", F.col("ticker_a").isNotNull().cast("int") + F.col("ticker_b").isNotNull().cast("int"))


def universe_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    return resolve_edges(edges, names).where(F.col("n_universe") == 2)
