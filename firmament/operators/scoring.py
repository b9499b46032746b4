"""Extractor predictions against hand labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.operators.mentions import find_mentions, pair_mentions, typed_headlines
from firmament.session import materialize


def parse_labels(labels: DataFrame) -> DataFrame:
    """``none`` or ``type: A-B`` to ``has_relation`` and ``true_type``."""
    label = F.trim(F.col("label"))
    has = F.lower(label) != "none"
    return labels.withColumn("label", label).withColumn("has_relation", has).withColumn(
        "true_type", F.when(has, F.split(label, ":")[0]))


def rules_prediction(headlines: DataFrame, names: DataFrame) -> DataFrame:
    """``(article_id, relation)`` where the rules emit at least one pair."""
    typed = materialize(typed_headlines(headlines), "typed")
    paired = pair_mentions(find_mentions(typed.select("article_id", "title"), names)).where(F.size("pairs") > 0)
    paired = materialize(paired.select("article_id"), "paired")
    return typed.join(paired, "article_id", "left_semi").select("article_id", "relation")


def last_relation(edges: DataFrame, order: str) -> DataFrame:
    """One relation per headline; a repeated headline keeps its last."""
    return edges.groupBy("headline").agg(F.max_by("relation", order).alias("relation"))


def score(predictions: DataFrame) -> DataFrame:
    """Detection and type scores per extractor and panel, and over all panels.

    ``predictions`` has ``(extractor, panel, has_relation, true_type,
    predicted)``, one row per labelled headline.
    """
    truth, found = F.col("has_relation"), F.col("predicted").isNotNull()
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.col("precision"), F.col("recall")
    return (
        predictions.groupingSets([["extractor", "panel"], ["extractor"]], "extractor", "panel").agg(
            F.grouping("panel").alias("_all"),
            F.count_if(found).alias("found"), F.count_if(truth & found).alias("tp"),
            F.count_if(~truth & found).alias("fp"), F.count_if(truth & ~found).alias("fn"),
            F.count_if(truth & found & (F.col("true_type") == F.col("predicted"))).alias("type_ok"))
        .withColumn("panel", F.when(F.col("_all") == 1, "all").otherwise(F.col("panel"))).drop("_all")
        .withColumn("precision", F.try_divide(tp, tp + fp))
        .withColumn("recall", F.try_divide(tp, tp + fn))
        .withColumn("f1", F.when((tp > 0) & (p + r > 0), 2 * p * r / (p + r)).otherwise(0.0))
        .withColumn("type_correct", F.when(tp > 0, F.concat_ws("/", "type_ok", "tp")).otherwise("-"))
    )


def disagreements(rules: DataFrame, model: DataFrame, on: str = "article_id") -> DataFrame:
    """Headlines exactly one of the two extractors found something in."""
    a = rules.select(on, F.col("relation").alias("rules"))
    b = model.select(on, F.col("relation").alias("model"))
    return a.join(b, on, "full_outer").where(F.col("rules").isNull() != F.col("model").isNull())
