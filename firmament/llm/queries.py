"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament.llm import (
    fill_middle, filter_audit, kneser_ney, license_join, lz_fingerprint, mixing, order_minhash, pii, token_counts, toxicity,
    url_templates, warc_zip, winnowing,
)
from firmament.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DOMAIN_WEIGHTS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed package of public vocabularies keeps a file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, member, _ = mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), DOMAIN_WEIGHTS)
    named = [F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(member.domains)]
    return out.select("doc_id", "n_tokens", *named, "rate")


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_zip.archive_round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.plain)

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s.plain & (s.kind == kind))).cast("long").alias(f"n_{kind}")

    counts = map(number, pii.KINDS)
    return found.select("doc_id", *counts, F.sha2(pii.spelled_out(base), 256).alias("base_sha256"), pii.spelled_out(F.col("spans")).alias("spans"))


def op6_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.lz_fingerprints(table(spark, sf_dir, "documents"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity_scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op9_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame([(i, *t) for i, t in enumerate(license_join.TEMPLATES)], "tid int, label string, template string")
    return license_join.license_scan(table(spark, sf_dir, "documents"), templates)


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality_scores(table(spark, sf_dir, "documents"), trusted(table(spark, sf_dir, "labels")))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(back, 256).alias("restored_sha256"))


def op12_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_warc_zip, op3_token_counts, op4_order_minhash, op5_personal_data, op6_lz_fingerprint,
                                   op7_winnowing, op8_toxicity, op9_license_join, op10_kneser_ney, op11_fill_middle, op12_url_templates,
                                   op13_filter_audit)}
