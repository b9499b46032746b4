"""Model-based extraction behind a cache.

The extractor is any callable ``list[str] -> list[dict]`` whose entries carry
``headline_id`` and the relation fields. There is no network here, so the
default is a deterministic stand-in; a hosted model plugs in the same way.
"""

from __future__ import annotations

import re
from typing import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmament import schemas as S
from firmament.functions.text import RELATION_NEEDLES, RELATION_PATTERNS, RUMOR, cache_key
from firmament.session import materialize

BATCH_SIZE = 20

def numbered_prompt(headlines: list[str]) -> str:
    return "\n".join(f"{i}. {h}" for i, h in enumerate(headlines))


_NAME = r"([A-Z][\w&.#'-]*(?: [A-Z0-9][\w&.#'-]*)*)"
_STATED = [(relation, RELATION_NEEDLES[relation], rf"{_NAME} [^A-Z]*?(?i:{words})\w*[^A-Z]*{_NAME}") for relation, words in RELATION_PATTERNS]


def pattern_extractor(headlines: list[str]) -> list[dict]:
    """Reads '<Name> <relation words> <Name>' for capitalised names, dictionary-free.

    A pattern runs only where a text it needs occurs; letters beyond ASCII may fold to one, so such headlines skip this test.
    """
    out = []
    for i, h in enumerate(headlines):
        low = h.lower() if h.isascii() else None
        for relation, needles, pattern in _STATED:
            if low is not None and not any(n in low for n in needles):
                continue
            m = re.search(pattern, h)
            if m:
                names = [g for g in m.groups() if g and g[:1].isupper()]
                out.append({"headline_id": i, "firm_a": names[0], "firm_b": names[-1], "relation": relation,
                            "rumor": bool(re.search(RUMOR, h, re.I))})
                break
    return out


def uncached(articles: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Distinct ``(key, title)`` of headlines the cache does not hold."""
    keyed = articles.where(F.col("title").isNotNull()).select(cache_key(F.col("title")).alias("key"), "title")
    todo = keyed.groupBy("key").agg(F.min("title").alias("title"))
    return todo if cache is None else todo.join(cache.select("key").distinct(), "key", "left_anti")


def latest(cache: DataFrame) -> DataFrame:
    """One row per key: the last written."""
    return cache.groupBy("key").agg(F.max_by("relations", "seq").alias("relations"))


def attempts(todo: DataFrame, extractor: Callable[[list[str]], list[dict]] = pattern_extractor,
             batch_size: int = BATCH_SIZE, seq: int = 0) -> DataFrame:
    """A row per key of ``todo``: its relations (an empty list where nothing was found), or the error of its batch."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors, relations = [], []  # a frame goes back as one, whatever the extractor's batch
            for lo in range(0, len(pdf), batch_size):
                part = pdf.iloc[lo: lo + batch_size]
                per: dict[int, list[dict]] = {}
                error = None
                try:
                    for rel in extractor(part["title"].tolist()):
                        rel = dict(rel)
                        per.setdefault(rel.pop("headline_id"), []).append(rel)
                except Exception as exc:  # reported with its keys, which stay uncached and are tried again next run
                    error = f"{type(exc).__name__}: {exc}"
                errors += [error] * len(part)
                relations += [None if error else per.get(i, []) for i in range(len(part))]
            yield pd.DataFrame({"key": pdf["key"].to_numpy(), "seq": seq, "error": pd.Series(errors, dtype=object),
                                "relations": pd.Series(relations, dtype=object)})

    return todo.select("key", "title").mapInPandas(call, S.ATTEMPTS)


def extract(todo: DataFrame, extractor: Callable[[list[str]], list[dict]] = pattern_extractor,
            batch_size: int = BATCH_SIZE, seq: int = 0) -> DataFrame:
    """Cache rows for ``todo``; no row where a batch failed, see ``attempts`` for those."""
    return answered(attempts(todo, extractor, batch_size, seq))


def answered(tried: DataFrame) -> DataFrame:
    return tried.where("error is null").select(*S.CACHE.names)


class Cache:
    """Answers by key in a folder, in generations: reading takes the newest alone.

    Runs append to the newest generation. Once it holds ``STALE`` times as many rows as keys, the last answer of each key
    becomes the next generation, so lookups do not grow with the number of runs. Failed batches are kept beside it, with
    their error and run.
    """

    STALE = 2

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.failures = spark, path.rstrip("/"), f"{path.rstrip('/')}-failures"

    def _read(self, path: str, schema: T.StructType) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def generation(self) -> int:
        held = self._read(self.path, S.GENERATIONS)
        return 0 if held is None else held.agg(F.max("gen")).first()[0] or 0

    def read(self) -> DataFrame | None:
        held = self._read(self.path, S.GENERATIONS)
        return None if held is None else held.where(F.coalesce("gen", F.lit(0)) == self.generation()).select(*S.CACHE.names)

    def failed(self) -> DataFrame:
        """``key, error, seq`` of what failed and has no answer since."""
        log, held = self._read(self.failures, S.FAILURES), self.read()
        log = self.spark.createDataFrame([], S.FAILURES) if log is None else log
        return log if held is None else log.join(held.select("key").distinct(), "key", "left_anti")

    def add(self, tried: DataFrame) -> int:
        """Keep the answers and failures of ``attempts``; the number of keys that failed."""
        tried = materialize(tried, "attempts")
        answered(tried).withColumn("gen", F.lit(self.generation())).write.mode("append").partitionBy("gen").parquet(self.path)
        lost = tried.where("error is not null").select(*S.FAILURES.names)
        n = lost.count()
        if n:
            lost.write.mode("append").parquet(self.failures)
        self.compact()
        return n

    def compact(self) -> None:
        held = self.read()
        rows, keys = held.agg(F.count("*"), F.count_distinct("key")).first()
        if rows > self.STALE * keys:
            last = held.groupBy("key").agg(F.max_by("relations", "seq").alias("relations"), F.max("seq").alias("seq"))
            last.select(*S.CACHE.names).withColumn("gen", F.lit(self.generation() + 1)).write.mode("append").partitionBy("gen").parquet(self.path)


def model_edges(articles: DataFrame, cache: DataFrame) -> DataFrame:
    """``(article_id, date, firm_a, firm_b, relation, rumor, headline)`` from cached relations."""
    keyed = articles.withColumn("key", cache_key(F.col("title")))
    return keyed.join(latest(cache), "key").select(
        "article_id", "date", F.posexplode("relations").alias("ord", "r"), F.col("title").alias("headline")).select(
        "article_id", "date", "r.firm_a", "r.firm_b", "r.relation", "r.rumor", "headline", "ord")


def last_relations(articles: DataFrame, cache: DataFrame) -> DataFrame:
    """``(article_id, relation)``: the last cached relation of every headline that has one."""
    keyed = articles.select("article_id", cache_key(F.col("title")).alias("key"))
    return keyed.join(latest(cache).where(F.size("relations") > 0), "key").select(
        "article_id", F.element_at("relations", -1)["relation"].alias("relation"))


def run_cached(articles: DataFrame, cache_path: str, extractor=pattern_extractor) -> DataFrame:
    """Extract what is missing, keep it in the cache, return all edges. ``Cache.failed`` tells what got no answer."""
    cache = Cache(articles.sparkSession, cache_path)
    held = cache.read()
    seq = 0 if held is None else (held.agg(F.max("seq")).first()[0] or 0) + 1
    cache.add(attempts(uncached(articles, held), extractor, seq=seq))
    return model_edges(articles, cache.read())
