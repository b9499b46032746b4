"""The chunked scan and the restartable extraction as file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from firmament import schemas as S
from firmament.operators.news import LAST_DAY, filter_news
from firmament.sources import extractor as X
from firmament.sources.files import NEWS_OPTIONS, news_file_schema


def stream_news(spark: SparkSession, folder: str, tickers: DataFrame, max_files: int = 8,
                last_day: str = LAST_DAY) -> DataFrame:
    """News files as they arrive, filtered like the batch; the first files' header gives the columns."""
    raw = spark.readStream.schema(news_file_schema(spark, folder)).options(**NEWS_OPTIONS).option(
        "maxFilesPerTrigger", max_files).csv(folder).select(*[f.name for f in S.NEWS_CSV.fields])
    return filter_news(raw, tickers, last_day)


def stream_extraction(articles: DataFrame, cache_path: str, checkpoint: str,
                      extractor=X.pattern_extractor) -> StreamingQuery:
    """Extract each arriving headline once; a replayed batch finds its keys cached, what failed is in the cache's log."""

    def step(batch: DataFrame, epoch: int) -> None:
        cache = X.Cache(batch.sparkSession, cache_path)
        cache.add(X.attempts(X.uncached(batch, cache.read()), extractor, seq=epoch))

    return articles.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def stream_blocks(events: DataFrame, width: str = "7 days", late: str = "1 day", ts: str = "ts",
                  key: str = "firm", value: str = "x") -> DataFrame:
    """Fixed-width block sums per key, the streaming form of the horizon blocks."""
    return (
        events.withWatermark(ts, late).groupBy(F.window(ts, width), key)
        .agg(F.sum(value).alias(value)).select(F.col("window.start").alias("block_start"), key, value)
    )
