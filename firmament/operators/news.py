"""News rows to one row per article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST_DAY = "2020-12-31"


def utc_time(text: Column) -> Column:
    """A written time as naive UTC, NULL if unreadable; no zone means UTC, whatever the session's zone."""
    day_only = text.rlike(r"^\d{4}-\d\d-\d\d$")
    zoned = text.rlike(r"(Z|[A-Z]{3}|[+-]\d\d:?\d\d)$")
    full = F.when(day_only, F.concat(text, F.lit(" 00:00:00 UTC"))).when(zoned, text).otherwise(
        F.concat(text, F.lit(" UTC")))
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.try_to_timestamp(full)),
                           F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def filter_news(rows: DataFrame, tickers: DataFrame, last_day: str = LAST_DAY) -> DataFrame:
    """Keep rows tagged with a panel ticker that have a readable date and a title.

    ``rows`` has the raw columns; a date that cannot be read drops its row, and
    the upper bound is midnight of ``last_day``.
    """
    when = utc_time(F.col("Date"))
    return (
        rows.join(tickers.select(F.col("firm").alias("Stock_symbol")), "Stock_symbol", "left_semi")
        .withColumn("Date", when)
        .dropna(subset=["Date", "Article_title"])
        .where(F.col("Date") <= F.lit(last_day).cast("timestamp_ntz"))
    )


def article_table(news: DataFrame, row_order: list[str]) -> DataFrame:
    """Collapse (article, ticker) rows on URL, or on title where there is none.

    "First" title and publisher are the first non-null in ``row_order``; every
    aggregate combines on the map side, and the tag set of an article is
    bounded by the universe the rows were filtered to.
    """
    at = F.struct(*row_order)

    def first(col):
        return F.min_by(col, F.when(F.col(col).isNotNull(), at))

    return (
        news.groupBy(F.coalesce("Url", "Article_title").alias("article_id"))
        .agg(F.min("Date").alias("date"), first("Article_title").alias("title"),
             first("Publisher").alias("publisher"),
             F.array_sort(F.collect_set("Stock_symbol")).alias("tickers"))
        .withColumn("n_tickers", F.size("tickers"))
    )
