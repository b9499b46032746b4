"""Declared schemas of the inputs; nothing is inferred."""

from pyspark.sql import types as T

NEWS_CSV = T.StructType([
    T.StructField("Date", T.StringType()),
    T.StructField("Article_title", T.StringType()),
    T.StructField("Stock_symbol", T.StringType()),
    T.StructField("Url", T.StringType()),
    T.StructField("Publisher", T.StringType()),
])

CALENDAR_CSV = T.StructType([T.StructField("yyyymmdd", T.StringType())])

SECTOR_CSV_POSITIONAL = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(4)])

NAMES_CSV = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("official_name", T.StringType()),
    T.StructField("variants", T.StringType()),
])

LABELS_CSV = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("date", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("universe_tickers", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("reason", T.StringType()),
])

RELATION = T.StructType([
    T.StructField("firm_a", T.StringType()),
    T.StructField("firm_b", T.StringType()),
    T.StructField("relation", T.StringType()),
    T.StructField("rumor", T.BooleanType()),
])

CACHE = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("relations", T.ArrayType(RELATION)),
    T.StructField("seq", T.LongType()),
])

ATTEMPTS = T.StructType([*CACHE.fields, T.StructField("error", T.StringType())])
GENERATIONS = T.StructType([*CACHE.fields, T.StructField("gen", T.IntegerType())])
FAILURES = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("seq", T.LongType()),
])

SNAPSHOT = T.StructType([
    T.StructField("snap_date", T.DateType()),
    T.StructField("win", T.IntegerType()),
    T.StructField("layer", T.StringType()),
    T.StructField("src", T.LongType()),
    T.StructField("dst", T.LongType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("seq", T.LongType()),
])
