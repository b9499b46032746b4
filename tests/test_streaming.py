"""Streamed runs equal their batch forms."""

from pyspark.sql import functions as F

from firmament.sources import extractor as E
from firmament.streaming import news as SN


def test_streamed_news_and_extraction(spark, tmp_path):
    src = tmp_path / "news"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.csv").write_text(
            "Date,Article_title,Stock_symbol,Url,Publisher\n"
            f"2010-01-0{i + 1},Acme{i} to acquire Borealis,A,u{i},p\n2010-01-01,Zeta rivals Other,NOPE,v{i},p\n")
    tickers = spark.createDataFrame([("A",)], "firm string")
    rows = SN.stream_news(spark, str(src), tickers, max_files=1).select(
        F.col("Url").alias("article_id"), F.col("Article_title").alias("title"))
    cache = str(tmp_path / "cache")
    SN.stream_extraction(rows, cache, str(tmp_path / "cp")).awaitTermination()
    held = spark.read.schema(E.S.CACHE).parquet(cache)
    assert held.count() == 3 and held.select("key").distinct().count() == 3
    SN.stream_extraction(rows, cache, str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.schema(E.S.CACHE).parquet(cache).count() == 3


def test_streamed_blocks_equal_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    src = str(tmp_path / "events")
    events.repartition(4).write.parquet(src)
    streamed = SN.stream_blocks(
        spark.readStream.schema(events.schema).parquet(src).withColumn("ts", F.col("ts").cast("timestamp")),
        key="user_id", value="value", late="60 days")
    q = streamed.writeStream.outputMode("complete").format("memory").queryName("blocks").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "7 days"), "user_id").agg(F.sum("value").alias("v"))
    got = {(r["block_start"], r["user_id"]): round(r["value"], 6) for r in spark.table("blocks").collect()}
    want = {(r["window"]["start"], r["user_id"]): round(r["v"], 6) for r in batch.collect()}
    assert got == want and got
