"""Market-shaped inputs derived from the order tables.

A supplier is a firm, its ship weeks are the periods, the price is the mean
unit price of the week. Suppliers of consecutive lines of an order are linked
on the ship date; the line's flags give the relation type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmament.operators import panel as P
from firmament.session import materialize

UNIVERSE_N = 20
LOOKBACK = 104
REFIT_EVERY = 20
BASE_DATE = "1995-01-02"
LAYER_OF_CODE = ["COMPETES_WITH", "PARTNERS_WITH", "SUPPLIES_TO", "ACQUIRES", "SECTOR_PEER", "ANALYZES"]
PHRASES = [
    ("", " rivals ", " in a price war"),
    ("", " partners with ", " on logistics"),
    ("", " wins supplier deal with ", ""),
    ("", " to acquire ", ""),
    ("", " and ", " report quarterly sales"),
    ("Weekly roundup: ", " to acquire ", ""),
]
LINE_ORDER = ["l_linenumber", "l_suppkey", "l_shipdate", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus"]
RELATION_OF_CODE = ["competitor", "partnership", "supplier", "acquisition"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """``(date, firm, volume, qty)``: the one aggregation over all line items."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.to_date(F.date_trunc(grain, "l_shipdate")).alias("date"), F.col("l_suppkey").alias("firm"))
        .agg(F.sum("l_extendedprice").alias("volume"), F.sum("l_quantity").alias("qty"))
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region of suppliers in credit, else nation label (Middle East nations act
    as the market rows to be removed), else Unknown."""
    s = table(spark, sf_dir, "supplier")
    geo = (
        table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "r_name")
    )
    placed = s.join(geo, s.s_nationkey == geo.n_nationkey).select(
        F.col("s_suppkey").alias("firm"), "s_acctbal", "n_name", "r_name")
    preferred = placed.select("firm", F.when(F.col("s_acctbal") >= 0, F.col("r_name")).alias("sector"))
    fallback = placed.select("firm", F.when(F.col("r_name") == "MIDDLE EAST", "SPY").otherwise(
        F.col("n_name")).alias("sector"))
    return P.resolve_sector(placed, preferred, fallback)


@dataclass
class Market:
    """The derived panel and what belongs to it."""

    cells: DataFrame
    calendar: DataFrame
    universe: DataFrame
    sectors: DataFrame
    returns: DataFrame
    excess: DataFrame


def market(spark: SparkSession, sf_dir: str, grain: str = "week", n: int | None = UNIVERSE_N) -> Market:
    """Panel of the ``n`` most traded firms; ``n=None`` takes every firm with a known sector.

    The line items are aggregated once and written; everything below reads that.
    """
    c = materialize(cells(spark, sf_dir, grain), f"cells-{grain}")
    cal = materialize(P.calendar_of(c), f"calendar-{grain}")
    sec = sectors(spark, sf_dir)
    if n is None:
        uni = sec.where(F.col("sector") != P.UNKNOWN).select("firm")
        prices = c.join(uni, "firm", "left_semi").join(cal, "date")
        grid = P.dense_grid(uni, cal)
    else:
        uni = materialize(P.top_by_mean(c, sec, n).select("pos", "firm"), "universe")
        prices = c.join(uni.select("firm"), "firm", "left_semi").join(cal, "date")
        grid = P.dense_grid(uni, cal)
    priced = (
        grid.join(prices.drop("date"), ["firm", "t"], "left").join(cal, "t")
        .withColumn("price", F.col("volume") / F.col("qty"))
    )
    returns = P.simple_returns(priced)
    return Market(c, cal, uni, sec, returns, P.excess(returns, market_returns(c, cal)))


def market_returns(c: DataFrame, cal: DataFrame) -> DataFrame:
    """All-firm return per period; one row per calendar date."""
    total = (
        c.groupBy("date").agg((F.sum("volume") / F.sum("qty")).alias("price")).join(cal, "date")
        .withColumn("market", F.lit("all"))
    )
    return P.simple_returns(total, by=["market"]).select("t", "r")


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item of an order with the next one's firm: ``seq`` numbers an order's lines.

    Lines follow each other by line number, then supplier and the other columns,
    so lines sharing a number all take part and a pair's date, code and discount
    come from one line. An order's lines are sorted together.
    """
    li = table(spark, sf_dir, "lineitem")
    code = (
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(4)
        + F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    )
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return li.select(
        "l_orderkey", F.row_number().over(w).alias("seq"), F.col("l_shipdate").alias("ts"), code.alias("code"),
        F.col("l_discount").alias("disc"), F.col("l_suppkey").alias("firm_a"), F.lead("l_suppkey").over(w).alias("firm_b"),
    ).where(F.col("firm_a") != F.col("firm_b"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.element_at(F.array(*[F.lit(x) for x in LAYER_OF_CODE]), F.col("code") + 1)
    return line_pairs(spark, sf_dir).select(
        F.to_date("ts").alias("date"), layer.alias("layer"),
        F.least("firm_a", "firm_b").alias("src"), F.greatest("firm_a", "firm_b").alias("dst"),
        (1 - F.col("disc")).alias("conf"))


def display_name():
    """Supplier names without the word that would itself read as a relation."""
    return F.replace(F.col("s_name"), F.lit("Supplier#"), F.lit("Vendor "))


def names(spark: SparkSession, sf_dir: str, universe: DataFrame) -> DataFrame:
    """Dictionary of the universe's firms: official names with legal suffixes, one spelled-out variant."""
    suffix = (
        F.when(F.col("s_nationkey") < 8, ", Inc.").when(F.col("s_nationkey") < 16, " Corporation")
        .otherwise(" Group plc"))
    return (
        table(spark, sf_dir, "supplier").join(universe, F.col("s_suppkey") == F.col("firm"))
        .select("firm", "pos",
                F.concat(F.when(F.col("s_acctbal") > 5000, "The ").otherwise(""), display_name(), suffix).alias("official_name"),
                F.concat(F.lit("House of "), display_name(), F.lit("|V"), F.col("firm").cast("string")).alias("variants"))
    )


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stated (or merely mentioned) pair per consecutive line pair, with its label."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", display_name().alias("s_name"))
    pre, mid, post = (F.element_at(F.array(*[F.lit(p[i]) for p in PHRASES]), F.col("code") + 1) for i in range(3))
    relation = F.get(F.array(*[F.lit(r) for r in RELATION_OF_CODE]), F.col("code"))
    truth = (
        F.when((F.col("code") < 4) & (F.col("disc") < 0.09), relation)
        .when((F.col("code") == 4) & (F.col("disc") <= 0.01), "partnership")
    )
    a = s.select(F.col("s_suppkey").alias("firm_a"), F.col("s_name").alias("name_a"))
    b = s.select(F.col("s_suppkey").alias("firm_b"), F.col("s_name").alias("name_b"))
    return (
        line_pairs(spark, sf_dir).join(a, "firm_a").join(b, "firm_b")
        .select(
            F.concat_ws("/", F.lit("order"), "l_orderkey", "seq").alias("article_id"),
            "ts", "code", "disc", "firm_a", "firm_b", "name_a", "name_b",
            F.concat(pre, "name_a", mid, "name_b", post).alias("title"),
            F.coalesce(F.concat(truth, F.lit(": "), "name_a", F.lit("-"), "name_b"), F.lit("none")).alias("label"),
            F.when(F.col("disc") < 0.05, "low discount").otherwise("high discount").alias("panel"))
    )


def news_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw news: one row per (article, tagged firm), with missing URLs, titles and unreadable dates."""
    h = headlines(spark, sf_dir)
    return h.select(
        F.when((F.col("code") == 5) & (F.col("disc") >= 0.09), "not a date").otherwise(
            F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))).alias("Date"),
        F.when(~((F.col("code") == 4) & (F.col("disc") >= 0.09)), F.col("title")).alias("Article_title"),
        F.explode(F.array("firm_a", "firm_b")).alias("Stock_symbol"),
        F.when(F.col("disc") < 0.08, F.concat(F.lit("https://news.example/"), "article_id")).alias("Url"),
        F.when(F.col("disc") > 0.02, F.concat(F.lit("Desk "), F.col("code").cast("string"))).alias("Publisher"),
        F.col("article_id").alias("source_row"),
    )
