"""Readers and writers of the file formats the pipeline exchanges."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from firmament import schemas as S
from firmament.operators.panel import unpivot_matrix


NEWS_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "enforceSchema": False}


def read_matrix(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """Wide CSV, firms as rows and ``X<yyyymmdd>`` day columns, as ``(date, firm, value)``.

    Only the header decides the columns; every day column is a double.
    """
    header = spark.read.text(path).first()["value"]
    cols = [c.strip().strip('"') for c in header.split(",")]
    schema = "ticker string, " + ", ".join(f"`{c}` double" for c in cols[1:])
    return unpivot_matrix(spark.read.csv(path, header=True, schema=schema), "ticker", value)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=S.CALENDAR_CSV).select(F.to_date("yyyymmdd", "yyyyMMdd").alias("date"))


def read_sector_named(spark: SparkSession, path: str, ticker: str = "Ticker", sector: str = "Sector_Wikipedia") -> DataFrame:
    return spark.read.csv(path, header=True).select(F.col(ticker).alias("firm"), F.col(sector).alias("sector"))


def read_sector_positional(spark: SparkSession, path: str, ticker: int = 2, sector: int = 3) -> DataFrame:
    return spark.read.csv(path, schema=S.SECTOR_CSV_POSITIONAL).select(
        F.col(f"c{ticker}").alias("firm"), F.col(f"c{sector}").alias("sector"))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, firm)``; the order in the file is the matrix order."""
    from pyspark.sql import Window as W

    listed = spark.read.csv(path, header=True, schema="ticker string").select(
        F.col("ticker").alias("firm"), F.monotonically_increasing_id().alias("_id"))
    return listed.select((F.row_number().over(W.orderBy("_id")) - 1).alias("pos"), "firm")


def load_panel(spark: SparkSession, path: str, universe: DataFrame | None = None) -> DataFrame:
    """The saved panel, restricted to a universe when one is given."""
    panel = spark.read.parquet(path)
    return panel if universe is None else panel.join(universe.select("pos", "firm"), "firm")


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """Raw news CSV, line breaks inside quotes included; a file is read by one task, so ingest many files."""
    return spark.read.options(**NEWS_OPTIONS).csv(path).select(*[f.name for f in S.NEWS_CSV.fields])


def news_file_schema(spark: SparkSession, path: str) -> StructType:
    """All columns of the files' header, as text: columns are told by name, not by place."""
    return spark.read.options(**NEWS_OPTIONS).csv(path).schema


def read_names(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql import Window as W

    d = spark.read.csv(path, header=True, schema=S.NAMES_CSV).withColumn("_id", F.monotonically_increasing_id())
    return d.select(F.col("ticker").alias("firm"), (F.row_number().over(W.orderBy("_id")) - 1).alias("pos"),
                    "official_name", "variants")


def read_labels(spark: SparkSession, panels: dict[str, str]) -> DataFrame:
    """Union of label files, each row tagged with its panel's name."""
    out = None
    for panel, path in panels.items():
        part = spark.read.csv(path, header=True, schema=S.LABELS_CSV, quote='"', escape='"').withColumn("panel", F.lit(panel))
        out = part if out is None else out.unionByName(part)
    return out


def read_ticker_index(spark: SparkSession, path: str) -> DataFrame:
    """JSON list of tickers as ``(idx, firm)``; the position is the global id."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("idx", "firm"))


def read_snapshots(spark: SparkSession, root: str, kind: str = "multiplex") -> DataFrame:
    """Sparse npz snapshots ``<root>/w<win>/<kind>_<yyyymmdd>.npz`` as edge rows.

    One file is one snapshot and cannot be split; files are spread over tasks and
    a file's arrays are emitted layer by layer. The unified kind has one layer,
    ``ALL``. Endpoints are global indices; ``seq`` is the row's place in its layer.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{kind}_*.npz").option(
        "recursiveFileLookup", True).load(root).select("path", "content")

    def expand(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                folder, stem = path.rsplit("/", 2)[-2:]
                day = pd.Timestamp(stem.split("_")[1].split(".")[0]).date()
                z = np.load(io.BytesIO(content), allow_pickle=False)
                layers = sorted({k.rsplit("__", 1)[0] for k in z.files if "__" in k}) or [None]
                for layer in layers:
                    pre = "" if layer is None else f"{layer}__"
                    row = z[f"{pre}row"]
                    yield pd.DataFrame({
                        "snap_date": day, "win": np.int32(folder[1:]), "layer": layer or "ALL",
                        "src": row.astype("int64"), "dst": z[f"{pre}col"].astype("int64"),
                        "weight": z[f"{pre}data"].astype("float64"), "seq": np.arange(len(row), dtype="int64")})

    return files.mapInPandas(expand, S.SNAPSHOT)


def index_to_firm(snapshots: DataFrame, index: DataFrame) -> DataFrame:
    """Global indices to firm names; an index outside the list drops its edge."""
    a = index.select(F.col("idx").alias("src"), F.col("firm").alias("a"))
    b = index.select(F.col("idx").alias("dst"), F.col("firm").alias("b"))
    return snapshots.join(a, "src").join(b, "dst").select(
        "snap_date", "win", "layer", F.col("a").alias("src"), F.col("b").alias("dst"), "weight", "seq")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Metric tables, panels and articles. CSV cannot hold arrays, use parquet for those."""
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def create_universe_if_missing(universe: DataFrame, path: str) -> None:
    universe.orderBy("pos").select(F.col("firm").alias("ticker")).write.mode("ignore").option("header", True).csv(path)
