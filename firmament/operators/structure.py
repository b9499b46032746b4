"""Shape of snapshot graphs: clustering, components, sector mix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.operators.graph import (
    SNAPSHOT_KEY, both_ways, degrees, edge_persistence, edge_summary,
)
from firmament.session import materialize


def triangles(graph: DataFrame) -> DataFrame:
    """``(snap_date, win, node, triangles)`` for nodes in at least one triangle.

    Every edge points from its lower-degree end to the higher, which leaves no
    node with more than sqrt(2 x edges) outgoing links, hubs included. A triangle
    is then a common entry of the two ends' outgoing lists; open wedges are
    never written out.
    """
    deg = degrees(graph)
    e = graph.where(F.col("weight") > 0).select(*SNAPSHOT_KEY, "src", "dst")
    ds = deg.select(*SNAPSHOT_KEY, F.col("node").alias("src"), F.col("degree").alias("sd"))
    dd = deg.select(*SNAPSHOT_KEY, F.col("node").alias("dst"), F.col("degree").alias("dd"))
    up = F.struct("sd", "src") < F.struct("dd", "dst")
    directed = (
        e.join(ds, [*SNAPSHOT_KEY, "src"]).join(dd, [*SNAPSHOT_KEY, "dst"])
        .select(*SNAPSHOT_KEY,
                F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"),
                F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"))
    )
    out = directed.groupBy(*SNAPSHOT_KEY, "u").agg(F.collect_set("v").alias("out"))
    corner = F.explode(F.array_intersect("out", "out_v")).alias("w")
    found = (
        directed.join(out, [*SNAPSHOT_KEY, "u"])
        .join(out.select(*SNAPSHOT_KEY, F.col("u").alias("v"), F.col("out").alias("out_v")), [*SNAPSHOT_KEY, "v"])
        .select(*SNAPSHOT_KEY, "u", "v", corner)
    )
    return found.select(*SNAPSHOT_KEY, F.explode(F.array("u", "v", "w")).alias("node")).groupBy(
        *SNAPSHOT_KEY, "node").agg(F.count("*").alias("triangles"))


def clustering(graph: DataFrame) -> DataFrame:
    """Local clustering coefficient of every node with an edge."""
    d = F.col("degree")
    return (
        degrees(graph).join(triangles(graph), [*SNAPSHOT_KEY, "node"], "left")
        .select(*SNAPSHOT_KEY, "node", "degree", F.when(
            d >= 2, 2 * F.coalesce("triangles", F.lit(0)) / (d * (d - 1))).otherwise(0.0).alias("clustering"))
    )


def connected_components(graph: DataFrame) -> DataFrame:
    """``(snap_date, win, node, component)``; the component is its smallest node.

    Each round contracts the graph: a node takes the smallest label next to it,
    the labels are followed one step further, edges are rewritten to labels and
    emptied ones dropped. All snapshots advance together. A round's state is
    written to the shared folder, so the plan stays short and a lost executor
    costs one round.
    """
    key = SNAPSHOT_KEY
    edges = materialize(graph.where(F.col("weight") > 0).select(*key, "src", "dst").distinct(), "cc-edges")
    labels = both_ways(edges).select(*key, F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    labels = materialize(labels, "cc-labels")
    while True:
        near = both_ways(edges).groupBy(*key, F.col("src").alias("node")).agg(F.min("dst").alias("low"))
        near = near.select(*key, "node", F.least("low", "node").alias("low"))
        hop = near.select(*key, F.col("node").alias("low"), F.col("low").alias("lower"))
        step = materialize(
            near.join(hop, [*key, "low"], "left").select(*key, "node", F.coalesce("lower", "low").alias("low")),
            "cc-step")
        labels = materialize(
            labels.join(step.select(*key, F.col("node").alias("component"), "low"), [*key, "component"], "left")
            .select(*key, "node", F.coalesce("low", "component").alias("component")), "cc-labels")
        src = step.select(*key, F.col("node").alias("src"), F.col("low").alias("s"))
        dst = step.select(*key, F.col("node").alias("dst"), F.col("low").alias("d"))
        edges = materialize(
            edges.join(src, [*key, "src"]).join(dst, [*key, "dst"]).where(F.col("s") != F.col("d"))
            .select(*key, F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).distinct(), "cc-edges")
        if edges.isEmpty():
            return labels


def component_sizes(graph: DataFrame) -> DataFrame:
    sizes = connected_components(graph).groupBy(*SNAPSHOT_KEY, "component").agg(F.count("*").alias("size"))
    return sizes.groupBy(*SNAPSHOT_KEY).agg(
        F.count("*").alias("components"), F.max("size").alias("largest_comp"))


def sector_share(graph: DataFrame, sectors: DataFrame) -> DataFrame:
    """Percent of edges inside one sector; two Unknown firms count as alike."""
    a = sectors.select(F.col("firm").alias("src"), F.col("sector").alias("sa"))
    b = sectors.select(F.col("firm").alias("dst"), F.col("sector").alias("sb"))
    same = (F.coalesce("sa", F.lit("Unknown")) == F.coalesce("sb", F.lit("Unknown"))).cast("double")
    return (
        graph.where(F.col("weight") > 0).join(a, "src", "left").join(b, "dst", "left")
        .groupBy(*SNAPSHOT_KEY).agg((100 * F.avg(same)).alias("pct_within_sector"))
    )


def structure(graph: DataFrame, snaps: DataFrame, universe: DataFrame, sectors: DataFrame) -> DataFrame:
    """All structure metrics of every snapshot, with edge persistence."""
    zero = F.lit(0)
    cc = clustering(graph).groupBy(*SNAPSHOT_KEY).agg(F.avg("clustering").alias("clustering"))
    return (
        edge_summary(graph, snaps, universe)
        .join(component_sizes(graph), SNAPSHOT_KEY, "left")
        .join(cc, SNAPSHOT_KEY, "left")
        .join(sector_share(graph, sectors), SNAPSHOT_KEY, "left")
        .join(edge_persistence(graph, snaps), SNAPSHOT_KEY, "left")
        .select(*SNAPSHOT_KEY, "edges", "density", "mean_degree", "max_degree", "isolated",
                F.coalesce("components", zero).alias("components"),
                F.coalesce("largest_comp", zero).alias("largest_comp"),
                F.coalesce("clustering", F.lit(0.0)).alias("clustering"),
                "pct_within_sector", "edge_persistence")
    )


STRUCTURE_METRICS = ["edges", "density", "mean_degree", "max_degree", "isolated", "components",
                     "largest_comp", "clustering", "pct_within_sector", "edge_persistence"]


def describe(table: DataFrame, columns: list[str]) -> DataFrame:
    """mean, std, min, median and max of each column, one row per column."""
    stats = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns]))
    return table.select(stats.alias("s")).groupBy("s.metric").agg(
        F.avg("s.v").alias("mean"), F.stddev_samp("s.v").alias("std"), F.min("s.v").alias("min"),
        F.percentile("s.v", F.lit(0.5)).alias("median"), F.max("s.v").alias("max"))


def mean_by_year(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.groupBy(F.year("snap_date").alias("year")).agg(*[F.avg(c).alias(c) for c in columns])
