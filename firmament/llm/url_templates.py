"""URL filters: listed rules first, then a path-template tree learned per host.

A rule is a host with a path prefix; it fits that host and its subdomains where the path starts with the prefix, and the
longest fitting rule decides. What no rule decides is judged by templates. A path's segments are generalised by form first:
digit runs become ``{n}``, long hexadecimal names ``{hex}``, segments over 64 characters ``{long}``, and what lies deeper than
``DEPTH`` segments ``{rest}``. Then the tree of a host is built level by level from counts:

* a child with under ``SHARE`` of its node's pages is no name of the site's structure: all such become ``*``;
* children whose continuations are alike (total variation between the forms of what follows) and whose smoothed label shares
  are near become one branch, named after all of them.

Pages that a rule decides are the labelled ones; reviewed labels can be added. A template is rejected when its smoothed share of
blocked pages among labelled ones exceeds ``REJECT``; it is smoothed towards the share of its host's known blocked pages among
all its pages, and that towards ``PRIOR``. So a template without labels goes only if most of its whole host is known to be bad.

A node keeps at most ``1 / SHARE`` named children and one ``*``, so a node's children are merged in one row however many
pages it has. Hosts, nodes and forms are counted with map-side combine before anything is shuffled.

Null urls and those without ``://`` have empty host and path, which is a host of its own. Equal urls get equal verdicts, repeated
rows each their own row; equally long rules are told apart by their text. Urls of any length are read whole. An empty table
gives an empty one; without labelled pages everything is allowed. Only id, url and (of the reviewed) id and verdict are read.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import ascii_lower, join_measured, materialize, ship_package

DEPTH, SHARE, LONG = 6, 1 / 64, 64
STRENGTH, PRIOR, REJECT = 4.0, 0.1, 0.5
APART, LABELS_APART = 0.2, 0.25
FORMS = ("end", "number", "mixed", "file", "word")
RARE = "*"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without ``://``."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``name, verdict`` of the longest of the ``(verdict, host, path)`` that fits; null if none does."""
    name = [(h + p, v, h, p) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
    out = F.lit(None).cast("struct<name: string, verdict: string>")
    for full, verdict, h, p in reversed(name):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(full).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shaped(path: Column) -> Column:
    """The segments of a path, generalised by form."""
    def one(s: Column) -> Column:
        return (F.when(F.length(s) > LONG, "{long}").when(F.rlike(s, F.lit("^(?=.*[0-9])[0-9a-fA-F-]{8,}$")) & F.rlike(s, F.lit("[a-fA-F]")), "{hex}")
                .otherwise(F.regexp_replace(s, "[0-9]+", "{n}")))

    parts = F.array_remove(F.split(path, "/"), "")
    head = F.transform(F.slice(parts, 1, DEPTH), one)
    return F.when(F.size(parts) > DEPTH, F.concat(head, F.array(F.lit("{rest}")))).otherwise(head)


def form(segment: Column) -> Column:
    """The place in ``FORMS`` of a generalised segment, null where the path ends."""
    return (F.when(segment.isNull(), 0).when(segment.isin("{n}", "{hex}"), 1).when(F.contains(segment, F.lit("{")), 2)
            .when(F.contains(segment, F.lit(".")), 3).otherwise(4))


def merged_branches(kids: list[dict]) -> dict[str, str]:
    """The branch of each child: children are taken by size and join the first branch they resemble.

    A child is ``seg, n, lab, bad`` and the numbers of pages by form of what follows, in ``next``.
    """
    branches: list[list] = []  # names, n, lab, bad, next
    for kid in sorted(kids, key=lambda k: (-k["n"], k["seg"])):
        for b in branches if kid["seg"] != RARE else ():
            apart = sum(abs(x / b[1] - y / kid["n"]) for x, y in zip(b[4], kid["next"], strict=True)) / 2
            noise = math.sqrt(1 / b[1] + 1 / kid["n"]) / 4
            rates = [(bad + STRENGTH * PRIOR) / (lab + STRENGTH) for bad, lab in ((b[3], b[2]), (kid["bad"], kid["lab"]))]
            if RARE not in b[0] and apart <= APART + noise and abs(rates[0] - rates[1]) <= LABELS_APART:
                b[0].append(kid["seg"])
                b[1:4] = [b[1] + kid["n"], b[2] + kid["lab"], b[3] + kid["bad"]]
                b[4] = [x + y for x, y in zip(b[4], kid["next"], strict=True)]
                break
        else:
            branches.append([[kid["seg"]], kid["n"], kid["lab"], kid["bad"], list(kid["next"])])
    return {name: "|".join(sorted(b[0])) for b in branches for name in b[0]}


def grown(base: DataFrame, level: int) -> DataFrame:
    """``base`` (``host, raw, segs, n, lab, bad``) with the segment of one level generalised and merged."""
    node = F.concat_ws("/", F.slice("segs", 1, level)).alias("node")
    here, after = F.get("segs", F.lit(level)), F.get("segs", F.lit(level + 1))
    open_ = base.where(F.size("segs") > level).select("host", node, here.alias("seg"), "n", "lab", "bad", form(after).alias("form"))
    sums = [F.sum(c).alias(c) for c in ("n", "lab", "bad", *(f"f{i}" for i in range(len(FORMS))))]
    by_form = [F.when(F.col("form") == i, F.col("n")).otherwise(0).alias(f"f{i}") for i in range(len(FORMS))]
    kids = materialize(open_.select("host", "node", "seg", "n", "lab", "bad", *by_form).groupBy("host", "node", "seg").agg(*sums), "url-kids")
    total = kids.groupBy("host", "node").agg(F.sum("n").alias("all"))
    named = F.when(F.col("n") >= SHARE * F.col("all"), F.col("seg")).otherwise(F.lit(RARE)).alias("seg")
    few = kids.join(total, ["host", "node"]).select("host", "node", named, "n", "lab", "bad", *[f"f{i}" for i in range(len(FORMS))])
    few = few.groupBy("host", "node", "seg").agg(*sums)
    # At most 1 / SHARE + 1 children are left of a node.
    kid = F.struct("seg", "n", "lab", "bad", F.array(*[f"f{i}" for i in range(len(FORMS))]).alias("next"))
    nodes = few.groupBy("host", "node").agg(F.collect_list(kid).alias("kids"))

    def merge(batches):
        for b in batches:
            names = [list(merged_branches(kids).items()) for kids in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.map_(pa.string(), pa.string()))], ["host", "node", "names"])

    nodes = materialize(nodes.mapInArrow(merge, "host string, node string, names map<string, string>"), "url-nodes")
    out = join_measured(base.withColumn("node", F.when(F.size("segs") > level, node)), nodes, ["host", "node"], "left")
    name = F.coalesce(F.element_at("names", here), F.element_at("names", F.lit(RARE)))
    segs = F.concat(F.slice("segs", 1, level), F.array(name), F.slice("segs", F.lit(level + 2), F.size("segs")))
    segs = F.when(F.size("segs") > level, segs).otherwise(F.col("segs"))
    return materialize(out.select("host", "raw", segs.alias("segs"), "n", "lab", "bad"), "url-tree")


def templates(pages: DataFrame) -> DataFrame:
    """``host, raw, template, share``: of each generalised path its template and the template's smoothed share of blocked pages.

    ``pages`` has ``host, segs`` (generalised by form) and ``bad``: 1 or 0 where labelled, else null.
    """
    ship_package(pages.sparkSession)
    raw = F.concat_ws("/", "segs").alias("raw")
    counts = [F.count("*").alias("n"), F.count("bad").alias("lab"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad")]
    base = materialize(pages.select("host", raw, "bad").groupBy("host", "raw").agg(*counts), "url-paths")
    tree = base.select("host", "raw", F.array_remove(F.split("raw", "/"), "").alias("segs"), "n", "lab", "bad")
    for level in range(min(DEPTH + 1, base.agg(F.max(F.size(F.array_remove(F.split("raw", "/"), "")))).first()[0] or 0)):
        tree = grown(tree, level)
    template = F.concat_ws("/", "segs").alias("template")
    each = tree.groupBy("host", template).agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    known = (F.sum("bad") + STRENGTH * PRIOR) / (F.sum("n") + STRENGTH)
    share = (F.col("bad") + STRENGTH * F.col("known")) / (F.col("lab") + STRENGTH)
    rated = each.join(tree.groupBy("host").agg(known.alias("known")), "host").select("host", "template", share.alias("share"))
    return tree.select("host", "raw", template).join(rated, ["host", "template"])


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], reviewed: DataFrame | None = None, id_col: str = "page_id",
                 url_col: str = "url") -> DataFrame:
    """Per row: id, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``, allow or block.

    ``reviewed`` may hold further labels, ``id_col`` and ``bad`` (1 or 0); a rule's verdict comes before them.
    """
    host, path = url_parts(F.col(url_col))
    src = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    src = src.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    bad = F.when(F.col("rule").isNotNull(), (F.col("rule.verdict") == "block").cast("int"))
    if reviewed is not None:
        seen = reviewed.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("bad").alias("seen"))
        src = src.join(seen, "id", "left")
        bad = F.coalesce(bad, F.col("seen").cast("int"))
    src = materialize(src.select("id", "host", "path", "rule", bad.alias("bad"), shaped(F.col("path")).alias("segs")), "url-pages")
    rejected = materialize(templates(src.select("host", "segs", "bad")).where(F.col("share") > REJECT).select("host", "raw"), "url-rejected")
    ruled = src.where("rule is not null").select("id", "host", "path", "rule.name", "rule.verdict")
    rest = src.where("rule is null").withColumn("raw", F.concat_ws("/", "segs"))
    rest = join_measured(rest, rejected.withColumn("hit", F.lit(True)), ["host", "raw"], "left").select(
        "id", "host", "path", F.lit(None).cast("string").alias("name"), F.when(F.col("hit"), "block").otherwise("allow").alias("verdict"))
    return ruled.unionByName(rest).select(F.col("id").alias(id_col), "host", "path", F.col("name").alias("rule"), "verdict")
