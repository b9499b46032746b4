"""How five quality filters act on each other, in every order they can be applied.

A document's failures are the bits of a mask: A under 100 words, B under 80 % different words, C over 10 % capitals A-Z,
D one of ``#$%&*|``, E a text that a smaller id has too, anywhere in the table. One scan of the texts makes masks and
digests; documents are then counted by part and mask, at most 32 cells a part whatever the table's size. Each cell folds over
the array of all 120 orders with ``transform`` and ``aggregate`` and becomes 600 structs, one for each order and step, weighted
with the cell's counts; the cells of a part are merged by elementwise sums.

Null texts count as empty: they fail A. Null languages are the part of the empty string. A row without an id never fails E and
lets no other fail it; it has no labels. Of repeated rows with the same id none is smaller, so they do not fail E by each
other. A document is good (toxic) if any label row of its id says so. Texts are read whole, whatever their length; an empty
table has no parts, hence no rows. Only id, text, language and the labels' three columns are read: other columns may
have any name.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import UPPER, body, materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS = 100, 80, 10
SPACES = "\t\n\x0b\x0c\r"
DUPLICATE = 1 << FILTERS.index("E")


def text_mask(text: Column, words: Column) -> Column:
    """The bits of A to D; ``words`` is the array of the text's words."""
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, UPPER, ""))
    odd = F.octet_length(F.translate(text, "#$%&*|", "")) < F.octet_length(text)
    fails = [F.size(words) < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DIFFERENT * F.size(words),
             100 * capitals > MOST_CAPITALS * F.length(text), odd]
    mask = F.lit(0)
    for i, fail in enumerate(fails):
        mask = mask.bitwiseOR(F.when(fail, 1 << i).otherwise(0))
    return mask


def masks(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``part, mask, good, toxic`` of every row of ``docs``."""
    text = body(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split(F.translate("t", SPACES, " " * len(SPACES)), " "), ""))
    rows = materialize(rows.select("id", "part", text_mask(F.col("t"), F.col("w")).alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest")),
                       "audit-masks")
    named = rows.where("id is not null")
    # Joined by id, not by text: a text that a third of the rows share is one row of ``first`` and no hot key.
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("least", F.lit(True))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    full = named.join(first, ["id", "digest"], "left").join(marks, "id", "left")
    twice = F.when(F.col("least").isNull(), DUPLICATE).otherwise(0)
    full = full.select("part", F.col("mask").bitwiseOR(twice).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"),
                       F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return full.unionByName(rows.where("id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def folded(orders: str = "orders") -> str:
    """SQL that folds one cell (``mask, n, good, toxic``) over the arrays of filter bits in ``orders``: 600 structs in a row."""
    fails, first = "(mask & f) <> 0", "acc.gone = 0"
    amount = {
        "kept": f"if({first} AND NOT {fails}, n, 0L)", "removed": f"if({first} AND {fails}, n, 0L)",
        "redundant": f"if(NOT {first} AND {fails}, n, 0L)", "unique_fails": "if(mask = f, n, 0L)",
        "good_lost": f"if({first} AND {fails}, good, 0L)", "toxic_lost": f"if({first} AND {fails}, toxic, 0L)",
    }
    step = ", ".join(f"'{k}', {amount[k]}" for k in COUNTS)
    kind = ", ".join(f"{k}: bigint" for k in COUNTS)
    start = f"named_struct('gone', 0, 'steps', CAST(array() AS array<struct<{kind}>>))"
    return (f"flatten(transform({orders}, o -> aggregate(o, {start}, (acc, f) -> named_struct('gone', acc.gone | (mask & f), "
            f"'steps', concat(acc.steps, array(named_struct({step})))), acc -> acc.steps)))")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order and step: ``part, filter_order, step`` and the counts of ``COUNTS``, then ``shapley``."""
    full = masks(docs, labels, id_col, text_col, part_col)
    cells = full.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    bits = F.array(*[F.array(*[F.lit(1 << FILTERS.index(f)) for f in o]) for o in ORDERS])
    cells = cells.withColumn("orders", bits).select("part", F.expr(folded()).alias("steps"))
    # At most 32 cells a part, so the list is bounded however many documents the part has.
    added = ", ".join(f"'{k}', l.{k} + r.{k}" for k in COUNTS)
    merged = cells.groupBy("part").agg(F.collect_list("steps").alias("cells")).select(
        "part", F.expr(f"aggregate(slice(cells, 2, 32), cells[0], (a, b) -> zip_with(a, b, (l, r) -> named_struct({added})))").alias("steps"))
    letters = F.array(*[F.lit(f) for o in ORDERS for f in o])

    def removed_by(x: str) -> Column:
        mine = F.zip_with("steps", letters, lambda s, f: F.when(f == x, s["removed"]).otherwise(0))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, b: a + b)

    total = F.map_from_arrays(F.array(*map(F.lit, FILTERS)), F.array(*map(removed_by, FILTERS)))
    each = merged.withColumn("totals", total).select("part", "totals", F.posexplode("steps").alias("at", "s"))
    order = F.element_at(F.array(*map(F.lit, ORDERS)), (F.col("at") / len(FILTERS)).cast("int") + 1)
    each = each.select("part", order.alias("filter_order"), (F.col("at") % len(FILTERS) + 1).cast("int").alias("step"), "s.*", "totals")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return each.select("part", "filter_order", "step", *COUNTS, F.element_at("totals", letter).alias("shapley"))
