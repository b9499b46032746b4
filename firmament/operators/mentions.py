"""Company mentions in headlines and the pairs they form.

The dictionary is a DataFrame. The words of a headline are joined by equality to
the rarest word of each name, whatever the dictionary's size, and the name is
compared where that word meets; Spark broadcasts the dictionary when its measured
size allows and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmament.functions.text import (
    BLOCKED_NAMES, FLAGS, HYPHEN_LOOK, MAX_FIRMS, MAX_GAP, NAME_EXCLUSIONS,
    classify, clean_name, is_junk, name_spans,
)

from firmament.session import materialize


def _written_forms(names: DataFrame) -> DataFrame:
    """Every written form of every firm, in dictionary order."""
    forms = F.concat(F.array("official_name", clean_name(F.col("official_name"))),
                     F.coalesce(F.split("variants", r"\|"), F.array()))
    return (
        names.select("firm", "pos", F.posexplode(forms).alias("slot", "form"))
        .select("firm", F.struct("pos", "slot").alias("at"), F.trim("form").alias("form"))
    )


def long_names(names: DataFrame) -> DataFrame:
    """``(name, firm, ord)``: lower-cased names of four or more characters.

    A name listed twice belongs to its last firm but keeps its first place.
    """
    f = _written_forms(names).withColumn("name", F.lower("form"))
    return (
        f.where((F.length("name") >= 4) & ~F.col("name").isin(BLOCKED_NAMES))
        .groupBy("name").agg(F.max_by("firm", "at").alias("firm"), F.min("at").alias("ord"))
    )


def short_names(names: DataFrame) -> DataFrame:
    """Two- and three-character names, matched with their case."""
    return (
        _written_forms(names).where(F.length("form").between(2, 3) & ~F.lower("form").isin(BLOCKED_NAMES))
        .groupBy(F.col("form").alias("name")).agg(F.max_by("firm", "at").alias("firm"), F.min("at").alias("ord"))
    )


def _hits(articles: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Occurrences of the names of ``dictionary`` (``name, firm, ord, rank``), the names of rank 0 in the lower-cased title."""
    title = F.col("title")
    texts = F.array(F.struct(F.lit(0).alias("rank"), F.lower(title).alias("text")), F.struct(F.lit(1).alias("rank"), title.alias("text")))
    bracketed = F.concat(texts, F.array(F.struct(F.lit(2).alias("rank"), title.alias("text"))))
    read = articles.select("article_id", F.explode_outer(F.when(title.contains("("), bracketed).otherwise(texts)).alias("_t"))
    return name_spans(read.select("article_id", "_t.rank", "_t.text"), dictionary, ["rank"])


def find_mentions(articles: DataFrame, names: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """``(article_id, title, mentions)`` for headlines naming at least one firm.

    ``articles`` needs ``(article_id, title)``; ``names`` is ``(firm, pos,
    official_name, variants)``. Long names claim their span first, then short
    ones, then tickers in parentheses, and an overlapping later claim is dropped.
    Claims are settled per headline, so a group is no larger than one headline.
    """
    tickers = names.select(F.col("firm").cast("string").alias("name"), "firm", F.struct("pos", F.lit(0).alias("slot")).alias("ord")) \
        if tickers is None else tickers
    barred = F.lit(False)
    for firm, pattern in NAME_EXCLUSIONS.items():
        barred = barred | ((F.col("firm").cast("string") == firm)
                           & F.expr("substring(lower(title), stop + 1)").rlike(FLAGS + rf"^\s*({pattern})"))
    listed = (
        long_names(names).withColumn("rank", F.lit(0)).unionByName(short_names(names).withColumn("rank", F.lit(1)))
        .unionByName(tickers.where(F.col("name").rlike("^[A-Z]{1,5}$")).select("name", "firm", "ord", F.lit(2).alias("rank")))
    )
    hits = materialize(_hits(articles, materialize(listed, "names-listed")), "hits")  # written: its size tells how to join it
    enclosed = (F.expr("substring(title, start, 1)") == "(") & (F.expr("substring(title, stop + 1, 1)") == ")")
    claims = (
        hits.join(articles.select("article_id", "title"), "article_id")
        .withColumn("barred", (F.col("rank") == 0) & barred)
        .where((F.col("rank") < 2) | ((F.col("start") > 0) & enclosed))
        .withColumns({"start": F.when(F.col("rank") == 2, F.col("start") - 1).otherwise(F.col("start")),
                      "stop": F.when(F.col("rank") == 2, F.col("stop") + 1).otherwise(F.col("stop"))})
    )
    ranked = F.struct(
        "rank", F.when(F.col("rank") == 0, -F.length("span")).otherwise(0).alias("len"), "ord", "start",
        "stop", "span", "firm", "barred")
    settled = claims.groupBy("article_id", "title").agg(F.sort_array(F.collect_list(ranked)).alias("claims"))
    return settled.select("article_id", "title", _settle("claims").alias("mentions")).where(F.size("mentions") > 0)


def _settle(claims: str) -> Column:
    """Fold ranked claims into the accepted, non-overlapping ones, by start.

    The matches of one name are read left to right, so a match beginning inside
    the previous match of the same name does not exist.
    """
    spans = f"transform({claims}, c -> named_struct('start', c.start, 'stop', c.stop, 'firm', c.firm))"
    return F.expr(f"""
        array_sort(aggregate({claims},
          named_struct('kept', filter({spans}, c -> false), 'rank', -1, 'span', '', 'upto', -1),
          (acc, c) -> CASE
            WHEN acc.rank = c.rank AND acc.span = c.span AND c.start < acc.upto THEN acc
            ELSE named_struct(
              'kept', CASE
                 WHEN c.barred OR exists(acc.kept, k -> c.start < k.stop AND c.stop > k.start) THEN acc.kept
                 ELSE concat(acc.kept, array(named_struct('start', c.start, 'stop', c.stop, 'firm', c.firm))) END,
              'rank', c.rank, 'span', c.span, 'upto', c.stop) END,
          acc -> acc.kept))
    """)


def _spoken_for() -> str:
    """Hyphen- or slash-joined to a capitalised word that is no mention itself."""
    after = f"substring(title, m.stop + 1, {HYPHEN_LOOK})"
    before = (f"substring(title, greatest(m.start - {HYPHEN_LOOK}, 0) + 1, "
              f"m.start - greatest(m.start - {HYPHEN_LOOK}, 0))")
    right = rf"regexp_extract({after}, r'(?U)^[-/]\s*([A-Z][A-Za-z&.]+)', 0)"
    left = rf"regexp_extract({before}, r'(?U)([A-Z][A-Za-z&.]+)\s*[-/]$', 0)"
    return f"""(
      (length({right}) > 0 AND NOT exists(mentions,
          o -> o.start >= m.stop AND o.start < m.stop + length({right}) + 1))
      OR (length({left}) > 0 AND NOT exists(mentions,
          o -> o.start >= m.start - length({left}) AND o.start < m.start)))"""


def pair_mentions(mentions: DataFrame) -> DataFrame:
    """Adjacent, nearby, unspoken-for mentions as sorted firm pairs (repeats kept)."""
    kept = mentions.where(F.size("mentions") <= MAX_FIRMS).withColumn(
        "kept", F.expr(f"filter(mentions, m -> NOT {_spoken_for()})"))
    pairs = F.expr(f"""
        filter(transform(slice(kept, 1, greatest(size(kept) - 1, 0)), (m, i) -> named_struct(
            'a', least(m.firm, kept[i + 1].firm), 'b', greatest(m.firm, kept[i + 1].firm),
            'gap', kept[i + 1].start - m.stop)),
          p -> p.a <> p.b AND p.gap <= {MAX_GAP})""")
    return kept.select("article_id", "title", "mentions", pairs.alias("pairs"))


def typed_headlines(articles: DataFrame, allow_rumors: bool = True) -> DataFrame:
    """Headlines that are no junk and state a relation; the cheap test comes first."""
    t = F.col("title")
    return articles.where(t.isNotNull() & ~is_junk(t)).withColumn(
        "relation", classify(t, allow_rumors)).where(F.col("relation").isNotNull())


def rule_edges(articles: DataFrame, names: DataFrame, allow_rumors: bool = True) -> DataFrame:
    """``(article_id, date, ticker_a, ticker_b, relation, headline)``: one row per pair found."""
    typed = materialize(typed_headlines(articles, allow_rumors), "typed")  # read once per dictionary below
    found = pair_mentions(find_mentions(typed.select("article_id", "title"), names))
    pairs = materialize(found.select("article_id", F.explode("pairs").alias("p")), "pairs")
    return (
        typed.join(pairs, "article_id")
        .select("article_id", "date", F.col("p.a").alias("ticker_a"), F.col("p.b").alias("ticker_b"),
                "relation", F.col("title").alias("headline"))
    )


def candidates(articles: DataFrame, universe: DataFrame, names: DataFrame, min_tags: int = 2) -> DataFrame:
    """Articles tagged with two or more universe firms whose title names at least one.

    Tags are counted by a semi join on exploded tags, so the universe is never
    turned into a literal list.
    """
    tagged = (
        articles.select("article_id", F.explode("tickers").alias("firm"))
        .join(universe.select("firm"), "firm", "left_semi")
        .groupBy("article_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_tags)
    )
    pool = articles.join(tagged, "article_id", "left_semi")
    pool = materialize(pool, "pool")
    named = find_mentions(pool.where(F.col("title").isNotNull()).select("article_id", "title"), names)
    return pool.join(named.select("article_id"), "article_id", "left_semi")


def pilot(articles: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A reproducible random pilot of ``n`` headlines."""
    return articles.orderBy(F.xxhash64("article_id", F.lit(seed)), "article_id").limit(n)
