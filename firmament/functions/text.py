"""Headline predicates and name cleaning as column expressions.

Patterns keep Python's reading of ``\\b``, ``\\s`` and ``.``: Unicode word
characters and only a newline ending a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.functions.scalars import let
from firmament.session import materialize

FLAGS = "(?iUd)"

# The headline patterns, name lists and limits the results depend on.
JUNK_PATTERNS = [
    r"earnings scheduled", r"week ahead", r"roundup", r"primer", r"pre-?market", r"mid-?morning",
    r"market in 5 minutes", r"wall street breakfast", r"movers", r"ranked", r"price target", r"\betf\b",
    r"podcast", r"13f", r"\bstakes?\b", r"to advise on", r"advisor to", r"advising",
]
# Text that must occur (in lower case) for a pattern to have a chance.
JUNK_NEEDLES = {
    r"pre-?market": ["market"], r"mid-?morning": ["morning"], r"\betf\b": ["etf"], r"\bstakes?\b": ["stake"],
}
FUND_NEEDLES = ["buys", "sells", "adds", "trims"]
RELATION_NEEDLES = {
    "acquisition": ["acquir", "merge", "takeover", "buy"],
    "partnership": ["partner", "joint venture", "team", "alliance with", "collaborat"],
    "supplier": ["suppl", "award", "contract"],
    "competitor": ["rival", "compet", "price war"],
}
FUND_BUYER = (r"\b(management|partners|capital|advisors|investments?|fund|llc|ltd)\b"
              r".{0,40}\b(buys|sells|adds|trims)\b")
RELATION_PATTERNS = [
    ("acquisition", r"acquir|merger|merges? with|takeover|buy-?out"),
    ("partnership", r"partner(s|ship|ing)? with|joint venture|teams? up with|alliance with|collaborat"),
    ("supplier", r"supplier|supply (deal|agreement|contract)|awards? .{0,30}contract|contract with"),
    ("competitor", r"\brivals?\b|competitors?|competes? with|price war"),
]
RUMOR = r"in talks|reportedly|rumor"
RELATIONS = ["supplier", "customer", "competitor", "acquisition", "partnership"]
BLOCKED_NAMES = ["southern", "gap", "merck &", "deere &"]
NAME_EXCLUSIONS = {"MRK": r"kgaa|darmstadt", "JNPR": r"pharmaceutical"}
LEGAL_SUFFIX = r"incorporated|inc\.?|corporation|corp\.?|company|co\.?|ltd\.?|plc|llc|l\.p\.|group"
RESOLVE_SUFFIX = (r"inc|inc\.|incorporated|corp|corp\.|corporation|co|co\.|company|ltd|ltd\.|plc|llc|lp|l\.p\.|"
                  r"group|holdings?|nv|n\.v\.|sa|s\.a\.|ag")
MAX_GAP = 60
MAX_FIRMS = 4
HYPHEN_LOOK = 30


def _folded(low: Column) -> Column:
    """Lower-cased text with the two letters folded that only case-insensitive matching folds."""
    return F.replace(F.replace(low, F.lit("\u017f"), F.lit("s")), F.lit("\u212a"), F.lit("k"))


def _any(text: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | text.contains(n)
    return hit


def is_junk(headline: Column) -> Column:
    """Substring tests decide most texts; a pattern runs only where its needle occurs."""

    def test(text, low):
        hit = _any(low, [p for p in JUNK_PATTERNS if p not in JUNK_NEEDLES])
        for pattern, needles in JUNK_NEEDLES.items():
            hit = hit | (_any(low, needles) & low.rlike("(?Ud)" + pattern))
        fund = let(_folded(low), lambda f: _any(f, FUND_NEEDLES))
        return hit | (fund & text.rlike(FLAGS + FUND_BUYER))

    return let(headline, lambda text: let(F.lower(text), lambda low: test(text, low)))


def classify(headline: Column, allow_rumors: bool = True) -> Column:
    """First relation type whose pattern occurs, else NULL."""

    def first(text, folded):
        found = F.lit(None).cast("string")
        for relation, pattern in reversed(RELATION_PATTERNS):
            chance = _any(folded, RELATION_NEEDLES[relation])
            found = F.when(chance & text.rlike(FLAGS + pattern), relation).otherwise(found)
        return found if allow_rumors else F.when(~text.rlike(FLAGS + RUMOR), found)

    return let(headline, lambda text: let(_folded(F.lower(text)), lambda folded: first(text, folded)))


def clean_name(name: Column) -> Column:
    """Official name without a leading 'The', a trailing '(The)' and legal suffixes."""
    bare = F.regexp_replace(name, FLAGS + r"\s*\(the\)\s*$", "")
    bare = F.regexp_replace(bare, FLAGS + r"^the\s+", "")
    return F.trim(F.regexp_replace(bare, FLAGS + rf"(,?\s+({LEGAL_SUFFIX}))+$", ""))


def clean_mention(name: Column) -> Column:
    """A company name as written, reduced to what is matched against the dictionary."""
    bare = F.regexp_replace(F.lower(F.trim(name)), FLAGS + r"^the\s+", "")
    bare = F.regexp_replace(bare, FLAGS + rf"([,\s]+({RESOLVE_SUFFIX}))+$", "")
    return F.regexp_replace(bare, r"""^[ .,'"]+|[ .,'"]+$""", "")


def word_pieces(text: Column) -> Column:
    """The text cut at every word boundary."""
    return F.filter(F.split(text, r"(?U)\b", -1), lambda p: p != "")


def boundary_spans(texts: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """Adds ``start``, ``stop``, ``span``: substrings with a word boundary at both ends.

    These are exactly the strings ``\\bname\\b`` can match for a name with a word character in it, so a dictionary is
    matched by equality on ``span`` instead of one search per name. ``sizes`` are the numbers of pieces the dictionary's
    names have; other spans cannot match. Pieces are words and separators in turn, so only single pieces can be separators
    alone; they are left out. The spans of a text are made in one array and only they are exploded.
    """
    keep = texts.columns
    cut = texts.withColumn("_p", word_pieces(F.col(text))).where(F.size("_p") > 0)
    ends = F.aggregate("_p", F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
    word, n = r"(?U)\w", F.size("_p")
    cut = cut.withColumns({
        "_e": ends, "_first": F.when(F.element_at("_p", 1).rlike("^" + word), 0).otherwise(1),
        "_last": F.when(F.element_at("_p", -1).rlike(word + "$"), n).otherwise(n - 1)})

    def from_piece(i: Column) -> Column:
        fits = F.filter(F.lit(sizes), lambda k: (i + k <= F.col("_last")) & ((k > 1) | ((i - F.col("_first")) % 2 == 0)))
        return F.transform(fits, lambda k: F.struct(F.get("_e", i).alias("start"), F.get("_e", i + k).alias("stop")))

    starts = F.when(F.col("_first") < n, F.sequence("_first", n - 1))
    cut = cut.withColumn("_s", F.flatten(F.transform(starts, from_piece)))
    spans = F.transform("_s", lambda s: s.withField("span", F.substring(F.col(text), s["start"] + 1, s["stop"] - s["start"])))
    return cut.select(*keep, F.explode(spans).alias("_s")).select(*keep, "_s.start", "_s.stop", "_s.span")


def name_spans(texts: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """``names`` joined to the places of ``texts`` where they stand, with ``span``, ``start`` and ``stop``; the text is left out.

    The places are those of ``boundary_spans``. Only texts and names equal in ``by`` meet. A name is looked up by one word of
    its own, the one that the fewest names have: a text gives one row per word and not one per span, and the name is compared
    where its word was met.
    """
    listed = names.select(*by, "name").distinct().withColumn("_p", word_pieces(F.col("name")))
    words = listed.select(*by, "name", F.size("_p").alias("_k"), F.posexplode("_p").alias("_o", "_w")).where(F.col("_w").rlike(r"^(?U)\w"))
    usual = words.groupBy(*by, "_w").agg(F.count("*").alias("_n"))
    rarest = words.join(usual, [*by, "_w"]).groupBy(*by, "name").agg(F.min_by(F.struct("_w", "_o", "_k"), F.struct("_n", "_o")).alias("_a"))
    anchored = materialize(names.join(rarest, [*by, "name"]).select(*names.columns, "_a._w", "_a._o", "_a._k"), "anchors")
    met = (
        texts.select(*texts.columns, F.posexplode_outer(word_pieces(F.col("text"))).alias("_j", "_w"))  # outer: cut once, no filter cuts it again
        .join(anchored.withColumnRenamed("name", "span"), [*by, "_w"])
        .withColumns({"_p": word_pieces(F.col("text")), "_i": F.col("_j") - F.col("_o")})
    )
    n, word = F.size("_p"), r"(?U)\w"
    first = F.when(F.element_at("_p", 1).rlike("^" + word), 0).otherwise(1)
    last = F.when(F.element_at("_p", -1).rlike(word + "$"), n).otherwise(n - 1)
    inside = met.where((F.col("_i") >= first) & (F.col("_i") + F.col("_k") <= last))
    same = inside.where(F.array_join(F.slice("_p", F.col("_i") + 1, F.col("_k")), "") == F.col("span"))
    at = F.length(F.array_join(F.slice("_p", 1, F.col("_i")), ""))
    kept = [c for c in texts.columns if c != "text"]
    return same.withColumn("start", at).select(
        *kept, "span", *[c for c in names.columns if c not in ("name", *by)], "start", (F.col("start") + F.length("span")).alias("stop"))


def piece_counts(names: DataFrame, name: str = "name") -> list[int]:
    """The distinct numbers of pieces among a dictionary's names (a handful of small integers)."""
    return sorted(r[0] for r in names.select(F.size(word_pieces(F.col(name)))).distinct().collect()) or [1]


def cache_key(headline: Column) -> Column:
    return F.substring(F.sha1(headline.cast("binary")), 1, 16)
