"""Headline rules, mentions, pairs and resolution on hand-made cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from firmament import schemas as S
from firmament.functions import text as X
from firmament.operators import mentions as MN
from firmament.operators import news as NW
from firmament.operators import resolve as R
from firmament.operators import scoring as SC
from firmament.sources import extractor as E

NAMES = [
    ("ACM", 0, "The Acme Motors, Inc.", "Acme"),
    ("BOR", 1, "Borealis Power Corporation", None),
    ("DLF", 2, "Delta Foods Co.", "Delta Foods International"),
    ("ZED", 3, "Zed", None),
    ("MRK", 4, "Merck & Co.", "Merck"),
]
HEADLINES = {
    "Acme Motors to acquire Borealis Power": ("acquisition", [("ACM", "BOR")]),
    "Borealis Power partners with Acme Motors": ("partnership", [("ACM", "BOR")]),
    "Weekly roundup: Acme Motors to acquire Borealis Power": (None, []),
    "Sunrise Capital LLC Buys Acme Motors, Borealis Power": (None, []),
    "Acme Motors and Borealis Power report sales": (None, []),
    "Zed rivals Acme Motors": ("competitor", [("ACM", "ZED")]),
    "zed rivals Acme Motors": ("competitor", []),
    "Acme Motors-Umbrella joint venture with Borealis Power": ("partnership", []),
    "merger talk: (ACM) and Borealis Power": ("acquisition", [("ACM", "BOR")]),
    "Merck KGaA to acquire Acme Motors": ("acquisition", []),
    "Merck to acquire Acme Motors": ("acquisition", [("ACM", "MRK")]),
    "Acme, Borealis Power, Delta Foods, Zed, Merck in merger": ("acquisition", []),
    "Acme Motors " + "x" * 70 + " merger Borealis Power": ("acquisition", []),
    "Umbrella/Acme Motors merger with Borealis Power": ("acquisition", []),
    "Acme merger Borealis Power merger Acme Motors": ("acquisition", [("ACM", "BOR"), ("ACM", "BOR")]),
}


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(NAMES, "firm string, pos int, official_name string, variants string")


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame([(h, h) for h in HEADLINES], "article_id string, title string").withColumn(
        "date", F.lit("2010-01-01").cast("date"))


def test_edges_of_each_headline(articles, names):
    got = {}
    for r in MN.rule_edges(articles, names).collect():
        got.setdefault(r["headline"], []).append((r["ticker_a"], r["ticker_b"], r["relation"]))
    for h, (relation, pairs) in HEADLINES.items():
        assert got.get(h, []) == [(a, b, relation) for a, b in pairs], h


def test_patterns_equal_python_re(spark):
    """Needle tests and bindings change nothing against plain searches."""
    texts = list(HEADLINES) + [
        "Pre-Market Movers", "premarket", "an ETF", "netflix", "stake sale", "mistakes", "13F filing",
        "Jones Partners adds shares", "partners far away " + "y" * 50 + " buys", "teams up with", "buyout", "Buy-Out",
        "RIVAL", "rivalry", "awards big contract", "supply deal", "competes with", "price target", "line one\nfund buys",
        "fund\nbuys", "kapital K", "acquiſition", "éetf", "etfé", "", "ranked"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.is_junk(F.col("t")).alias("j"), X.classify(F.col("t")).alias("c"),
                    X.classify(F.col("t"), allow_rumors=False).alias("nr")).collect()
    for r in got:
        low = r["t"].lower()
        junk = any(re.search(p, low) for p in X.JUNK_PATTERNS) or bool(re.search(X.FUND_BUYER, r["t"], re.I))
        kind = next((k for k, p in X.RELATION_PATTERNS if re.search(p, r["t"], re.I)), None)
        assert (r["j"], r["c"]) == (junk, kind), r["t"]
        assert r["nr"] == (None if re.search(X.RUMOR, r["t"], re.I) else kind)


def test_mentions_equal_brute_force(spark, names, articles):
    """Spans and folds against one search per dictionary name."""
    long_, short = {}, {}
    for firm, _, official, variants in NAMES:
        bare = re.sub(r"^the\s+", "", official, flags=re.I)
        bare = re.sub(rf"(,?\s+({X.LEGAL_SUFFIX}))+$", "", bare, flags=re.I).strip()
        for v in [official, bare] + (variants.split("|") if variants else []):
            if len(v) >= 4 and v.lower() not in X.BLOCKED_NAMES:
                long_[v.lower()] = firm
            elif 2 <= len(v) <= 3:
                short[v] = firm

    def brute(h):
        taken = []

        def claim(s, e, f):
            if all(s >= e2 or e <= s2 for s2, e2, _ in taken):
                taken.append((s, e, f))

        for n in sorted(long_, key=len, reverse=True):
            for m in re.finditer(rf"\b{re.escape(n)}\b", h.lower()):
                bad = X.NAME_EXCLUSIONS.get(long_[n])
                if not (bad and re.match(rf"\s*({bad})", h.lower()[m.end():])):
                    claim(m.start(), m.end(), long_[n])
        for n, f in short.items():
            for m in re.finditer(rf"\b{re.escape(n)}\b", h):
                claim(m.start(), m.end(), f)
        for m in re.finditer(r"\(([A-Z]{1,5})\)", h):
            if m.group(1) in {x[0] for x in NAMES}:
                claim(m.start(), m.end(), m.group(1))
        return sorted(taken)

    got = {r["title"]: [(m["start"], m["stop"], m["firm"]) for m in r["mentions"]]
           for r in MN.find_mentions(articles.select("article_id", "title"), names).collect()}
    for h in HEADLINES:
        assert got.get(h, []) == brute(h), h


def test_name_lists(names):
    long_ = {r["name"]: r["firm"] for r in MN.long_names(names).collect()}
    assert long_["acme motors"] == "ACM" and long_["borealis power"] == "BOR" and "zed" not in long_
    assert "merck &" not in long_ and long_["merck"] == "MRK"
    assert {r["name"]: r["firm"] for r in MN.short_names(names).collect()} == {"Zed": "ZED"}


def test_resolution(spark, names):
    want = {"The Acme Motors, Inc.": "ACM", "Acme Motors Europe": "ACM", "Acme": "ACM", "Acmex": None, "": None,
            "Borealis": "BOR", "Foods": "DLF", "delta foods international holdings": "DLF", "Unknown Plc": None}
    df = spark.createDataFrame([(n,) for n in want], "name string")
    got = {r["name"]: r["firm"] for r in R.resolve_names(df, names).collect()}
    assert got == want


def test_edge_resolution_counts_ends(spark, names):
    e = spark.createDataFrame([("Acme", "Borealis Power"), ("Acme", "Nobody"), ("X", "Y")], "firm_a string, firm_b string")
    assert sorted(r["n_universe"] for r in R.resolve_edges(e, names).collect()) == [0, 1, 2]
    assert R.universe_edges(e, names).count() == 1


def test_scores(spark):
    rows = [("r", "p", True, "a", "a"), ("r", "p", True, "a", None), ("r", "q", False, None, "a"), ("r", "q", False, None, None),
            ("m", "p", True, "a", None), ("m", "q", False, None, None)]
    df = spark.createDataFrame(rows, "extractor string, panel string, has_relation boolean, true_type string, predicted string")
    got = {(r["extractor"], r["panel"]): r for r in SC.score(df).collect()}
    r = got["r", "all"]
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert got["m", "all"]["precision"] is None and got["m", "all"]["f1"] == 0 and got["m", "q"]["recall"] is None
    assert r["type_correct"] == "1/1" and got["m", "p"]["type_correct"] == "-"


def test_labels_parse(spark):
    df = spark.createDataFrame([("none",), (" None ",), ("acquisition: A-B",)], "label string")
    assert [(r["has_relation"], r["true_type"]) for r in SC.parse_labels(df).collect()] == [
        (False, None), (False, None), (True, "acquisition")]


def test_article_table(spark):
    rows = [("2010-01-02 00:00:00", "T", "B", "u1", None), ("2010-01-01 00:00:00", "T", "A", "u1", "P"),
            ("bad", "T", "A", "u9", "P"), ("2010-01-03 00:00:00", "Solo", "A", None, "Q"),
            ("2010-01-04 00:00:00", None, "A", "u2", "Q"), ("2010-01-05 00:00:00", "T", "ZZ", "u3", "Q"),
            ("2020-12-31 10:00:00", "Late", "A", "u4", "Q"), ("2020-12-31 00:00:00", "Edge", "A", "u5", "Q")]
    raw = spark.createDataFrame(rows, "Date string, Article_title string, Stock_symbol string, Url string, Publisher string")
    kept = NW.filter_news(raw, spark.createDataFrame([("A",), ("B",)], "firm string"))
    got = {r["article_id"]: r for r in NW.article_table(kept, ["Date", "Stock_symbol"]).collect()}
    assert set(got) == {"u1", "Solo", "u5"}
    assert got["u1"]["tickers"] == ["A", "B"] and got["u1"]["publisher"] == "P" and got["u1"]["n_tickers"] == 2
    assert str(got["u1"]["date"]) == "2010-01-01 00:00:00"


def test_news_times_do_not_depend_on_the_session_zone(spark):
    want = {"2010-07-01": "2010-07-01 00:00:00", "2010-07-01 12:00:00": "2010-07-01 12:00:00", "x": None,
            "2010-07-01 12:00:00 UTC": "2010-07-01 12:00:00", "2010-07-01 12:00:00+02:00": "2010-07-01 10:00:00"}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = {r["t"]: r["u"] for r in df.select("t", NW.utc_time(F.col("t")).alias("u")).collect()}
            assert {k: None if v is None else str(v) for k, v in got.items()} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_candidates(spark, names, articles):
    tagged = articles.withColumn("tickers", F.when(F.col("title").startswith("Zed"), F.array(F.lit("ACM"), F.lit("QQQ")))
                                 .otherwise(F.array(F.lit("ACM"), F.lit("BOR"))))
    got = {r["title"] for r in MN.candidates(tagged, names.select("firm"), names).collect()}
    assert "Zed rivals Acme Motors" not in got and "zed rivals Acme Motors" in got


def test_extractor_cache(spark, articles, tmp_path):
    """A warm cache asks nothing; a failing batch stays uncached; nothing found is remembered."""
    path = str(tmp_path / "cache")

    def failing(headlines):
        if any("Zed" in h for h in headlines):
            raise RuntimeError("no answer")
        return E.pattern_extractor(headlines)

    def never(headlines):
        raise AssertionError("called with a warm cache")

    cache = E.extract(E.uncached(articles, None), failing, batch_size=1)
    assert cache.count() == len(HEADLINES) - sum("Zed" in h for h in HEADLINES)
    assert cache.where(F.size("relations") == 0).count() > 0
    first = E.run_cached(articles, path).count()
    assert E.run_cached(articles, path, never).count() == first > 0
    key = articles.select("title", X.cache_key(F.col("title")).alias("k")).first()
    assert key["k"] == hashlib.sha1(key["title"].encode()).hexdigest()[:16]
    assert E.numbered_prompt(["a", "b"]) == "0. a\n1. b"


def test_failed_batches_are_kept_with_their_error_and_tried_again(spark, articles, tmp_path):
    cache = E.Cache(spark, str(tmp_path / "cache"))

    def failing(headlines):
        if any("Zed" in h for h in headlines):
            raise RuntimeError("no answer")
        return E.pattern_extractor(headlines)

    n = cache.add(E.attempts(E.uncached(articles, cache.read()), failing, batch_size=1))
    lost = {r["key"]: (r["error"], r["seq"]) for r in cache.failed().collect()}
    assert n == len(lost) == sum("Zed" in h for h in HEADLINES) and set(lost.values()) == {("RuntimeError: no answer", 0)}
    assert {r["key"] for r in E.uncached(articles, cache.read()).collect()} == set(lost)
    assert cache.add(E.attempts(E.uncached(articles, cache.read()), batch_size=1, seq=1)) == 0
    assert cache.failed().isEmpty() and E.uncached(articles, cache.read()).isEmpty()


def test_repeated_runs_do_not_grow_lookups(spark, articles, tmp_path):
    cache = E.Cache(spark, str(tmp_path / "cache"))
    todo = E.uncached(articles, None)
    for seq in range(7):
        cache.add(E.attempts(todo, lambda hs, s=seq: [{"headline_id": i, "firm_a": f"run{s}", "firm_b": "b", "relation": "r", "rumor": False}
                                                      for i in range(len(hs))], seq=seq))
        assert cache.read().count() <= E.Cache.STALE * todo.count() and cache.read().select("key").distinct().count() == todo.count()
        assert {r["relations"][0]["firm_a"] for r in E.latest(cache.read()).collect()} == {f"run{seq}"}
    assert cache.generation() == 3


def test_last_cached_answer_wins(spark):
    r = [("k", [("A", "B", "supplier", False)], 0), ("k", [("C", "D", "competitor", True)], 1)]
    df = spark.createDataFrame(r, E.S.CACHE)
    assert E.latest(df).first()["relations"][0]["firm_a"] == "C"


def test_pilot_is_reproducible(articles):
    a = [r["article_id"] for r in MN.pilot(articles, 4).collect()]
    assert a == [r["article_id"] for r in MN.pilot(articles.repartition(5), 4).collect()] and len(a) == 4


def test_spans_hold_every_match_of_a_name_and_no_lone_separator(spark):
    texts = ["Acme & Co. buys A-B", " (IBM)  and Acme & Co.", "", "...", "Zed", "caf\u00e9 A-B/A-B caf\u00e9s", "a  b   c"]
    known = ["Acme", "Acme & Co", "A-B", "IBM", "Zed", "caf\u00e9", "a  b"]
    names = spark.createDataFrame([(n,) for n in known], "name string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = X.boundary_spans(df, "t", X.piece_counts(names)).collect()
    got = {(r["i"], r["start"], r["stop"]) for r in rows if r["span"] in known}
    want = {(i, m.start(), m.start() + len(n)) for i, t in enumerate(texts) for n in known
            for m in re.finditer(rf"\b(?={re.escape(n)}\b)", t)}
    assert got == want
    assert all(re.search(r"\w", r["span"]) and texts[r["i"]][r["start"]:r["stop"]] == r["span"] for r in rows)


def test_names_are_met_by_one_word_where_spans_meet_them(spark):
    texts = [(1, 0, "house of acme buys acme, inc. (acme-north) and acme"), (2, 0, "(acme) north acme north"), (3, 0, "acme north north acme"),
             (4, 1, "acme V1 north"), (5, 0, None), (6, 0, "été acme\u00e9 acme north."), (7, 0, "- acme -")]
    names = spark.createDataFrame([("acme", 1, 0), ("house of acme", 2, 0), ("acme north", 3, 0), ("acme, inc.", 4, 0), ("---", 5, 0), ("V1", 6, 1)],
                                  "name string, firm int, rank int")
    df = spark.createDataFrame(texts, "id int, rank int, text string")
    met = X.name_spans(df, names, ["rank"])
    cut = X.boundary_spans(df, "text", X.piece_counts(names)).join(names.withColumnRenamed("name", "span"), ["rank", "span"])
    cols = ["id", "rank", "span", "firm", "start", "stop"]
    assert sorted(map(tuple, met.select(*cols).collect())) == sorted(map(tuple, cut.select(*cols).collect())) != []


def test_headlines_of_a_frame_go_back_together(spark):
    """Each call of the extractor gets a batch; the answers of a frame are one frame, errors only those of their batch."""
    titles = spark.createDataFrame([(str(i), f"t{i}") for i in range(45)], "key string, title string").coalesce(1)
    seen = {}

    class Frames:
        def mapInPandas(self, call, schema):
            pdf = titles.toPandas()
            seen["frames"] = list(call(iter([pdf])))

        def select(self, *cols):
            return self

    def extractor(headlines):
        if "t25" in headlines:
            raise ValueError("no")
        return [{"headline_id": 0, "firm_a": headlines[0], "firm_b": "b", "relation": "r", "rumor": False}]

    E.attempts(Frames(), extractor)
    frame, = seen["frames"]
    assert list(frame["key"]) == [str(i) for i in range(45)]
    assert [i for i, e in enumerate(frame["error"]) if e] == list(range(20, 40)) and frame["relations"][21] is None
    assert [i for i, r in enumerate(frame["relations"]) if r] == [0, 40]
    rows = E.attempts(titles, extractor).collect()
    assert len(rows) == 45 and sum(r["error"] is None for r in rows) == 25


def test_patterns_run_where_their_words_can_occur():
    stated = ["Acme rivals Bolt", "Acme \u017fupplier Bolt", "Acme teams up with Bolt", "Acme to buy-out Bolt", "Acme and Bolt report"]
    got = {r["headline_id"]: r["relation"] for r in E.pattern_extractor(stated)}
    assert got == {0: "competitor", 1: "supplier", 2: "partnership", 3: "acquisition"}


def test_last_relation_of_every_headline(spark):
    two = [{"firm_a": "a", "firm_b": "b", "relation": x, "rumor": False} for x in ("supplier", "competitor")]
    articles = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y"), ("4", None), ("5", "z")], "article_id string, title string").withColumn("date", F.lit("d"))
    keys = {r["title"]: r["key"] for r in articles.select("title", X.cache_key(F.col("title")).alias("key")).collect()}
    cache = spark.createDataFrame([(keys["x"], two[:1], 0), (keys["x"], two, 1), (keys["y"], [], 0), (keys["z"], two[:1], 0)], S.CACHE)
    got = sorted(map(tuple, E.last_relations(articles, cache).collect()))
    assert got == [("1", "competitor"), ("2", "competitor"), ("5", "supplier")]
    by_title = SC.last_relation(E.model_edges(articles, cache), "ord").join(articles.withColumnRenamed("title", "headline"), "headline")
    assert sorted(map(tuple, by_title.select("article_id", "relation").collect())) == got
