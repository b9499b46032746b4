"""Fill-in-the-middle, url templates and the filter audit against brute force, and on odd rows."""

import collections
import hashlib
import itertools
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from firmament.llm import common, fill_middle, filter_audit, oracle, queries, url_templates  # noqa: E402
from test_queries import duck, table  # noqa: E402, F401

LONG = " ".join(f"word{i}\t x" for i in range(40_000))
ODD = [None, "", " ", "\t \n", "one", " one two ", "a <P> b", "<S>", "ünï  çödé \u3000x", "a\x0bb\x0cc", "x\xa0y", LONG, "<", "<<P <S <M", "日本 語"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts under several ids, a repeated row, rows without id, columns of clashing names."""
    rows = [(i * 100 + j, t, "x", 1, "q") for i, t in enumerate(ODD) for j in range(7)] + [(3, "one", "x", 1, "q")] * 2 + [(None, "no id", None, 1, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, form string")


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):  # noqa: F811
    res = duck.execute(oracle.ORACLES[name])
    df = queries.QUERIES[name](spark, sf_dir)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([c[0] for c in res.description], res.fetchall())


# ---- fill in the middle --------------------------------------------------------

@pytest.mark.parametrize("kind,positions", [
    (fill_middle.ARRAY, np.arange(0, 9000, 7)), (fill_middle.BITMAP, np.arange(0, 65536, 3)), (fill_middle.RUNS, np.r_[5:40000, 40100:65536]),
    (None, np.r_[3, 70_000:90_000, 131_072:200_000:2, 1 << 31, (1 << 32) - 1]), (None, np.zeros(0))])
def test_boundary_set_selects_what_was_put_in(kind, positions):
    s = fill_middle.BoundarySet(positions)
    assert len(s) == len(positions) and (kind is None or s.containers[0][0] == kind)
    assert [s.select(k) for k in range(0, len(s), 11)] == positions[::11].tolist()
    with pytest.raises(IndexError):
        s.select(len(s))


def brute_fim(doc_id, text):
    t = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not t or any(m in t for m in fill_middle.MARKS) or h3 % 100 >= 50:
        return len(units), "plain", None, None, t
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_brute_force(odd):
    out = fill_middle.fill_in_middle(odd).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=str)
    assert got == sorted(((r.doc_id, *brute_fim(r.doc_id, r.text)) for r in odd.collect()), key=str)
    assert all(r.back == r.text for r in out) and {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(odd.where("false")).isEmpty()


# ---- filter audit --------------------------------------------------------------

def brute_audit(docs, labels):
    least, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    fails, parts = [], set()
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
             "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((part or "", {k for k, v in f.items() if v}, i is not None and i in good, i is not None and i in toxic))
        parts.add(part or "")
    out = collections.defaultdict(lambda: [0] * 6)
    shapley = collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in parts:
            for k in range(5):
                out[part, order, k + 1]
        for part, f, g, x in fails:
            gone = False
            for k, c in enumerate(order):
                o = out[part, order, k + 1]
                here = c in f
                o[0] += not gone and not here
                o[1] += not gone and here
                o[2] += gone and here
                o[3] += f == {c}
                o[4] += not gone and here and g
                o[5] += not gone and here and x
                shapley[part, c] += not gone and here
                gone |= here
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark, sf_dir, odd):
    some = [(r.doc_id, r.text, r.lang) for r in common.table(spark, sf_dir, "documents").limit(60).collect()]
    rows = some + [(i + 5000, t, "en") for i, t, _ in some[:9]] + [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    marks = [(i, k % 2, k % 3 % 2) for k, (i, _, _) in enumerate(some)] + [(some[0][0], 1, 1), (None, 1, 1), (300, None, 1), (77777, 1, 1)]
    docs = spark.createDataFrame([(*r, True, b"") for r in rows], "doc_id long, text string, lang string, mask boolean, digest binary")
    labels = spark.createDataFrame([(*m, "z") for m in marks], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(docs, labels)
    assert {tuple(r) for r in got.collect()} == brute_audit(rows, marks) and got.count() == 600 * len({p or "" for _, _, p in rows})
    assert filter_audit.audit(docs.where("false"), labels).isEmpty()
    assert filter_audit.audit(docs, labels.where("false")).where("good_lost + toxic_lost > 0").isEmpty()


# ---- url filters ---------------------------------------------------------------

def brute_url(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1].translate(str.maketrans(common.UPPER, common.LOWER)), m[2]) if m else ("", "")
    fit = [(h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit, key=lambda f: len(f[0])) if fit else (None, None)))


def test_hosts_paths_and_rules_equal_brute_force(spark, sf_dir):
    urls = [None, "", "no scheme", "http://", "://x/y", "HTTP://WWW.Example.NET/EN/", "http://example.net/en/x?q=/de/", "http://example.net/en",
            "http://net/", "http://planet/", "http://x.net", "http://x.net?/", "ftp://a:80/p#f", "http://a.org/fr/b/c//d/", "http://ÄB.org/fr/ü",
            "http://a.example.com/de/1", "http://badexample.com/de/1", "http://x/a\nb", "x://y://z", "http://h/" + "s/" * 40_000]
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url").union(spark.createDataFrame([(-i, u) for i, u in enumerate(urls)] * 2, "page_id long, url string"))
    pages = pages.withColumns({"host": F.lit(1), "rule": F.lit(2), "n": F.lit("x"), "raw": F.lit(0)})
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in url_templates.url_verdicts(pages, queries.URL_RULES).collect())
    assert got == collections.Counter((r.page_id, *brute_url(r.url)) for r in pages.collect())
    assert url_templates.url_verdicts(pages.where("false"), queries.URL_RULES).isEmpty()
    assert url_templates.url_verdicts(pages, []).where("verdict <> 'allow' or rule is not null").isEmpty()


def test_templates_generalise_merge_and_reject(spark):
    """In one site: articles by number in two sections, a spam section of single slugs, an unlabelled sibling of it."""
    rows = []
    for i in range(400):
        rows += [(f"http://site.x/news/{i}.html", 0), (f"http://site.x/sport/{i * 7}.html", 0 if i % 2 else None)]
        rows += [(f"http://site.x/win/slug{'abcdefghij'[i % 10]}-{'klmnopqrst'[i // 40]}-{i}/now", 1 if i < 200 else None)]
    rows += [(f"http://spam.x/p/{i}", 1) for i in range(50)] + [("http://spam.x/q", None), ("http://new.x/q/1", None)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    seen = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows) if b is not None], "page_id long, bad int")
    got = [r.verdict for r in url_templates.url_verdicts(pages, [], seen).orderBy("page_id").collect()]
    assert all(v == ("block" if "/win/" in u or "spam.x" in u else "allow") for v, (u, _) in zip(got, rows, strict=True))
    host, path = url_templates.url_parts(F.col("url"))
    shaped = pages.select("page_id", host.alias("host"), url_templates.shaped(path).alias("segs")).join(seen, "page_id", "left")
    tree = {r.raw: r for r in url_templates.templates(shaped.select("host", "segs", "bad")).collect()}
    assert tree["news/{n}.html"].template == tree["sport/{n}.html"].template == "news|sport/{n}.html"
    slugs = {r.template for raw, r in tree.items() if raw.startswith("win/")}
    assert slugs == {"win/*/now"} and tree["win/sluga-k-{n}/now"].share > 0.9


def test_a_node_keeps_few_names():
    kids = [{"seg": f"s{i}", "n": 100 - i, "lab": 10, "bad": 10 * (i % 2), "next": [0, 100 - i, 0, 0, 0]} for i in range(60)]
    names = url_templates.merged_branches([*kids, {"seg": "*", "n": 500, "lab": 0, "bad": 0, "next": [500, 0, 0, 0, 0]}])
    assert names["*"] == "*" and len(set(names.values())) == 3 and names["s0"] == names["s2"] != names["s1"] == names["s3"]
