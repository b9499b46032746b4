"""Each operator against a brute-force version on small rows, and on null, empty, repeated and missing ones."""

import collections
import hashlib
import io
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmament.llm import common, kneser_ney, license_join, lz_fingerprint, mixing, order_minhash, pii, queries, token_counts, toxicity, warc_zip, winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(common.UPPER, common.LOWER)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def brute_words(text):
    return WORD.findall((text or "").translate(LOW))


def test_words_equal_the_pattern(spark):
    texts = ["Élan ÉLAN x1-Y2", "ABC  def\n", "", "日本語 テスト,ok", "İstanbul KELVIN K", "…a—b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.w for r in df.select(common.words(F.col("t")).alias("w")).collect()] == [brute_words(t) for t in texts]


def test_word_hashes_follow_the_words():
    texts = ["One two TWO, three", "two", "", "ü two"]
    a, b, c, d = common.word_hash_lists(texts)
    assert a[1] == a[2] == b[0] == d[1] and len(set(a)) == 3 and not len(c) and d[0] not in a
    assert [list(x) for x in map(common.word_hashes, texts)] == [list(x) for x in (a, b, c, d)]


# ---- token counts --------------------------------------------------------------

def test_token_counts_equal_the_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    t = tokenizers.Tokenizer.from_file(path)
    got = token_counts.token_counts(docs, path).collect()
    want = sorted((str(i), len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in texts_of(docs))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    c = token_counts.counter(path)
    for x in ["<|endoftext|> a<|endoftext|>", "  \n\n x ", "z" * 3000, "I'LL it's", "​ ñ…日本"]:
        assert c.count(x) == len(t.encode(x, add_special_tokens=False).ids)


def test_merging_equals_a_scan_for_the_lowest_rank():
    c = token_counts.MergeCounter([("a", "b"), ("b", "c"), ("ab", "c"), ("c", "c"), ("abc", "cc"), ("a", "a")], [])
    rank = {("a", "b"): 0, ("b", "c"): 1, ("ab", "c"): 2, ("c", "c"): 3, ("abc", "cc"): 4, ("a", "a"): 5}
    rng = np.random.default_rng(1)
    for _ in range(300):
        word = "".join(rng.choice(list("abc"), rng.integers(1, 14)))
        s = list(word)
        while best := min(((rank[p], i) for i, p in enumerate(zip(s, s[1:])) if p in rank), default=None):
            s[best[1]:best[1] + 2] = ["".join(s[best[1]:best[1] + 2])]
        assert c.merged(word.encode()) == len(s)


# ---- near-duplicates -----------------------------------------------------------

def shingles(text):
    w = brute_words(text)
    return set(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else set()


def test_classes_equal_brute_force(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    rows = texts_of(docs)
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: shingles(t) for i, t in rows}
    for k, (a, t) in enumerate(rows):
        for b, u in rows[:k]:
            x, y = sets[a], sets[b]
            if t == u or x and y and len(x & y) >= 0.8 * len(x | y):
                a0, b0 = sorted((find(a), find(b)))
                parent[b0] = a0
    assert got == {i: find(i) for i in parent}


def test_near_duplicates_of_odd_rows(docs, nothing):
    got = collections.defaultdict(set)
    for r in order_minhash.near_duplicates(docs).collect():
        got[r.doc_id].add(r.class_id)
    assert got == {1: {1}, 2: {1}, 3: {1}, 4: {4}, 5: {4}, 6: {6}, 7: {6}, 8: {8}, 9: {9}, 10: {10}, None: {None}, 11: {11}, 12: {12}}
    kept = order_minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 6, 8, 9, 10, None, 11, 12]))
    assert order_minhash.near_duplicates(nothing).isEmpty()


def test_pairs_in_a_group_of_boilerplate_are_found(spark):
    """Buckets made of shared words have unrelated ends; a pair may share no other bucket."""
    shared, rows = " ".join(f"common{i}" for i in range(176)), []
    for k in range(0, 160, 2):
        tail = [f"own{k}x{i}" for i in range(28)]
        rows += [(k, f"{shared} {' '.join(tail)}"), (k + 1, f"{shared} {' '.join(tail[:6] + [f'other{k}x{i}' for i in range(22)])}")]
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i, _ in rows}


def test_short_near_duplicates_are_found(spark):
    rows = []
    for k, n in enumerate([8, 9, 12, 13, 17, 22, 23, 30] * 6):
        w = [f"w{k}x{i}" for i in range(n)]
        more = [f"end{k}x{i}" for i in range(max(1, (n - 4) // 4))]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + more if k % 2 else more + w))]
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i, _ in rows}


def test_alignment_counts_the_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.permutation(30).astype(np.uint32)
        b = a.copy()
        i, j = rng.integers(0, 30, 2)
        b[i], b[j] = b[j], b[i]
        t = np.zeros((31, 31), int)
        for x in range(30):
            for y in range(30):
                t[x + 1, y + 1] = t[x, y] + 1 if a[x] == b[y] else max(t[x, y + 1], t[x + 1, y])
        want = t[-1, -1] / (60 - t[-1, -1])
        got = order_minhash.aligned(a, b)
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


# ---- personal data -------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_emails_equal_the_pattern():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        t = "".join(rng.choice(list("ab.@-_ "), rng.integers(0, 25)))
        assert list(pii.emails(t)) == [m.span() for m in EMAIL.finditer(t)]


@pytest.mark.parametrize("text,want", [
    ("ip 1.2.3.4 and 300.1.1.1 and 010.0.0.255", [("ip", 3, 10, True), ("ip", 29, 40, True)]),
    ("card 4111 1111 1111 1111, not 4111 1111 1111 1112", [("card", 5, 24, True)]),
    ("call +1 (555) 010-9999 or +12", [("phone", 5, 22, True)]),
    ("é john (at) example [dot] com", [("email", 2, 29, False)]),
    ("write bob at site dot org please", [("email", 6, 25, False)]),
    ("аlice＠exаmple.com", [("email", 0, 17, False)]),
    ("it is nine one two three four five six seven eight ok", [("phone", 6, 50, False)]),
    ("1​0.2.3.4", [("ip", 2, 9, True)]), ("1.2.​3.4", [("ip", 0, 8, False)]),
    ("look at this dot", []), ("", []),
])
def test_spans_point_into_the_source(text, want):
    assert pii.spans(text) == want


@pytest.mark.parametrize("text,want", [
    ("mail john (at) example.com now", (5, 26)), ("john [at] example.com", (0, 21)), ("john { AT } mail.example.com", (0, 28)),
    ("john(at)example.com", (0, 19)), ("name at example.com", (0, 19)), ("j.smith at example dot com", (0, 26)),
    ("john (at) example dot com", (0, 25)), ("john@example dot com", (0, 20)), ("john at mail.example dot com", (0, 28)),
    ("jоhn (at) example.com", (0, 21)), ("a word (and) a sign (at) noon", None), ("be there at 5.30 or at 10.15", None), ("look at that.", None),
])
def test_signs_in_words_need_no_other_dot(text, want):
    assert pii.spans(text) == ([("email", *want, False)] if want else [])


@pytest.mark.parametrize("text,want", [
    ("call +1 four one five 555 0199 now", ("phone", 5, 30)), ("plus 1 four one five 555 0199", ("phone", 0, 29)),
    ("+1 (four one five) 555-0199", ("phone", 0, 27)), ("pay 4111 one one one one 1111 1111", ("card", 4, 34)),
    ("4111 one one one one 1111 1112", None), ("10.0.zero.one", ("ip", 0, 13)), ("ten 10 dot zero [dot] 0 [dot] one", None),
    ("one nine two [dot] one six eight [dot] one [dot] one", ("ip", 0, 52)), ("+1 four one five", None),
    ("one nine two.168.zero.one", ("ip", 0, 25)), ("one.two.three.four.five.six.seven.eight", ("phone", 0, 39)),
    ("call five nine (at) site.com", ("email", 10, 28)), ("one of 3 or two, seven of nine.", None),
])
def test_digits_in_words_beside_digits(text, want):
    got = [s for s in pii.spans(text) if want is None or s[0] == want[0]]
    assert got == ([(*want, False)] if want else [])


def test_personal_data_of_odd_rows(docs, nothing):
    assert sorted(map(str, by_id(pii.find_personal_data(docs)))) == sorted({str(i) for i, _ in texts_of(docs)})
    assert pii.mask_personal_data(docs).where("text is null").count() == 1
    assert pii.masked("a@b.c and a@b.c.") == "[EMAIL] and [EMAIL]."
    assert pii.find_personal_data(nothing).isEmpty()


# ---- fingerprints --------------------------------------------------------------

def test_parse_and_fingerprints_equal_brute_force(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    rows = sorted(texts_of(docs), reverse=True)
    got = by_id(lz_fingerprint.lz_fingerprints(docs))
    prints = {i: lz_fingerprint.fingerprint(t) for i, t in rows}
    for k, (i, t) in enumerate(rows):
        nxt, following = rows[(k + 1) % len(rows)]
        n = len(t) // 3
        edited = t[:len(t) - n] + following[:n]
        r = got[i]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(t), prints[i], lz_fingerprint.fingerprint(edited))
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_next == lz_fingerprint.likeness(prints[i], prints[nxt]) and 0 <= r.near_edited <= 1
    for t in ["", "a", "aaaaaaaaaa", "abcd" * 9, rows[0][1][:2000]]:
        seen, start, ends = set(), 0, []
        for end in range(1, len(t) + 1):
            if (end - start > lz_fingerprint.PRESET and t[start:end] not in seen) or end == len(t):
                seen.add(t[start:end])
                start = end
                ends.append(end)
        assert lz_fingerprint.phrases(t, set(), 0, len(t))[0] == ends


def test_fingerprints_of_odd_rows(docs, nothing, monkeypatch):
    one = lz_fingerprint.lz_fingerprints(docs).collect()
    monkeypatch.setattr(lz_fingerprint, "BUCKET_CHARS", 2000)  # many buckets give the same rows as one
    assert sorted(map(str, lz_fingerprint.lz_fingerprints(docs).collect())) == sorted(map(str, one))
    assert len(one) == docs.count() and lz_fingerprint.lz_fingerprints(nothing).isEmpty()
    alone = lz_fingerprint.lz_fingerprints(docs.where("doc_id = 4")).first()
    assert (alone.n_chars, alone.fingerprint, alone.near_next) == (0, "", 1.0)


# ---- winnowing -----------------------------------------------------------------

def test_hits_equal_brute_force(spark, sf_dir, docs, nothing):
    tall = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = common.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), "text")
    more = [("s1", "A few words"), ("s2", "the River"), ("s3", None), ("s4", "???"), ("s5", "word1 tale1 of the river and hill number 1 word2"),
            ("s6", "tale3 of the river and hill number 3 word4 tale4 of the"), ("s1", "A few words"), (None, "straße")]
    bench = bench.union(spark.createDataFrame(more, bench.schema))
    every = tall.union(docs.select(F.col("doc_id") + 1_000_000, "text"))
    windows = collections.defaultdict(set)
    for r in bench.collect():
        w = brute_words(r.text)
        for i in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[i:i + 10])].add(r.item_id)
    sizes = {len(k) for k in windows}
    want = []
    for i, t in texts_of(every):
        w, hit, found = brute_words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        want.append((str(i), len(w), len(hit), sorted(found - {None})))
    got = winnowing.contamination(every, bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == sorted(want)
    clean = winnowing.drop_contaminated(every, bench)
    assert clean.count() == sum(n == 0 for _, _, n, _ in want) and clean.columns == every.columns
    assert winnowing.contamination(nothing, bench).isEmpty()
    assert winnowing.contamination(docs, bench.where("false")).where("n_hit > 0").isEmpty()


# ---- licenses ------------------------------------------------------------------

def test_blocks_and_phrases_equal_brute_force(spark, docs, nothing):
    mit = license_join.TEMPLATES[2][1]
    rows = [(100, f"Intro.\n\n{mit}.\n\nThe MIT License applies; mit  LICENSE."), (101, mit[:120]), (102, mit.replace("deal", "play")),
            (103, "GNU general public license and Apache License\nMIT\nlicense"), (104, "Licensed under CC BY-NC 4.0.\nx"), (105, "mitlicense")]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    templates = spark.createDataFrame([(i, *t) for i, t in enumerate(license_join.TEMPLATES)], "tid int, label string, template string")
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))
                              for r in license_join.license_scan(every, templates).collect())
    want = collections.Counter()
    for i, t in texts_of(every):
        w = brute_words(t)
        at, own, more, most = [], set(), set(), 0.0
        for phrase, label in license_join.PHRASES:
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k:k + len(p)] == p]
            at += found
            own |= {label} if found else set()
        for block in re.split(license_join.BLOCK, t):
            b = set(brute_words(block))
            for label, template in license_join.TEMPLATES:
                m = set(brute_words(template))
                if len(m & b) >= np.ceil(len(m) * license_join.CONTAINED - 1e-9):
                    more.add(label)
                    most = max(most, len(m & b) / len(m))
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)),
              round(1.0 if at else most, 9))] += 1
    assert got == want
    assert any("mit-text" in k[6] for k in want) and license_join.license_scan(nothing, templates).isEmpty()
    assert license_join.license_scan(every, templates.where("false")).where("score > 0").count() == 2


# ---- quality -------------------------------------------------------------------

def test_quality_parts_clean_from_junk(spark, sf_dir, docs, nothing):
    labels = common.table(spark, sf_dir, "labels")
    got = by_id(queries.op10_kneser_ney(spark, sf_dir))
    marks = {r.doc_id: r.quality for r in labels.collect()}
    clean = [got[i].accepted for i, q in marks.items() if q == 1]
    junk = [got[i].perplexity for i, q in marks.items() if q == 0]
    assert np.mean(clean) > 0.98 and np.median(junk) > 1.5 * np.median([got[i].perplexity for i, q in marks.items() if q == 1])
    ids = docs.where("doc_id in (1, 2)").select("doc_id")
    out = kneser_ney.judged(docs, ids)
    assert out.columns == [*docs.columns, "perplexity", "threshold", "accepted"] and out.count() == docs.count()
    assert not any(r.accepted or r.perplexity is not None for r in out.where("doc_id in (4, 5)").collect())
    assert kneser_ney.judged(docs, ids.where("false")).where("accepted").count() == docs.count() - 2
    assert kneser_ney.judged(nothing, ids).isEmpty()


# ---- toxicity ------------------------------------------------------------------

def test_held_out_toxic_texts_are_found(spark, sf_dir):
    docs, labels = common.table(spark, "/root/testdata/sf0.1", "documents"), common.table(spark, "/root/testdata/sf0.1", "labels")
    out = toxicity.toxicity_scores(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(toxicity.held_out())
    rows = out.select("doc_id", "toxic", "score", "predicted", "lang").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    pairs = np.mean([[a.score > b.score for b in clean[:300]] for a in toxic])
    assert pairs > 0.98 and np.mean([r.predicted for r in clean]) < 0.005 and np.mean([r.predicted for r in toxic]) > 0.7


def test_naming_another_group_moves_a_score_little():
    rng = np.random.default_rng(4)
    words = ["awful", "women", "men", "plain"]
    own, other, toxic = [], [], []
    for _ in range(600):
        bad, group = rng.random() < 0.4, rng.random() < 0.5
        named = 1 if (rng.random() < (0.9 if bad else 0.2)) else 2  # women are named mostly where the text is toxic
        own.append(np.array(([0] if bad else [3]) + ([named] if group else [])))
        other.append(np.array(([0] if bad else [3]) + [3 - named]) if group else None)
        toxic.append(float(bad))
    gap = {}
    for penalty in (0.0, toxicity.SWAP_PENALTY):
        toxicity.SWAP_PENALTY, old = penalty, toxicity.SWAP_PENALTY
        w, _ = toxicity.fit(np.array(toxic), own, other, len(words))
        toxicity.SWAP_PENALTY = old
        gap[penalty] = abs(w[1] - w[2])
        assert w[0] > w[3]
    assert gap[toxicity.SWAP_PENALTY] < 0.1 * gap[0.0]


def test_toxicity_of_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 0), (2, None), (2, 1), (3, 0), (None, 1), (11, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.toxicity_scores(docs, model).where("score between 0 and 1").count() == docs.count()
    assert toxicity.toxicity_scores(nothing, toxicity.train(nothing, labels)).isEmpty()
    assert toxicity.toxicity_scores(docs, toxicity.train(docs, labels.where("false"))).where("predicted = 1").isEmpty()


# ---- archives ------------------------------------------------------------------

def test_archives_round_trip(spark, sf_dir):
    big, small = "<p>é</p>" * 200, "tiny"
    rows = [(1, "http://a/ü?q=1 2", big), (2, None, big), (7, "http://b", big), (3, "u", small), (4, "u", small), (5, "u", None),
            (None, "n", big), (6, "x", "é" * 499), (8, "x", "é" * 499), (9, "y", "é" * 500), (9, "y", "é" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload)
                  for r in warc_zip.archive_round_trip(pages).collect()), key=str)
    last = {big: 7, "é" * 500: 9}
    want = []
    for i, _, html in rows:
        p = (html or "").encode()
        other = last[html] if html in last and i != last[html] else None
        want.append((i or 0, len(p), hashlib.sha1(p).hexdigest(), "revisit" if other else "response", other, None if other else p))
    assert got == sorted(want, key=str)
    assert warc_zip.archive_round_trip(pages.where("false")).isEmpty()


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_finds_members(zip64):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 not the end" if not zip64 else b""
        for name in ("a.txt", "ü.txt"):
            with z.open(name, "w", force_zip64=zip64) as f:
                f.write(name.encode() * 3)
    data = raw.getvalue()
    if not zip64:
        data = data[:-len(b"PK\x05\x06 not the end")][:-2] + b"\0\0"
    else:  # the end records as an archive over 4 GB has them
        at = data.rfind(b"PK\x05\x06")
        n, length, offset = (int.from_bytes(data[at + a:at + b], "little") for a, b in ((10, 12), (12, 16), (16, 20)))
        end64 = b"PK\x06\x06" + (44).to_bytes(8, "little") + bytes(12) + b"".join(v.to_bytes(8, "little") for v in (n, n, length, offset))
        locator = b"PK\x06\x07" + bytes(4) + at.to_bytes(8, "little") + (1).to_bytes(4, "little")
        data = data[:at] + end64 + locator + b"PK\x05\x06" + bytes(4) + b"\xff" * 12 + bytes(2)
    found = list(warc_zip.members(lambda o, n: data[o:o + n], len(data)))
    assert [(m.name, data[m.offset:m.offset + m.size]) for m in found] == [(n, n.encode() * 3) for n in ("a.txt", "ü.txt")]


# ---- mixing --------------------------------------------------------------------

def dense_rates(n, p, target, least, steps=20_000):
    """The same problem by accelerated gradients over all rates."""
    m = 1 / ((p * p * n[:, None]).sum(0))
    long = 1 / (np.abs((p * n[:, None]).T @ p * np.sqrt(np.outer(m, m))).sum(1).max() + mixing.RIDGE)
    r = y = np.full(len(n), max(1.0, least))
    t = 1.0
    for _ in range(steps):
        then = np.maximum(least, y - long * (p @ (m * ((y * n) @ p - target)) + mixing.RIDGE * (y - 1)))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, r, t = then + (t - 1) / s * (then - r), then, s
    return r


@pytest.mark.parametrize("least,share", [(0.0, [0.25] * 4), (0.0, [0.85, 0.1, 0.04, 0.01]), (1.0, [0.6, 0.2, 0.1, 0.1]), (1.0, [0.85, 0.05, 0.05, 0.05])])
def test_rates_equal_a_dense_solution(spark, least, share):
    rng = np.random.default_rng(5)
    n = rng.integers(1, 500, 3000).astype(float)
    p = np.array([rng.dirichlet(np.where(np.arange(4) == d, 4.0, 0.25)) for d in rng.choice(4, len(n), p=share)])
    rows = [(int(a), *map(float, b)) for a, b in zip(n, p)]
    members = spark.createDataFrame(rows, "n_tokens long, p_0 double, p_1 double, p_2 double, p_3 double").coalesce(4).cache()
    want = np.array([0.4, 0.2, 0.2, 0.2])
    rates = mixing.Rates.fit(members, list(want), least)
    got = members.select("n_tokens", "p_0", rates.column().alias("r")).collect()
    rate = {(r.n_tokens, r.p_0): r.r for r in got}
    r = np.array([rate[row[:2]] for row in rows])
    target = np.array(rates.target)
    dense = dense_rates(n, p, target, least)
    assert np.all(r >= least) and np.allclose((r * n) @ p, rates.totals, rtol=1e-9) and rates.slope <= mixing.TOLERANCE
    assert np.abs((r * n) @ p - (dense * n) @ p).max() < 1e-3 * target.sum() and np.allclose(r, dense, rtol=0.02, atol=0.02)
    assert rates.error == pytest.approx(np.abs((r * n) @ p - target).max() / target.sum()) and rates.error < (1e-3 if least == 0 else 0.02)


def test_columns_of_any_name_survive_mixing(docs):
    clash = docs.withColumns({c: F.lit(7) for c in ("n_tokens", "p_0", "_w", "_b", "rate", "copy", "_row", "_text", "_id")})
    out = mixing.mixed(clash, docs.select("doc_id").where("doc_id > 0"), {"en": 0.5, "fr": 0.5})
    assert sorted(out.columns) == sorted(clash.columns) and out.where("n_tokens <> 7 or p_0 <> 7 or _w <> 7 or _id <> 7").isEmpty()
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count() and not out.where("copy = 0 and rate >= 1").isEmpty()


def test_mixing_of_documents(spark, sf_dir, docs, nothing):
    every, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    out, member, _ = mixing.mixing_rates(every, labels, queries.DOMAIN_WEIGHTS)
    rows = by_id(out.join(every.select("doc_id", "lang"), "doc_id"))
    right = [max(range(4), key=lambda i: r[f"p_{i}"]) == member.domains.index(r.lang) for r in rows.values() if r.n_tokens > 20]
    assert np.mean(right) > 0.97
    named = docs.select("doc_id").where("doc_id is not null")
    got = mixing.mixed(docs, named, {"en": 0.5, "fr": 0.5})
    assert got.columns == [*docs.columns, "rate", "copy"]
    assert {str(r.doc_id) for r in got.collect()} == {str(i) for i, _ in texts_of(docs)}
    assert mixing.mixed(nothing, named, {"en": 1.0}).isEmpty() and mixing.mixed(docs, named.where("false"), {"en": 1.0, "fr": 2.0}).count() >= docs.count()
