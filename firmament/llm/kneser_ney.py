"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Tokens are runs of word characters, as written and with all digits alike, and runs of other visible characters. The
``KNOWN`` tokens that are most frequent in trusted text have a number of their own, all others share ``OTHERS`` numbers by hash, so a
token takes 16 bits and a bigram 32. Bigrams of all trusted texts are counted: tasks count their own, the counts are dealt
to shards by bigram and added up there. The number of shards follows the size of the texts and no table of bigrams is ever in
one place; only what is known of single tokens (contexts and continuations, ``VOCABULARY`` numbers each) goes to every task.

Documents are scored by joining the shards: a task sends each shard the different bigrams of some thousand texts once, with
the places of the texts they are in, trusted texts first, as 16-bit steps; a shard answers each request with one row that has
what its counts add to its texts' log probabilities; the rows of a slice are summed together. A text is answered for by
``MOST_SHARDS`` shards at most: beyond that shards are merged and copied to blocks, each of which serves a part of the slices. Of a
trusted text its own occurrences are taken off the counts first, so it is judged like a text the model has not seen.

A text is rejected when its perplexity exceeds a quantile of the trusted texts of its own language (of all trusted texts
where the language has none). Null and empty texts have a null perplexity and are rejected; a null language is a language
of its own. Without any trusted text nothing can be judged and every non-empty text is kept. Repeated rows are judged each
for itself, texts of any length whole. An empty table gives an empty one. Columns called ``perplexity``, ``threshold`` or ``accepted``
are replaced, all others stay as they are.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import U64, body, code_points, column_groups, free_name, give_back, join_measured, materialize, segment_hashes, ship_package

VOCABULARY, OTHERS = 1 << 16, 1 << 12
KNOWN = VOCABULARY - OTHERS - 1
EDGE = 0  # stands before the first and after the last token
QUANTILE, MARGIN = 0.995, 1.15
PSEUDO = 10  # tokens of average trusted text that every text is eked out with, so that a few words do not decide
SHARD_BYTES, LEAST_SHARDS = 32 << 20, 4  # text for each shard
MOST_SHARDS = 64  # that one text's bigrams are dealt to
SLICE = 2500  # texts
FIRST = 1 << 12  # more than SLICE; added to the place of the first text of a bigram, so runs are found again
PIECE = 1 << 20  # tokens counted at a time


@functools.cache
def _kinds() -> np.ndarray:
    """0 for blanks, 1 for word characters, 2 for other visible ones; all code points from 128 on are word characters."""
    return np.array([0 if p <= 32 or p == 127 else 1 if chr(p).isalnum() else 2 for p in range(128)] + [1], dtype=np.int8)


def token_lists(texts: list[str]) -> list[np.ndarray]:
    """A 64-bit hash of each token, for several texts in one pass over their characters."""
    a = code_points("\n".join(texts))
    kind = _kinds()[np.minimum(a, 128)]
    at = np.flatnonzero(kind)
    if not len(at):
        return [np.empty(0, U64) for _ in texts]
    a, kind = a[at], kind[at]
    points = np.where((a >= 48) & (a <= 57), 48, a)
    starts = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(kind, prepend=0) != 0))
    edges = np.cumsum([len(t) + 1 for t in texts])[:-1]
    return np.split(segment_hashes(points.astype(U64), starts), np.searchsorted(at[starts], edges))


def numbered(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Numbers of tokens given as hashes; ``known`` are the hashes with a number of their own, ascending."""
    other = 1 + KNOWN + (h % U64(OTHERS)).astype(np.uint32)
    if not len(known):
        return other
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, 1 + at, other).astype(np.uint32)


def bigrams(numbers: np.ndarray) -> np.ndarray:
    s = np.concatenate([[EDGE], numbers, [EDGE]]).astype(np.uint32)
    return s[:-1] << np.uint32(16) | s[1:]


def packed(x: np.ndarray, ascending: bool = False, kind: type = np.uint32) -> bytes:
    """An array of unsigned numbers, its bytes laid out by place; of ascending ones the steps."""
    x = (np.diff(x, prepend=kind(0)) if ascending else x).astype(kind)
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(raw: bytes, ascending: bool = False, kind: type = np.uint32) -> np.ndarray:
    n, width = int.from_bytes(raw[:4], "little"), np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(raw[4:], decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8)
    x = np.ascontiguousarray(flat.reshape(width, n).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if ascending else x


def packed_runs(where: np.ndarray, first: np.ndarray) -> bytes:
    """Places below ``FIRST``, ascending in each run; ``first`` has the positions at which runs begin."""
    steps = np.diff(where.astype(np.int64), prepend=0)
    steps[first] = where[first] + np.int64(FIRST)
    return packed(steps, kind=np.uint16)


def unpacked_runs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The number of its run and the place of each element."""
    steps = unpacked(raw, kind=np.uint16).astype(np.int64)
    begins = steps >= FIRST
    of = np.cumsum(begins) - 1
    steps[begins] -= FIRST
    where = np.cumsum(steps)
    before = (where - steps)[begins]
    return of, where - before[of]


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    return ((grams * np.uint32(0x9E3779B1)).astype(np.uint64) * U64(shards) >> U64(32)).astype(np.int32)


def _hashed(texts: pa.Array):
    """The token hashes of each text, a few texts at a time."""
    for group in column_groups(texts):
        yield from token_lists(group)


def pieces(arrays, size: int = PIECE):
    """The elements of many arrays, in runs of some ``size`` elements."""
    held, n = [], 0
    for a in arrays:
        held.append(a)
        n += len(a)
        if n >= size:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def known_tokens(texts: DataFrame, most: int = KNOWN) -> np.ndarray:
    """Hashes of the ``most`` most frequent tokens of ``texts`` (``t``), ascending; of equally frequent ones the smaller."""

    def tally(batches):
        for b in batches:
            h, c = np.empty(0, U64), np.empty(0, np.int64)
            for piece in pieces(_hashed(b.column(0))):
                new, n = np.unique(piece, return_counts=True)
                h, at = np.unique(np.concatenate([h, new]), return_inverse=True)
                c = np.bincount(at, np.concatenate([c, n]), len(h)).astype(np.int64)
                give_back()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], ["h", "c"])

    counts = texts.select("t").mapInArrow(tally, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    top = counts.orderBy(F.desc("c"), "h").limit(most).select("h").toPandas()  # the vocabulary, half a megabyte
    return np.sort(top.h.to_numpy(np.int64).view(U64))


def bigram_shards(texts: DataFrame, known: np.ndarray, shards: int) -> DataFrame:
    """``shard, grams, counts``: one row for each shard, its bigrams ascending and how often they occur in ``texts``."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        for b in batches:
            for piece in pieces(bigrams(numbered(h, shared.value)) for h in _hashed(b.column(0))):
                grams, c = np.unique(piece, return_counts=True)
                of = shard_of(grams, shards)
                rows = [(s, packed(grams[of == s], True), packed(c[of == s])) for s in np.unique(of).tolist()]
                yield pa.RecordBatch.from_pylist([{"shard": s, "grams": g, "counts": n} for s, g, n in rows], PARTS)
                give_back()

    def added(key, table):
        grams = np.concatenate([unpacked(x.as_py(), True) for x in table.column("grams")])
        counts = np.concatenate([unpacked(x.as_py()) for x in table.column("counts")])
        grams, at = np.unique(grams, return_inverse=True)
        counts = np.minimum(np.bincount(at, counts), 0xFFFFFFFF)
        return pa.table({"shard": [key[0].as_py()], "grams": [packed(grams, True)], "counts": [packed(counts)]}, PARTS)

    parts = texts.select("t").mapInArrow(count, "shard int, grams binary, counts binary")
    return parts.groupBy("shard").applyInArrow(added, "shard int, grams binary, counts binary")


PARTS = pa.schema([("shard", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and more, from how many occur once to four times; half a count for each up to
    three where those are too few to give a discount in its range."""
    n, out = [n1, n2, n3, n4], [0.0]
    for k in (1, 2, 3):
        raw = k - (k + 1) * n1 / (n1 + 2 * n2) * n[k] / n[k - 1] if n[k - 1] and n1 + n2 else -1.0
        out.append(raw if 0.01 <= raw <= k else 0.5 * k)
    return np.array(out)


class Model:
    """What is known of single tokens: ``back`` (log weight left to the lower order, by context), ``single`` (log probability by
    token), ``total`` (by context) and the bigrams' discounts. With the bigrams' counts it gives all probabilities."""

    def __init__(self, spread: np.ndarray, tokens: dict[str, np.ndarray]):
        self.cut = discounts(*spread)
        self.total = tokens["total"]
        spare = self.cut[1] * tokens["n1"] + self.cut[2] * tokens["n2"] + self.cut[3] * tokens["n3"]
        self.back = np.log(np.divide(spare, self.total, out=np.ones(VOCABULARY), where=self.total > 0))
        k = tokens["before"]
        cut = discounts(*(float((k == j).sum()) for j in (1, 2, 3, 4)))[np.minimum(k, 3).astype(int)]
        self.single = np.log((k - cut) / k.sum() + cut.sum() / k.sum() / VOCABULARY)

    def gain(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log probability of bigrams seen so often, over what single tokens give them."""
        c, w = grams >> np.uint32(16), grams & np.uint32(0xFFFF)
        low = np.exp(self.back[c] + self.single[w])
        seen = np.maximum(counts - self.cut[np.minimum(counts, 3).astype(int)], 0.0)
        return np.log1p(seen / np.maximum(self.total[c], 1.0) / low)


def fit(trusted: DataFrame, shards: int, text_col: str = "text") -> tuple[np.ndarray, DataFrame, Model, float] | None:
    """The known tokens, the sharded counts, the model of single tokens and the mean log probability of a trusted token."""
    texts = trusted.select(F.col(text_col).alias("t")).where(F.length("t") > 0)
    known = known_tokens(texts)
    parts = materialize(bigram_shards(texts, known, shards), "kn-shards")

    def spread(batches):
        for b in batches:
            for g, n in zip(b.column(1), b.column(2), strict=True):
                grams, c = unpacked(g.as_py(), True), unpacked(n.as_py())
                of = (grams >> np.uint32(16)).astype(np.int64)
                rows = [np.bincount(of, c, VOCABULARY)] + [np.bincount(of[m], minlength=VOCABULARY) for m in (c == 1, c == 2, c > 2)]
                rows += [np.bincount((grams & np.uint32(0xFFFF)).astype(np.int64), minlength=VOCABULARY)]
                rows += [np.bincount(of[m], minlength=VOCABULARY) for m in (c == 3, c == 4)]
                at = np.flatnonzero(rows[0] + rows[4])
                yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(r[at].astype(np.float64)) for r in rows)], ["token", *TOKEN_COLS])

    cols = ", ".join(f"{c} double" for c in TOKEN_COLS)
    rows = parts.mapInArrow(spread, f"token long, {cols}").groupBy("token").agg(*[F.sum(c).alias(c) for c in TOKEN_COLS])
    rows = rows.toPandas()  # at most ``VOCABULARY`` rows
    if rows.empty:
        return None
    tokens = {c: np.zeros(VOCABULARY) for c in TOKEN_COLS}
    for c in TOKEN_COLS:
        tokens[c][rows.token.to_numpy()] = rows[c].to_numpy()
    model = Model(np.array([tokens[c].sum() for c in ("n1", "n2", "exactly3", "exactly4")]), tokens)
    shared = trusted.sparkSession.sparkContext.broadcast(model)

    def likelihood(batches):
        for b in batches:
            out = [0.0]
            for g, n in zip(b.column(1), b.column(2), strict=True):
                grams, c = unpacked(g.as_py(), True), unpacked(n.as_py())
                m = shared.value
                out.append(float(c @ (m.gain(grams, c) + m.back[grams >> np.uint32(16)] + m.single[grams & np.uint32(0xFFFF)])))
            yield pa.RecordBatch.from_arrays([pa.array([sum(out)], pa.float64())], ["s"])

    mean = parts.mapInArrow(likelihood, "s double").agg(F.sum("s")).first()[0] / tokens["total"].sum()
    return known, parts, model, mean


TOKEN_COLS = ("total", "n1", "n2", "n3", "before", "exactly3", "exactly4")


def layout(shards: int, most: int = MOST_SHARDS) -> tuple[int, int]:
    """In how many blocks slices are dealt, and how many shards answer each; as many shards are merged as there are blocks, so
    a task reads as many requests as without."""
    blocks = -(-shards // most)
    return blocks, -(-shards // blocks)


def scored(rows: DataFrame, trained: tuple, shards: int, pseudo: int = PSEUDO, most: int = MOST_SHARDS) -> DataFrame:
    """``rows`` (``t``, ``own`` and others) without ``t`` but with ``perplexity``; ``own`` marks texts the model has counted.

    A text's answers come from ``most`` shards at most, however many there are (``layout``).
    """
    known, parts, model, mean = trained
    spark = rows.sparkSession
    blocks, merged = layout(shards, most)
    shared = spark.sparkContext.broadcast((known, model))
    carried = [c for c in rows.columns if c != "t"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)

    def request(batches):
        known, model = shared.value
        number, at = TaskContext.get().partitionId(), 0
        task = number << 32
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                own = np.array(b.column("own").to_pylist(), dtype=bool)
                lists = [bigrams(numbered(h, known)) for h in _hashed(b.column("t"))]
                base = [float((model.back[g >> np.uint32(16)] + model.single[g & np.uint32(0xFFFF)]).sum()) for g in lists]
                n = np.array([len(g) for g in lists])
                names = ["slice", "place", "base", "n", *carried]
                mine = int(own.sum())  # the model has counted the texts at the places below
                rank = np.empty(len(n), dtype=np.int64)
                rank[np.argsort(~own, kind="stable")] = np.arange(len(n))
                cols = [pa.array(np.full(len(n), task + at)), pa.array(rank, pa.int32()), pa.array(base, pa.float64()), pa.array(n, pa.int64()),
                        *(b.column(c) for c in carried)]
                docs = pa.table(dict(zip(names, cols, strict=True)))
                key = np.concatenate(lists).astype(np.uint64) << U64(12)
                key |= np.repeat(rank.astype(np.uint64), n)
                key.sort()
                grams, of = (key >> U64(12)).astype(np.uint32), (key & U64(FIRST - 1)).astype(np.uint32)
                shard = shard_of(grams, shards) // blocks
                block = (number + at) % blocks
                docs = docs.append_column("block", pa.array(np.full(len(n), block), pa.int32()))
                docs = docs.append_column("shard", pa.array(np.full(len(n), (number + at) // blocks % merged), pa.int32()))
                asked = []
                for s in np.unique(shard).tolist():
                    g, where = grams[shard == s], of[shard == s]
                    first = np.flatnonzero(np.diff(g.astype(np.int64), prepend=-1))
                    asked.append({"slice": task + at, "block": block, "shard": s, "grams": packed(g[first], True),
                                  "texts": packed_runs(where, first), "mine": mine})
                out = pa.concat_tables([docs, pa.Table.from_pylist(asked, ASKED)], promote_options="permissive")
                yield from out.select([*names, "block", "shard", "grams", "texts", "mine"]).combine_chunks().to_batches()
                at += 1
                del lists, key, grams, of, shard, where, first, asked, out, docs
                give_back()

    asked = rows.mapInArrow(request, f"slice long, place int, base double, n long, {kinds}, block int, shard int, grams binary, texts binary, mine int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    parts = parts.select(copies.alias("block"), F.floor(F.col("shard") / blocks).cast("int").alias("shard"), "grams", "counts")
    parts_kept = pa.schema([("slice", pa.int64()), ("of", pa.int32()), ("places", pa.binary()), ("parts", pa.binary())])

    def parted(rows, held, shard):
        """What the counts ``held`` add to the texts of the requests ``rows``: a row for each request, its texts' parts in it."""
        model = shared.value[1]
        grams = np.concatenate([unpacked(x.as_py(), True) for x in held.column("grams")])
        counts = np.concatenate([unpacked(x.as_py()) for x in held.column("counts")])
        if held.num_rows > 1:
            by = np.argsort(grams)
            grams, counts = grams[by], counts[by]
        out = []
        for i, g, texts, mine in zip(*(rows.column(x) for x in ("slice", "grams", "texts", "mine")), strict=True):
            g, (of, where) = unpacked(g.as_py(), True), unpacked_runs(texts.as_py())
            at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
            seen = np.where(grams[at] == g, counts[at], 0).astype(np.int64)
            keep = np.flatnonzero(seen[of])
            of, where = of[keep], where[keep]
            run = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(where, prepend=-1) != 0))
            times = np.diff(np.append(run, len(of)))
            of, where = of[run], where[run]
            part = times * model.gain(g[of], np.maximum(seen[of] - times * (where < mine.as_py()), 0))
            total = np.bincount(where, part)
            place = np.flatnonzero(total)
            out.append({"slice": i.as_py(), "of": shard, "places": packed(place, True), "parts": packed(total[place].view(U64), kind=U64)})
        return pa.Table.from_pylist(out, parts_kept)

    def answer(key, asked, held):
        texts = pc.is_null(asked.column("grams"))
        out = asked.filter(texts).select(["slice", "place", "base", "n", *carried])
        if not held.num_rows:
            return out.append_column("of", pa.nulls(len(out), pa.int32())).append_column("places", pa.nulls(len(out), pa.binary())).append_column(
                "parts", pa.nulls(len(out), pa.binary()))
        out = pa.concat_tables([out, parted(asked.filter(pc.invert(texts)), held, key[1].as_py())], promote_options="permissive")
        give_back()
        return out

    def summed(key, rows):
        """The texts of one slice with the log probability that all shards give them, added up in the shards' order."""
        added = pc.is_valid(rows.column("places"))
        texts = rows.filter(pc.invert(added)).select(["place", "base", "n", *carried])
        total = np.zeros(len(texts))  # a slice's places are 0 to their number
        for places, part in zip(*(rows.filter(added).sort_by("of").column(c) for c in ("places", "parts")), strict=True):
            total[unpacked(places.as_py(), True)] += unpacked(part.as_py(), kind=U64).view(np.float64)
        total = texts.column("base").to_numpy() + total[texts.column("place").to_numpy()]
        return texts.select(["n", *carried]).append_column("total", pa.array(total, pa.float64())).select(["total", "n", *carried])

    replies = asked.groupBy("block", "shard").cogroup(parts.groupBy("block", "shard")).applyInArrow(
        answer, f"slice long, place int, base double, n long, {kinds}, of int, places binary, parts binary")
    both = replies.groupBy("slice").applyInArrow(summed, f"total double, n long, {kinds}")
    return both.select(*carried, F.exp(-(F.col("total") + pseudo * mean) / (F.col("n") + pseudo)).alias("perplexity"))


ASKED = pa.schema([("slice", pa.int64()), ("block", pa.int32()), ("shard", pa.int32()), ("grams", pa.binary()), ("texts", pa.binary()), ("mine", pa.int32())])


def _scores(docs: DataFrame, trusted_ids: DataFrame, id_col: str, text_col: str, lang_col: str, quantile: float, margin: float,
            extra: list | None = None) -> DataFrame:
    """``id, lang``, the ``extra`` columns, ``perplexity, threshold, accepted``: a row for each of ``docs``."""
    ship_package(docs.sparkSession)
    ids = trusted_ids.select(F.col(id_col).alias("id")).where("id is not null").distinct().withColumn("own", F.lit(True))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), body(text_col).alias("t"), *(extra or []))
    rows = join_measured(rows, materialize(ids, "trusted"), "id", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    extras = [c for c in rows.columns if c not in ("id", "lang", "t", "own")]
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    full = rows.where(F.length("t") > 0)
    empty = rows.where(F.length("t") == 0).select("id", "lang", *extras)
    none = F.lit(None).cast("double")
    trained = fit(rows.where("own"), shards, "t")
    if trained is None:
        return full.select("id", "lang", *extras, none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("accepted")).unionByName(
            empty.select("*", none.alias("perplexity"), none.alias("threshold"), F.lit(False).alias("accepted")))
    out = materialize(scored(full, trained, shards), "kn-scores")
    q = F.percentile_approx("perplexity", quantile, 10000) * margin
    own = out.where("own")
    by_lang = materialize(own.groupBy(F.coalesce("lang", F.lit("")).alias("_lang")).agg(q.alias("_own")), "thresholds")
    overall = own.agg(q).first()[0]
    out = out.drop("own").unionByName(empty.withColumn("perplexity", none)).withColumn("_lang", F.coalesce("lang", F.lit("")))
    out = join_measured(out, by_lang, "_lang", "left").withColumn("threshold", F.coalesce("_own", F.lit(overall)))
    return out.select("id", "lang", *extras, "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("accepted"))


def judged(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """``docs`` with ``perplexity``, ``threshold`` and ``accepted``. ``trusted_ids`` has the column ``id_col``.

    The threshold of a language is ``margin`` times the ``quantile`` of its trusted texts' perplexities. Scores are found again by
    id, text and language, so rows that are equal in these share one.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in MADE])
    names = {c: free_name(f"_{c}", docs) for c in ("id", "digest", "lang")}
    once = _verdicts(docs, trusted_ids, id_col, text_col, lang_col, quantile, margin, MADE, names)
    return join_measured(docs, once, _same(names, id_col, text_col, lang_col), "left").select(*docs.columns, *MADE)


def keep_accepted(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` that ``judged`` accepts; columns may have any name and stay as they are.

    Rows go by the ids all of whose rows are rejected, which are few and short; id, text and language are compared only
    for ids that have both verdicts and for rows without an id.
    """
    names = {c: free_name(f"_{c}", docs) for c in ("id", "digest", "lang")}
    once = _verdicts(docs, trusted_ids, id_col, text_col, lang_col, quantile, margin, ("accepted",), names)
    mine = F.col(names["id"])
    ids = once.where(mine.isNotNull()).groupBy(mine).agg(F.max("accepted").alias("any_kept"), F.min("accepted").alias("all_kept"))
    ids = materialize(ids.where("not all_kept"), "kn-rejected")
    kept = join_measured(docs, materialize(ids.where("not any_kept").select(mine.alias(id_col)), "kn-rejected-ids"), id_col, "left_anti")
    both = materialize(ids.where("any_kept").select(mine), "kn-both")
    rejected = once.where("not accepted").drop("accepted")
    rejected = join_measured(rejected, both, names["id"], "left_semi").unionByName(rejected.where(mine.isNull()))
    rejected = materialize(rejected, "kn-rejected-rows")
    if rejected.isEmpty():
        return kept
    return join_measured(kept, rejected, _same(names, id_col, text_col, lang_col), "left_anti")


MADE = ("perplexity", "threshold", "accepted")


def _verdicts(docs: DataFrame, trusted_ids: DataFrame, id_col: str, text_col: str, lang_col: str, quantile: float, margin: float,
              made: tuple[str, ...], names: dict[str, str]) -> DataFrame:
    """One row with ``made`` for all rows that are equal in id, text (as a digest) and language, called as ``names`` says."""
    scores = _scores(docs, trusted_ids, id_col, text_col, lang_col, quantile, margin, [F.unhex(F.md5(body(text_col))).alias("digest")])
    once = scores.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(*[F.first(c).alias(c) for c in made])
    return materialize(once, "kn-verdicts")


def _same(names: dict[str, str], id_col: str, text_col: str, lang_col: str) -> Column:
    mine = {"id": F.col(id_col), "digest": F.unhex(F.md5(body(text_col))), "lang": F.col(lang_col)}
    return functools.reduce(lambda a, b: a & b, [mine[c].eqNullSafe(F.col(n)) for c, n in names.items()])


def quality_scores(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang") -> DataFrame:
    """Per row: id, language, ``perplexity``, ``threshold`` and ``accepted``."""
    out = _scores(docs, trusted_ids, id_col, text_col, lang_col, QUANTILE, MARGIN)
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "perplexity", "threshold", "accepted")
