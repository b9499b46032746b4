"""Near-duplicates by order min-hash, checked by banded alignment.

A text's k-mers are runs of five lower-cased words, each labelled with its occurrence number. Of every one of ``SKETCHES``
hash orders the ``SAMPLE`` smallest labelled k-mers are taken and kept in text order; two texts with an equal sample in any
order are candidates. A pair of long texts with similarity 0.8 shares a given sample with probability about 0.8 ** 5, so all
32 miss it with probability 3e-6. In short texts a sample is most of the text, so texts of up to ``SHORT`` k-mers are also
keyed by single k-mers, a prefix of theirs in hash order: no pair at 0.8 with a text of under ``SHORT * 0.8`` k-mers is missed.

Candidates are compared by alignment: the longest common subsequence of their labelled k-mers within the band that
the threshold leaves open. Similarity is aligned / (both - aligned); 0.8 or more makes a link. First every text of a bucket
is compared with the bucket's smallest and largest id, and the classes found are contracted. The texts of buckets that
still hold several classes are then joined exactly: by their rarest k-mers, as many as a link must share one of, with
length and positional filters. Buckets that meet in a common passage alone give no pairs there, as the passage is what is
frequent. Classes are the connected components of all links. Alignment works on the upper half of 64-bit hashes, so two
different k-mers of a pair count as equal with probability 2e-10.

Equal texts (null counts as empty) are one text from the start: they share a class whatever their words. Texts without
words are linked to nothing else; texts under five words have one k-mer. Repeated rows fall together; rows without an
id get no class of their own but that of their text, null if no row with that text has an id.
"""

from __future__ import annotations

import functools
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import U64, body, column_groups, free_name, give_back, join_measured, materialize, mix, ship_package, text_groups, word_hash_lists

SHINGLE, THRESHOLD = 5, 0.8
SKETCHES, SAMPLE = 32, 5
SHORT = 40  # k-mers
PIECE = 1 << 18  # k-mers times orders hashed at a time
TEXTS = 2000  # whose k-mers a task holds at a time
FREQUENT = 1 << 18  # k-mers whose numbers of texts are known to every task


def labelled_kmers(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``k`` words (given as hashes) with their occurrence numbers, in order; all words if fewer."""
    if not len(h):
        return h
    k = min(k, len(h))
    x = h[:len(h) - k + 1].copy()
    for j, a in enumerate(multipliers(k - 1), 1):
        x += h[j:len(h) - k + 1 + j] * a
    x = mix(x)
    by = np.sort(x)
    if np.all(by[1:] != by[:-1]):
        return x
    order = np.argsort(x, kind="stable")
    first = np.flatnonzero(np.diff(x[order], prepend=x[order[0]] + U64(1)))
    occ = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    label = np.zeros(len(x), dtype=U64)
    label[order] = occ.astype(U64)
    return np.where(label > 0, mix(x + label * U64(0xD6E8FEB86659FD93)), x)


def kmer_lists(texts: list[str]):
    for group in text_groups(texts):
        yield from map(labelled_kmers, word_hash_lists(group))


def column_kmers(column: pa.Array):
    for group in column_groups(column):
        yield from map(labelled_kmers, word_hash_lists(group))


def by_rows(batches, rows: int = TEXTS):
    """The batches cut to at most ``rows`` rows."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
            give_back()


@functools.cache
def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64)) | U64(1)


def order_sketches(x: np.ndarray, sketches: int = SKETCHES, sample: int = SAMPLE) -> np.ndarray:
    """One signed 64-bit key for each hash order: its smallest k-mers, in text order."""
    n, orders = len(x), multipliers(sketches)
    if n <= sample:
        at = np.broadcast_to(np.arange(n), (sketches, n))
    else:
        at = np.concatenate([_smallest(x, orders[lo:lo + step], sample) for step in [max(1, PIECE // n)]
                             for lo in range(0, sketches, step)])
    key = np.arange(sketches, dtype=U64)
    for v in x[at].T:
        key = mix(key ^ v)
    return key.view(np.int64)


def prefix_keys(x: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Signed 64-bit keys of the first k-mers of a short text in hash order; two texts that are a link share one."""
    n = len(x)
    if n > SHORT:
        return np.empty(0, dtype=np.int64)
    first = np.sort(x)[:n - int(np.ceil(threshold * n - 1e-9)) + 1]
    return mix(first ^ multipliers(SKETCHES + 1)[-1]).view(np.int64)


def _smallest(x: np.ndarray, orders: np.ndarray, sample: int) -> np.ndarray:
    """For each order the positions of the ``sample`` smallest k-mers, ascending."""
    y = x * orders[:, None]
    if len(x) > 200:
        row, col = np.nonzero(y < U64((1 << 64) * 40 // len(x)))  # some 40 in each order hold the smallest
        start = np.searchsorted(row, np.arange(len(orders) + 1))
        if np.diff(start).min() >= sample:
            by = np.lexsort((y[row, col], row))
            return np.sort(col[by[start[:-1, None] + np.arange(sample)]], axis=1)
    return np.sort(np.argpartition(y, sample - 1, axis=1)[:, :sample], axis=1)


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Ordered likeness of two k-mer sequences, 0 where it must stay below the threshold."""
    if not len(a) or not len(b):
        return 0.0
    both = len(a) + len(b)
    need = int(np.ceil(threshold * both / (1 + threshold) - 1e-9))
    if min(len(a), len(b)) < need:
        return 0.0
    _, i, j = np.intersect1d(a, b, return_indices=True)
    inside = np.abs(i - j) <= both - 2 * need  # what is not aligned is inserted or deleted
    i, j = i[inside], j[inside]
    if len(i) < need:
        return 0.0
    j = j[np.argsort(i)]
    if np.all(j[1:] > j[:-1]):
        n = len(j)
    else:
        tails: list[int] = []
        for v in j.tolist():
            at = bisect_left(tails, v)
            tails[at:at + 1] = [v]
        n = len(tails)
    return n / (both - n)


def sketch_table(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """``id, digest, n, keys``: a row for each row of ``docs``, how many k-mers its text has and its sketches."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), body(text_col).alias("t"))
    src = src.select("id", F.md5("t").alias("digest"), "t")

    def sketch(batches):
        for b in by_rows(batches):
            n, keys = [], []
            for x in column_kmers(b.column(2)):
                n.append(len(x))
                keys.append(order_sketches(x).tobytes() + prefix_keys(x, threshold).tobytes() if len(x) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(keys, pa.binary())],
                                             ["id", "digest", "n", "keys"])

    return src.mapInArrow(sketch, "id long, digest string, n int, keys binary")


def links(texts: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs ``a, b`` whose texts (``id, t``) align well enough."""
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "omh-ends")

    def encode(batches):
        for b in by_rows(batches):
            seqs = [(x >> U64(32)).astype(np.uint32).tobytes() for x in column_kmers(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seqs, pa.binary())], ["id", "seq"])

    seqs = materialize(join_measured(texts, ends, "id").select("id", "t").mapInArrow(encode, "id long, seq binary"), "omh-seqs")

    def verify(batches):
        for b in by_rows(batches):
            held: tuple = (None, None)
            keep = []
            for raw_a, raw_b in zip(b.column(2), b.column(3), strict=True):
                raw_a = raw_a.as_py()
                if held[0] != raw_a:
                    held = (raw_a, np.frombuffer(raw_a, np.uint32))
                keep.append(aligned(held[1], np.frombuffer(raw_b.as_py(), np.uint32), threshold) >= threshold)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    members = pairs.join(seqs.select(F.col("id").alias("b"), F.col("seq").alias("seq_b")), "b")
    both = members.join(seqs.select(F.col("id").alias("a"), F.col("seq").alias("seq_a")), "a")
    return both.select("a", "b", "seq_a", "seq_b").mapInArrow(verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``id, class_id`` of every end of the edges ``a, b``: the smallest id it is connected to.

    Labels spread to neighbours and then to the labels' own labels, so a path halves its length each round.
    """
    two_way = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    label = materialize(two_way.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("class_id")), "cc-labels")
    while True:
        near = two_way.join(label.select(F.col("id").alias("b"), "class_id"), "b").groupBy("a").agg(F.min("class_id").alias("seen"))
        step = label.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("class_id").alias("old"),
                                                                          F.least("class_id", "seen").alias("class_id"))
        step = materialize(step, "cc-step")
        up = step.select(F.col("id").alias("class_id"), F.col("class_id").alias("up"))
        label = materialize(step.join(up, "class_id").select("id", "old", F.col("up").alias("class_id")), "cc-labels")
        if label.where("class_id <> old").isEmpty():
            return label.select("id", "class_id")
        label = label.select("id", "class_id")


def open_texts(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """``id, n, class_id`` of the texts of ``keyed`` (``b, n, key``) that share a bucket with a text of another class."""
    own = keyed.join(classes.withColumnRenamed("id", "b"), "b", "left").withColumn("class_id", F.coalesce("class_id", "b"))
    own = materialize(own, "omh-owned")
    mixed = own.groupBy("key").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low < high").select("key")
    return own.join(mixed, "key").groupBy(F.col("b").alias("id")).agg(F.first("n").alias("n"), F.first("class_id").alias("class_id"))


def frequent(seqs: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers that are in most texts of ``seqs`` (``seq``), ascending, and in how many: all of at least some power of two,
    chosen so that there are at most ``most``."""

    def tally(batches):
        for b in by_rows(batches):
            held = [np.frombuffer(x.as_py(), U64) for x in b.column(0)]
            kmer, c = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kmer.view(np.int64)), pa.array(c, pa.int64())], ["kmer", "c"])

    counts = seqs.select("seq").mapInArrow(tally, "kmer long, c long").groupBy("kmer").agg(F.sum("c").alias("c")).where("c > 1")
    counts = materialize(counts, "omh-counts")
    size = {r.k: r.n for r in counts.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count("*").alias("n")).collect()}
    least = min((k for k in range(1, 65) if sum(n for j, n in size.items() if j >= k) <= most))
    rows = counts.where(F.col("c") >= 2 ** least).toPandas()  # at most ``most`` rows of 16 bytes
    kmer, c = rows.kmer.to_numpy(np.int64).view(U64), rows.c.to_numpy(np.int64)
    by = np.argsort(kmer)
    return kmer[by], c[by]


def prefixes(seqs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``key, id, n, class_id, place, index``: the rarest k-mers of each text of ``seqs`` (``id, n, class_id, seq``).

    K-mers are ordered by how many texts hold them, then by hash. A link needs ``threshold * (n_a + n_b) / (1 + threshold)`` common
    k-mers; so it has one among the first ``n - least + 1`` of each side, where ``least`` is what the text would need with its
    shortest partner, and for the shorter of the two, marked ``index``, with a partner of its own length.
    """
    spark = seqs.sparkSession
    shared = spark.sparkContext.broadcast(frequent(seqs))

    def first(batches):
        known, df = shared.value
        for b in by_rows(batches):
            cols: list[list] = [[], [], [], [], [], []]
            for i, n, c, raw in zip(*b.columns, strict=True):
                i, n, c, x = i.as_py(), n.as_py(), c.as_py(), np.frombuffer(raw.as_py(), U64)
                at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
                often = np.where(known[at] == x, df[at], 0) if len(known) else np.zeros(n, np.int64)
                x = x[np.lexsort((x, often))][:n - int(np.ceil(threshold * n - 1e-9)) + 1]
                short = n - int(np.ceil(2 * threshold / (1 + threshold) * n - 1e-9)) + 1
                place = np.arange(len(x))
                for col, v in zip(cols, (x.view(np.int64), np.full(len(x), i), np.full(len(x), n), np.full(len(x), c), place, place < short), strict=True):
                    col.append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
            arrays = [pa.array(np.concatenate(col) if col else [], t) for col, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "id", "n", "class_id", "place", "index"])

    return seqs.select("id", "n", "class_id", "seq").mapInArrow(first, "key long, id long, n int, class_id long, place int, index boolean")


def unmet(texts: DataFrame, keyed: DataFrame, classes: DataFrame, met: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs ``a, b`` that share a bucket of ``keyed`` without having met, lie in different classes and may be a link.

    Buckets of texts with a common passage hold many that are no link. All pairs of the texts in such buckets are looked for
    by an exact prefix join instead: what is common to many is frequent and leaves the prefixes, so that they do not meet.
    """
    left = materialize(open_texts(keyed, classes), "omh-open")

    def encode(batches):
        for b in by_rows(batches):
            seqs = [x.tobytes() for x in column_kmers(b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(seqs, pa.binary())], ["id", "n", "class_id", "seq"])

    src = join_measured(texts.select("id", "t"), left, "id").select("id", "n", "class_id", "t")
    seqs = materialize(src.mapInArrow(encode, "id long, n int, class_id long, seq binary"), "omh-open-seqs")
    keys = materialize(prefixes(seqs, threshold), "omh-prefixes")
    x = keys.where("index").select("key", *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "class_id", "place")])
    need = F.ceil(threshold / (1 + threshold) * (F.col("x_n") + F.col("n")) - 1e-9)
    bound = 1 + F.least(F.col("x_n") - F.col("x_place"), F.col("n") - F.col("place")) - 1
    shorter = (F.col("x_n") < F.col("n")) | ((F.col("x_n") == F.col("n")) & (F.col("x_id") < F.col("id")))
    may = shorter & (F.col("x_n") >= threshold * F.col("n") - 1e-9) & (F.col("x_class_id") != F.col("class_id")) & (bound >= need)
    pairs = x.join(keys, "key").where(may).select(F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b")).distinct()
    return pairs.join(met, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, ``class_id`` (smallest id of its class), ``copy_of`` (smallest id with the very same text)."""
    ship_package(docs.sparkSession)
    rows = materialize(sketch_table(docs, id_col, text_col, threshold), "omh-rows")
    ids = rows.groupBy("digest").agg(F.min("id").alias("copy_of"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    texts = materialize(ids.where("copy_of is not null"), "omh-texts")
    one = "substring(keys, 8 * i + 1, 8)"
    keyed = texts.where("length(keys) > 0").select(
        F.col("copy_of").alias("b"), "n", F.explode(F.expr(f"transform(sequence(0, length(keys) div 8 - 1), i -> conv(hex({one}), 16, -10))")).alias("key"))
    keyed = materialize(keyed.select("b", "n", F.col("key").cast("long").alias("key")), "omh-keyed")
    ends = keyed.groupBy("key").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low < high")
    met = keyed.join(ends, "key")
    pairs = met.select(F.col("low").alias("a"), "b").union(met.select("high", "b"))
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.distinct(), "omh-pairs")
    src = docs.select(F.col(id_col).cast("long").alias("id"), body(text_col).alias("t"))
    found = materialize(links(src, pairs, threshold), "omh-links")
    classes = components(found)
    rest = materialize(unmet(src, keyed, classes, pairs, threshold), "omh-rest")
    if not rest.isEmpty():
        more = materialize(links(src, rest, threshold), "omh-more")
        if not more.isEmpty():
            classes = components(found.unionByName(more))
    by_text = texts.select("digest", "copy_of").join(classes, texts.copy_of == classes.id, "left").select(
        "digest", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"))
    out = rows.select("id", "digest").join(by_text, "digest", "left")
    return out.select(F.col("id").alias(id_col), "class_id", "copy_of")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, that with the smallest id; of repeated rows with that id, one.

    Rows without an id go if a row with an id has their text, else they stay. Other columns may have any name and stay as they are.
    """
    classes = near_duplicates(docs.select(id_col, text_col), id_col, text_col)
    classes = materialize(classes.select(F.col(id_col).alias("id"), "class_id"), "omh-classes")
    others = materialize(classes.where("id <> class_id").select(F.col("id").alias(id_col)).distinct(), "omh-others")
    kept = join_measured(docs, others, id_col, "left_anti")
    if not classes.where("id is null and class_id is not null").isEmpty():
        digest = free_name("digest", docs)
        known = materialize(docs.where(F.col(id_col).isNotNull()).select(F.md5(body(text_col)).alias(digest)).distinct(), "omh-known")
        nameless = docs.where(F.col(id_col).isNull()).withColumn(digest, F.md5(body(text_col)))
        kept = kept.where(F.col(id_col).isNotNull()).unionByName(join_measured(nameless, known, digest, "left_anti").drop(digest))
    twice = classes.where("id = class_id").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    if twice.isEmpty():
        return kept
    repeated = materialize(twice.select(F.col("id").alias(id_col)), "omh-repeated")
    return join_measured(kept, repeated, id_col, "left_anti").unionByName(
        join_measured(kept, repeated, id_col).select(*docs.columns).dropDuplicates([id_col]))
