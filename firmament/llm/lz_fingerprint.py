"""Fingerprints from the phrases of a Lempel-Ziv parse.

A text is parsed left to right into the shortest phrases not met before, given a dictionary that starts with all short
strings. The hashes of its phrases are a set, and the fingerprint is the smallest of them, as hex: equal texts have equal
fingerprints, and the share of the smallest hashes of two texts that both have estimates how many phrases they have in
common.

Null counts as empty; the empty text's fingerprint is the empty string, alike (1.0) only to another empty one. Documents
follow each other by descending id; rows with the same id follow by the md5 of their text; rows without an id come last.
A lone document is its own next one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import U64, body, code_points, mix, segment_hashes, ship_package

KEEP = 64  # smallest phrase hashes in a fingerprint
PRESET = 3  # strings up to this length are in the dictionary from the start, as single characters are in other coders
BUCKET_CHARS, MOST_BUCKETS = 4 << 20, 20_000


def phrases(text: str, seen: set[str], start: int, stop: int, until: int | None = None) -> tuple[list[int], list[str]]:
    """Ends of the phrases of ``text[start:stop]``, and those that were new to ``seen``; none ends after ``until``.

    The last phrase may be a known one that ends at ``stop``. Every phrase less its last character is a phrase, so a
    length is known or new on either side of one border; the search for it begins at the length of the phrase before.
    """
    ends, new, guess = [], [], PRESET + 1
    until = stop if until is None else until
    while start < stop:
        n = min(guess, stop - start)
        piece = text[start:start + n]
        if piece in seen:
            while piece in seen and start + n < stop:
                n += 1
                piece = text[start:start + n]
        else:
            while n > PRESET + 1 and (shorter := text[start:start + n - 1]) not in seen:
                n -= 1
                piece = shorter
        if start + n > until:
            break
        if piece not in seen:
            seen.add(piece)
            new.append(piece)
        start += n
        ends.append(start)
        guess = n
    return ends, new


def signature(text: str, ends: list[int]) -> str:
    """The ``KEEP`` smallest different hashes of the phrases, ascending, as hex."""
    if not ends:
        return ""
    hashes = np.sort(segment_hashes(code_points(text).astype(U64), np.array([0, *ends[:-1]])) >> U64(32))
    hashes = hashes[np.diff(hashes, prepend=U64(1 << 40)) != 0]
    return hashes[:KEEP].astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of the smallest hashes of both together that both have."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), dtype=">u4") for s in (a, b))
    least = np.union1d(x, y)[:KEEP]
    return float(np.mean(np.isin(least, x) & np.isin(least, y)))


def edit(text: str, following: str) -> str:
    """The last third of a text replaced by the beginning of the one that follows it."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def fingerprint(text: str) -> str:
    return signature(text, phrases(text, set(), 0, len(text))[0])


def fingerprint_pair(text: str, following: str) -> tuple[str, str, str]:
    """Fingerprint, edited text, and its fingerprint; the parse of what the edit keeps serves both."""
    kept, edited, seen = len(text) - len(text) // 3, edit(text, following), set()
    ends, _ = phrases(text, seen, 0, len(text), kept)
    at = ends[-1] if ends else 0
    rest, new = phrases(text, seen, at, len(text))
    seen.difference_update(new)
    other, _ = phrases(edited, seen, at, len(edited))
    return signature(text, ends + rest), edited, signature(edited, ends + other)


def in_turn(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``bucket, tail, id, text``: documents in buckets of neighbouring ids, sorted; each bucket ends with the first
    document of the one after it (``tail``), so that every document meets its next one in its own task."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), body(text_col).alias("text"))
    size = src.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    want = min(MOST_BUCKETS, 1 + (size.chars or 0) // BUCKET_CHARS)
    cuts = src.agg(F.percentile_approx("id", [k / want for k in range(1, want)] or [0.5], 10000)).first()[0] if want > 1 else []
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        at = len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, at), pa.int32())

    key = src.withColumn("bucket", bucket("id"))
    order = F.struct("id", F.md5("text").alias("md5"))
    heads = sorted((r.bucket, r.head.id, r.head.md5) for r in key.groupBy("bucket").agg(F.max(order).alias("head")).collect())
    if not heads:
        return src.select(F.lit(0).alias("bucket"), F.lit(False).alias("tail"), "id", "text")
    after = [(heads[i - 1][0], h[1], h[2]) for i, h in enumerate(heads)]  # the first bucket follows the last one
    follow = docs.sparkSession.createDataFrame(after, "bucket int, head long, md5 string")
    tails = src.join(
        F.broadcast(follow), F.col("id").eqNullSafe(F.col("head")) & (F.md5("text") == F.col("md5"))).select("bucket", F.lit(True).alias("tail"), "id", "text")
    rows = key.select("bucket", F.lit(False).alias("tail"), "id", "text").union(tails)
    return rows.repartition(len(heads), "bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("id"), F.desc(F.md5("text")))


FIELDS = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def lz_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``."""
    ship_package(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64())] + [(f, pa.string()) for f in FIELDS[2:5]]
                       + [(f, pa.float64()) for f in FIELDS[5:]])

    def parse(batches):
        bucket, held, waiting = None, None, None  # the row whose next one is due; the one that awaits its next one's print
        for b in batches:
            out = []
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] != bucket:
                    bucket, held, waiting = row[0], None, None
                elif held is None:
                    continue  # a tail that is there twice
                if held is not None:
                    first, edited, second = fingerprint_pair(held[3], row[3])
                    if waiting:
                        out.append((*waiting, likeness(waiting[3], first)))
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    waiting = (held[2], len(held[3]), sha, first, second, likeness(first, second))
                held = row
                if row[1]:
                    out.append((*waiting, likeness(waiting[3], fingerprint(row[3]))))
                    held = waiting = None
            yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, r, strict=True)) for r in out], schema)

    out = in_turn(docs, id_col, text_col).mapInArrow(
        parse, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
