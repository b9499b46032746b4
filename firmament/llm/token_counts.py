"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pre-tokens; a pre-token's bytes are a linked list of symbols, and a heap holds the ranks of the
adjacent pairs. The lowest rank is popped, its pair joined, and the two new neighbours pushed. Each merge takes one symbol
away, so the count is the bytes minus the merges; no identifiers are made. Long pre-tokens take O(n log n).

Null and empty texts have no tokens. Repeated rows are counted each for itself; columns other than the id and the text
play no part.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import body, ship_package

LIMIT = 1024
# Fixed value: how texts are cut before merging, part of the public vocabulary.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS, CACHE_LEN = 800_000, 48  # a worker remembers so many short pre-tokens, some 100 MB
LONG_TEXT = 4_000_000


def byte_letters() -> dict[str, int]:
    """The vocabulary file writes each byte as a printable letter: itself where printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


class MergeCounter(dict):
    """Pre-token -> number of tokens; a missing one is computed and, if short, remembered."""

    def __init__(self, merges: list[tuple[str, str]], special: list[str]):
        super().__init__()
        letters = byte_letters()
        ids: dict[str, int] = dict(letters)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            new = ids.setdefault(a + b, len(ids) + 256)
            self.pairs.setdefault((ids[a], ids[b]), (rank, new))
        self.cut = regex.compile(CUT)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    @classmethod
    def load(cls, path: str) -> MergeCounter:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        return cls(pairs, [t["content"] for t in spec["added_tokens"]])

    def merged(self, symbols: bytes) -> int:
        """How many tokens the bytes of one pre-token become."""
        pairs, n = self.pairs, len(symbols)
        sym: list[int] = list(symbols)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*p, i, sym[i], sym[i + 1]) for i in range(n - 1) if (p := pairs.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j], left = new, -1, left - 1
            nxt[i] = after = nxt[j]
            if after < n:
                prv[after] = i
                if p := pairs.get((new, sym[after])):
                    heapq.heappush(heap, (*p, i, new, sym[after]))
            before = prv[i]
            if before >= 0 and (p := pairs.get((sym[before], new))):
                heapq.heappush(heap, (*p, before, sym[before], new))
        return left

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8")
        n = 1 if len(raw) == 1 else self.merged(raw)
        if len(word) <= CACHE_LEN:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a text; the strings of special tokens count one each and part the text."""
        total, parts = 0, [text]
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            if len(part) > LONG_TEXT:
                total += sum(self[m.group()] for m in self.cut.finditer(part))
            else:
                total += sum(map(self.__getitem__, self.cut.findall(part)))
        return total


_LOADED: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One per worker process, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = MergeCounter.load(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_tokens``, ``over_limit``. ``vocabulary`` is a path every executor can read."""
    ship_package(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("_id"), body(text_col).alias("_text"))

    def count(batches):
        c = counter(vocabulary)
        for b in batches:
            texts = b.column(1)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pc.binary_length(texts).cast(pa.int64()),
                pa.array((c.count(t) for t in texts.to_pylist()), pa.int64())], ["_id", "n_bytes", "n_tokens"])

    kind = src.schema["_id"].dataType.simpleString()
    out = src.mapInArrow(count, f"_id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
