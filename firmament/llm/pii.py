"""Personal data, disguised or plain, with spans in the source text.

Plain identifiers are found in the text as it is. For disguised ones a chain of rewriting steps makes a normalised text
and remembers for each of its characters where it came from: look-alike letters and digits become ASCII, invisible
characters go, "(at)", "[dot]" and "name at host dot tld" become signs, runs of spelled digits become digits. The same
detectors run over that text and their spans are mapped back to source characters. Disguised finds that overlap a plain
one are dropped, so plain ones always stay as they are.

Spans count code points, the end is exclusive. Null and empty texts have none. Repeated rows are handled each for itself.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import body, ship_package

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII ones, then what they look like.
LOOKS = "аеорсухіјѕԁһқӏАВЕКМНОРСТХІЈЅαονιρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ＠．。﹒·∙٫⁃‐‑‒–—−＋"
ASCII = "aeopcyxijsdhklABEKMHOPCTXIJSaoviptukABEZHIKMNOPTYX@......-------+"[:len(LOOKS)]
HIDDEN = "­​‌‍⁠﻿"
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
          "seven": "7", "eight": "8", "nine": "9"}
SPELLED = 7  # so many digits in words are a phone number without any sign

_digit = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
RUN = re.compile(rf"(?<![A-Za-z])(?=[pzotfsen0-9])(?:plus[ ,.-]+)?(?:(?:{_digit}|[0-9])[ ,.-]*){{{SPELLED},}}(?<![ ,.-])(?![A-Za-z])", re.I | re.A)
WORDED = re.compile(rf"(?<![A-Za-z])(?=[pzotfsen0-9])(?:plus[ ,-]+)?(?:(?:{_digit}|[0-9])[ ,-]*)+(?<![ ,-])(?![A-Za-z])", re.I | re.A)
IN_DIGITS = re.compile(rf"({_digit}|plus)[ ,-]*|([0-9])[ ,-]*(?={_digit})", re.I | re.A)
RUN_PART = re.compile(rf"plus|{_digit}|[0-9]", re.I | re.A)
SIGN = re.compile(r"[\[({<]\s*(?:at|dot)\s*[\])}>]", re.I | re.A)
BRACKETED = re.compile(r"\s*[\[({<]\s*(at|dot)\s*[\])}>]\s*", re.I | re.A)
IN_WORDS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?: dot [A-Za-z0-9._%+-]+)*( at |@)[A-Za-z0-9-]+(?:( dot |\.)[A-Za-z0-9-]+)+", re.I | re.A)
NAMED = re.compile(r"@| dot |\.[A-Z-]*[A-Z]{2}$", re.I | re.A)  # else "at 5.30" is a host


def _homoglyphs() -> dict[int, str]:
    table = {ord(a): b for a, b in zip(LOOKS, ASCII, strict=True)}
    table |= {p: chr(p - 0xFEE0) for p in range(0xFF10, 0xFF5B) if chr(p - 0xFEE0).isalnum()}
    for start in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        table |= {start + k: str(unicodedata.digit(chr(start + k))) for k in range(10)}
    return table


LOOKALIKE = _homoglyphs()
STRANGE = frozenset(map(chr, LOOKALIKE)) | frozenset(HIDDEN)


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Each match has one "@": its host follows, its name is what stands before it since the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (host := HOST.match(text, at + 1)):
            yield start, host.end()
            last = host.end()
        at = text.find("@", max(at + 1, last))


def plain(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of the identifiers as they stand, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split("."))):
                out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m.group())) <= 15]
    return out


class Tape:
    """A text on its way to normal form, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint, ascending spans; each new character stands for the whole span."""
        if not edits:
            return
        if self.start is None:
            self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, start, end, last = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[last:a], new]
            start += self.start[last:a] + [self.start[a]] * len(new)
            end += self.end[last:a] + [self.end[b - 1]] * len(new)
            last = b
        self.text = "".join([*text, self.text[last:]])
        self.start, self.end = start + self.start[last:], end + self.end[last:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Identifiers that only normalising brings out, as spans of the source."""
    odd = not text.isascii() and not STRANGE.isdisjoint(text)
    low = text.lower()
    signs = "dot" in low or " at " in low or SIGN.search(text) is not None
    spelled = any(w in low for w in DIGITS)
    if not (odd or signs or spelled):
        return []
    tape = Tape(text)
    if odd:
        tape.rewrite([(i, i + 1, "" if c in HIDDEN else LOOKALIKE[ord(c)]) for i, c in enumerate(text) if c in STRANGE])
    if SIGN.search(tape.text):
        tape.rewrite([(m.start(), m.end(), "@" if m[1].lower() == "at" else ".") for m in BRACKETED.finditer(tape.text)])
    low = tape.text.lower()
    if " dot " in low or " at " in low:
        edits = []
        for m in IN_WORDS.finditer(tape.text):
            if NAMED.search(m.group()):
                edits += [(m.start() + k.start(), m.start() + k.end(), "@" if k.start() + m.start() == m.start(1) else ".")
                          for k in re.finditer(r" (?:at|dot) ", m.group(), re.I)]
        tape.rewrite(edits)
    runs, edits = [], []
    if spelled or odd:
        for m in RUN.finditer(tape.text):
            parts = RUN_PART.findall(m.group())
            if (sum(len(p) > 1 for p in parts) >= SPELLED and 8 <= sum(p.lower() != "plus" for p in parts) <= 15
                    and not IP.fullmatch(in_digits(m.group()))):
                runs.append(("phone", *tape.source(m.start(), m.end())))
        for m in WORDED.finditer(tape.text):
            if not m.group().isdigit() and (digits := in_digits(m.group())) != m.group():
                edits.append((m.start(), m.end(), digits))
    if tape.start is None and not edits:
        return []  # nothing was rewritten, so nothing new can be found
    # Names and hosts of addresses may hold digits in words, so they are read before those become digits.
    found = [(kind, *tape.source(a, b)) for kind, a, b in plain(tape.text) if kind == "email"]
    tape.rewrite(edits)
    found += [(kind, *tape.source(a, b)) for kind, a, b in plain(tape.text) if kind != "email"]
    return [f for f in found if f[0] != "ip"] + runs + [f for f in found if f[0] == "ip"]


def in_digits(run: str) -> str:
    """A run with its words as digits; what parts a word from its neighbour goes, what parts two digits stays."""
    def digit(m):
        return m[2] or ("+" if (w := m[1].lower()) == "plus" else DIGITS[w])

    return IN_DIGITS.sub(digit, run)


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """All finds, ``kind, start, end, plain``, by kind and start."""
    found = [(*s, True) for s in plain(text)]
    taken = [(a, b) for _, a, b, _ in found]
    for kind, a, b in disguised(text):
        if all(b <= x or y <= a for x, y in taken):
            found.append((kind, a, b, False))
            taken.append((a, b))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def masked(text: str) -> str:
    """The text with each find replaced by its kind in brackets; overlapping finds become one."""
    out, last = [], 0
    for kind, a, b, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]]) if out else text


SPANS = "array<struct<kind:string,start:int,end:int,plain:boolean>>"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``spans``, an array of (kind, start, end, plain) by kind and start."""
    ship_package(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())]))

    def find(batches):
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end", "plain"), s, strict=True)) for s in spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["_id", "spans"])

    src = docs.select(F.col(id_col).alias("_id"), body(text_col).alias("_text"))
    out = src.mapInArrow(find, f"_id {src.schema['_id'].dataType.simpleString()}, spans {SPANS}")
    return out.withColumnRenamed("_id", id_col)


def spelled_out(found: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each find in ``text_col`` replaced by its kind; nulls stay null."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: None if t is None else masked(t))

    return docs.withColumn(text_col, mask(F.col(text_col)))
