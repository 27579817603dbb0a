"""Personal data with offset-preserving deobfuscation (operator 3).

Base identifiers are found in the text as it stands. Transducers then rewrite disguises
(homoglyphs, spelled digits, at/dot words) and keep, for each rewritten piece, where it came from;
the same detectors run on the rewritten text, and what they find there is mapped back to source
characters. Every detector is linear in the text: a run of characters is read once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import released, table, values

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind's number, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(int(x) * 2 - 9 * (x > "4") for x in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; matches that fail their check are dropped."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, lo, end := m.end()))
            at = text.find("@", end)
        else:
            end, at = at + 1, text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        parts, lo = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            hi = lo + sum(map(len, four := parts[i : i + 4])) + 3
            if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in four):
                out.append((1, lo, hi))
            lo = hi + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(x.isdigit() for x in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# Characters that look like ASCII ones and that no compatibility form maps there.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορт", "ABESIJKMHOPCTYXaesijopcyxABEZHIKMNOPTYXavopt", strict=True))
DIGIT_WORDS = {w: str(i % 10) for i, w in enumerate("zero one two three four five six seven eight nine oh".split())} | {"oh": "0"}
MIN_SPELLED = 4  # digit words in a row

_D = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:plus[\s,-]++)?+(?:{_D})(?:[\s,-]++(?:{_D})){{{MIN_SPELLED - 1},}}+(?![^\W_])")
#: What stands for a sign: in brackets, as a word of its own, or as a sign with white space around it.
_BRACKET = re.compile(r"(?i)(?<!\s)\s*+[\[({<]\s*+(at|dot|@|\.)\s*+[\])}>]\s*+")
_WORDS = re.compile(r"(?i)(?<=[a-z0-9])\s++(at|dot|punkt|point|punto)\s++(?=[a-z0-9])")
_SPACED = re.compile(r"(?i)(?<=[a-z0-9])\s++@\s*+(?=[a-z0-9])|(?<=[a-z0-9])@\s++(?=[a-z0-9])")
_JOINED = re.compile(r"(?i)(?<=[a-z0-9])([_-])(at|dot)\1(?=[a-z0-9])")
_NUMBERS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){0,3}")
#: Letters that stand for digits in a word of a number, or alone for a part of an address. Fixed values.
LETTER_DIGITS = dict(zip("OoIlSBZ", "0011582", strict=True))
_LETTERED = re.compile(r"(?<![A-Za-z0-9_])[0-9OoIlSBZ]++(?![A-Za-z0-9_])")
_LETTER_NEAR = re.compile(r"[0-9][OoIlSBZ]|[OoIlSBZ][0-9]|[0-9]\.[OoIl](?![A-Za-z])")
_REFERENCE = re.compile(r"(?i)&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|commat|period|plus|lowbar|hyphen);")
_LABEL = re.compile(r"[A-Za-z0-9._%+@-]*+")
_NON_ASCII = re.compile(r"[^\x00-ɏḀ-ỿ]")


def plain(ch: str) -> str:
    """The ASCII letter, digit or sign that a character looks like, else the character itself."""
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    if ch in "​‌‍⁠﻿­":
        return ""
    if unicodedata.category(ch) == "Nd":
        return str(unicodedata.digit(ch))
    if unicodedata.category(ch) == "Pd":
        return "-"
    flat = unicodedata.normalize("NFKC", ch)
    return flat if len(flat) == 1 and flat.isascii() else ch


class Rewritten:
    """A text with some pieces replaced, and for each place in it the span of the source."""

    def __init__(self, text: str, pieces: list[tuple[int, int, str]]):
        self.out_at, self.src, out, at, n = [0], [(0, 0, False)], [], 0, 0
        for lo, hi, new in pieces:
            out += (text[at:lo], new)
            n += lo - at
            self.out_at += (n, n + len(new))
            self.src += ((lo, hi, True), (hi, hi, False))
            n, at = n + len(new), hi
        self.text = "".join(out) + text[at:]

    def span(self, lo: int, hi: int) -> tuple[int, int, bool]:
        """Source start and end of out[lo:hi], and whether a replaced piece is among it."""
        i, j = bisect_right(self.out_at, lo) - 1, bisect_right(self.out_at, hi - 1) - 1
        a, b = self.src[i], self.src[j]
        start = a[0] if a[2] else a[0] + lo - self.out_at[i]
        end = b[1] if b[2] else b[0] + hi - self.out_at[j]
        return start, end, any(self.src[x][2] for x in range(i, j + 1))


def _spelled(m: re.Match) -> str:
    return "".join("+" if w == "plus" else DIGIT_WORDS[w] for w in re.split(r"[\s,-]+", m.group().lower()))


#: (rewrites a text to pieces), in the order in which they are composed.
def _references(text: str) -> list[tuple[int, int, str]]:
    """Numeric and named references to a single printable ASCII character."""
    found = ((m, html.unescape(m.group() if m[0][1] == "#" else m.group().lower())) for m in _REFERENCE.finditer(text))
    return [(m.start(), m.end(), new) for m, new in found if len(new) == 1 and " " <= new <= "~"]


def _homoglyphs(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), new) for m in _NON_ASCII.finditer(text) if (new := plain(m.group())) != m.group()]


def _letters(text: str) -> list[tuple[int, int, str]]:
    """Words of digits and letters like them, with as many digits as letters at least; a letter alone after
    a number and a dot, for a part of an address."""
    out = []
    for m in _LETTERED.finditer(text) if _LETTER_NEAR.search(text) else ():
        word = m.group()
        letters = sum(c in LETTER_DIGITS for c in word)
        part = len(word) == 1 and m.start() > 1 and text[m.start() - 1] == "." and (text[m.start() - 2].isdigit() or text[m.start() - 2] in LETTER_DIGITS)
        if letters and (2 * letters <= len(word) or part):
            out.append((m.start(), m.end(), "".join(LETTER_DIGITS.get(c, c) for c in word)))
    return out


def _digits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), _spelled(m)) for m in _SPELLED.finditer(text)]


def _signs(text: str) -> list[tuple[int, int, str, bool]]:
    """What may stand for a sign, in order and apart from each other: start, end, sign, whether it surely does."""
    sign = lambda w: "@" if w.lower() in ("at", "@") else "."
    found = [(m.start(), m.end(), sign(m[1]), True) for m in _BRACKET.finditer(text)]
    found += [(m.start(), m.end(), "@", True) for m in _SPACED.finditer(text)]
    found += [(m.start(), m.end(), sign(m[1]), False) for m in _WORDS.finditer(text)]
    found += [(m.start(), m.end(), sign(m[2]), False) for m in _JOINED.finditer(text)]
    out, end = [], 0
    for x in sorted(found):
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def _address(labels: list[str], signs: list[str]) -> list[bool]:
    """Which dots join numbers to four parts; labels stand before, between and after the signs."""
    out, i = [False] * len(signs), 0
    numbers = [_NUMBERS.fullmatch(x.rstrip(".") if k == len(labels) - 1 else x) is not None for k, x in enumerate(labels)]
    while i < len(signs):
        j = i
        while j < len(signs) and signs[j] == "." and numbers[j] and numbers[j + 1]:
            j += 1
        parts = ".".join(labels[i : j + 1]).rstrip(".").split(".") if j > i else []
        if len(parts) == 4 and all(int(x) <= 255 for x in parts):
            out[i:j] = [True] * (j - i)
        i = max(j, i + 1)
    return out


def _at_dot(text: str) -> list[tuple[int, int, str]]:
    """Signs that only labels stand between are a chain of any length. A bare ``at`` counts where a dot
    comes next in its chain, which ends in no number, a bare ``dot`` where its chain has such an at sign or one in a label before it, and
    any dot of a chain that makes the four parts of an address of numbers, none over 255."""
    out, signs, i = [], _signs(text), 0
    while i < len(signs):
        j, labels = i, []
        while True:
            stop = signs[j + 1][0] if j + 1 < len(signs) else len(text)
            m = _LABEL.match(text, signs[j][1], stop)
            labels.append(m[0])
            j += 1
            if j == len(signs) or m.end() != stop or not m[0]:
                break
        chain, lo = signs[i:j], signs[i][0]
        floor = signs[i - 1][1] if i else 0
        while lo > floor and (text[lo - 1] in _LOCAL or text[lo - 1] == "@"):
            lo -= 1
        number = labels[-1].rstrip(".").isdigit()  # no domain ends in one
        counts = [sure or (s == "@" and k + 1 < len(chain) and chain[k + 1][2] == "." and "@" not in labels[k] and not number) for k, (_, _, s, sure) in enumerate(chain)]
        at = any(c and x[2] == "@" for c, x in zip(counts, chain, strict=True))
        counts = [c or k for c, k in zip(counts, _address([text[lo : signs[i][0]], *labels], [x[2] for x in chain]), strict=True)]
        before = "@" in text[lo : signs[i][0]]
        for (a, b, s, _), counted, label in zip(chain, counts, labels, strict=True):
            if counted or s == "." and (at or before):
                out.append((a, b, s))
            before = before or "@" in label
        i = j
    return out


_TRIGGER = re.compile(rf"(?i)&(?:#|commat|period|plus|lowbar|hyphen)|[_-]dot[_-]|[\[({{<]\s*+(?:at|dot|@|\.)\s*+[\])}}>]|\s@|@\s|\s(?:dot|punkt|point|punto)\s|\b(?:{_D})[\s,-]++(?:{_D})\b")


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only the rewritten text shows whole, in source characters; none lies within a base span of its kind."""
    glyphs = not text.isascii() and _NON_ASCII.search(text) is not None
    if not glyphs and not _TRIGGER.search(text) and not _LETTER_NEAR.search(text):
        return []
    layers, now = [], text
    for step in (_references, _homoglyphs, _letters, _digits, _at_dot):
        if pieces := step(now):
            layers.append(Rewritten(now, pieces))
            now = layers[-1].text
    ends = [[e for k, _, e in base if k == kind] for kind in range(len(KINDS))]
    starts = [[s for k, s, _ in base if k == kind] for kind in range(len(KINDS))]

    def held(kind: int, lo: int, hi: int) -> bool:
        """Whether a base span of the kind, which are in order, holds all of it."""
        i = bisect_right(ends[kind], lo)
        return i < len(ends[kind]) and starts[kind][i] <= lo and hi <= ends[kind][i]

    out = []
    for kind, lo, hi in base_spans(now) if layers else ():
        new = False
        for layer in reversed(layers):
            lo, hi, changed = layer.span(lo, hi)
            new |= changed
        if new and not held(kind, lo, hi):
            out.append((kind, lo, hi))
    return out


def _name(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for k, lo, hi in sorted(spans))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in values(b.column(1)):
            text = text or ""
            base = base_spans(text)
            more = added_spans(text, base)
            n = [0] * len(KINDS)
            for k, _, _ in base:
                n[k] += 1
            rows.append((*n, sha256(_name(base).encode()).hexdigest(), _name(base + more), len(more)))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every row: counts of base identifiers, the digest of their spans, all spans, and
    how many of them the transducers added. Null and empty texts have none. Repeated rows stay,
    other columns are ignored, no rows give no rows. Offsets are code points, ends exclusive."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(released(_find), SCHEMA)


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_pii() of all documents: a row for every row; nulls, repeats and empty tables as there."""
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL: dict[str, str] = {}
QUERIES = {"op3_pii_spans": op3_pii_spans}
