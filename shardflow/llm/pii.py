"""Personal data, also in disguise, at its place in the source text.

Plain identifiers are found in the text as it stands.  A second reading goes
through transducers, each of which rewrites the text and keeps, for every
letter written, the range of source letters it came from:

1. look-alike letters, digits of other scripts and full-width forms become ASCII,
   invisible letters vanish;
2. runs of spelled digits ("plus one five five ...") become digits, a spelled dot
   inside them a dot;
3. disguised addresses ("name [at] host dot org") get their signs.

What the same detectors find in the rewritten text is mapped back and added,
unless a plain find of its kind already covers it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.words import pieces

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is entered at its first one: from a later one the rest would match alike.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters that look like another one, digits in words, spelled signs.
LOOKALIKES = dict(
    zip("авеёзікмнорстухѕјһԁԛԝүАВЕЗІКМНОРСТУХЅЈԚԜαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abee3ikmhopctyxsjhdqwyABE3IKMHOPCTYXSJQWaeikvoptuxABEZHIKMNOPTYX")
)
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
DOT_WORDS = ("dot", "punkt", "point", "punto")
#: Ends of addresses that are believed where both signs are bare words.
ENDINGS = "com|net|org|edu|gov|mil|info|biz|io|ai|app|dev|fr|uk|eu|ca|ch|nl|pl|ru|jp|cn|br|mx"
#: Ends that are also common words: only behind a dot in brackets or another dot of the host, or where the clause ends.
WORD_ENDINGS = "co|de|es|us|se|in|au"
INVISIBLE = frozenset("­​‌‍‎‏⁠⁡⁢⁣﻿")

_words = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_dots = "|".join(DOT_WORDS)
SPELLED = re.compile(
    rf"(?<!\w)(?:plus[\s,-]+)?(?:{_words})(?!\w)(?:[\s,.-]{{1,3}}(?:{_words}|{_dots}|[0-9]+)(?!\w)){{3,}}", re.I
)  # four digits at least
SPELLED_PART = re.compile(rf"(plus)|({_words})|({_dots})|([0-9]+)|[\s,.-]+", re.I)
_open, _close = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
AT = rf"{_open}(?:at|@){_close}|\s?@\s?|[_-]at[_-]"
_bracketed = rf"{_open}(?:{_dots}|\.){_close}"
DOT = rf"{_bracketed}|\s(?:{_dots})\s|\.|[_-]dot[_-]"
WORD_AT = r"\sat\s"
WORD_DOT = rf"{_bracketed}|\s(?:{_dots})\s"
# Between bare words "at this point in time" is prose: there the other dot words count in brackets only.
BARE_DOT = rf"{_bracketed}|\sdot\s"
_host = r"[A-Za-z0-9-]+"
_known = rf"(?:{_host}(?:{BARE_DOT}))+(?:{ENDINGS})(?![\w-])"
_longer = rf"(?:{_host}(?:{BARE_DOT}))*{_host}(?:(?:{BARE_DOT}){_host}(?:{BARE_DOT})|{_bracketed})(?:{WORD_ENDINGS})(?![\w-])"
_closing = rf"{_host}(?:{BARE_DOT})(?:{WORD_ENDINGS})(?![\w-])(?=[^\S\n]*(?:\Z|[\n.,;:!?)\]}}>\"']))"
# An address from its sign on; the part in front is read to the left, as long as it goes.
SIGNED = rf"(?:{AT}){_host}(?:(?:{DOT}){_host})+"
SPOKEN = rf"{WORD_AT}(?!(?:an?|the|this|that|some|any)\s)(?:{_known}|{_longer}|{_closing})"
FROM_SIGN = re.compile(rf"({SIGNED})|{SPOKEN}", re.I)
PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789%+_-")
SIGNED_DOT = re.compile(DOT, re.I)
SPOKEN_DOT = re.compile(rf"{BARE_DOT}|\.|[_-]dot[_-]", re.I)
HINT = re.compile(rf"[\[({{<]\s?(?:at|@|{_dots}|\.)\s?[\])}}>]|\s(?:{_dots})\s|\s@|@\s|[_-](?:at|dot)[_-]", re.I)
SIGN = re.compile(rf"({AT}|{WORD_AT})|({WORD_DOT}|[_-]dot[_-])", re.I)

Span = tuple[str, int, int]
#: Text and, for every letter, the source range it came from.
Mapped = tuple[str, list[int], list[int]]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text: str) -> list[Span]:
    """Identifiers as they stand: leftmost, not overlapping for each kind; finds that fail the check are dropped."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            out.append(("email", start, tail.end()))
            done = tail.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def folded_letter(c: str) -> str:
    """What a letter stands for: ASCII for look-alikes, else itself."""
    if c < "\x80":
        return c
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    wide = unicodedata.normalize("NFKC", c)
    return wide if wide.isascii() else c


def unmasked(text: str) -> Mapped | None:
    """The text with look-alike letters folded; nothing if there are none."""
    if text.isascii():
        return None
    fold = {c: folded_letter(c) for c in set(text) if c >= "\x80"}
    fold = {c: to for c, to in fold.items() if to != c}
    if not fold:
        return None
    out, start = [], []
    for k, c in enumerate(text):
        to = fold.get(c, c)
        out.append(to)
        start += [k] * len(to)
    return "".join(out), start, [k + 1 for k in start]


def rewritten(held: Mapped, edits: list[tuple[int, int, str]]) -> Mapped:
    """Replace ranges of letters; a replacement comes from its whole range."""
    text, start, end = held
    parts, s, e, at = [], [], [], 0
    for lo, hi, to in edits:
        parts += [text[at:lo], to]
        s += start[at:lo] + [start[lo]] * len(to)
        e += end[at:lo] + [end[hi - 1]] * len(to)
        at = hi
    return "".join([*parts, text[at:]]), s + start[at:], e + end[at:]


def digits_written(held: Mapped) -> Mapped:
    edits = []
    for run in SPELLED.finditer(held[0]):
        for part in SPELLED_PART.finditer(held[0], *run.span()):
            plus, word, dot, digits = part.groups()
            to = "+" if plus else DIGIT_WORDS[word.lower()] if word else "." if dot else digits or ""
            edits.append((*part.span(), to))
    return rewritten(held, edits) if edits else held


def disguised_runs(text: str) -> Iterator[tuple[int, int]]:
    """Where disguised addresses stand: found by their sign, with all dotted parts in front of it."""
    dots: dict[re.Pattern, dict[int, int]] = {}
    at, done = 0, 0
    while tail := FROM_SIGN.search(text, at):
        pattern = SIGNED_DOT if tail.group(1) else SPOKEN_DOT
        if pattern not in dots:
            dots[pattern] = {m.end(): m.start() for m in pattern.finditer(text)}
        start = left = tail.start()
        while left > done and text[left - 1] in PART:
            while left > done and text[left - 1] in PART:
                left -= 1
            start = left
            left = dots[pattern].get(left, 0)
        if start == tail.start():
            at = start + 1
            continue
        yield start, tail.end()
        at = done = tail.end()


def signs_written(held: Mapped) -> Mapped:
    edits = []
    for run in disguised_runs(held[0]):
        for sign in SIGN.finditer(held[0], *run):
            edits.append((*sign.span(), "@" if sign.group(1) else "."))
    return rewritten(held, edits) if edits else held


def disguised(text: str, known: list[Span]) -> list[Span]:
    """Further identifiers, found after rewriting; source places."""
    held = unmasked(text)
    base = held[0] if held else text
    if held is None and not HINT.search(base) and not SPELLED.search(base):
        return []
    if held is None:
        held = (text, list(range(len(text))), list(range(1, len(text) + 1)))
    first = digits_written(held)
    found = {(kind, form[1][a], form[2][b - 1]) for form in (first, signs_written(first)) for kind, a, b in plain(form[0])}
    return outermost(found, known)


def outermost(found: Iterable[Span], known: Iterable[Span]) -> list[Span]:
    """Of ``found``, the spans inside no span of their kind in ``known`` and in no wider one of their own; one sort and one walk."""
    out = []
    reach: dict[str, int] = {}  # how far the spans of a kind go that began so far
    for (kind, a, b), new in sorted([(k, False) for k in known] + [(f, True) for f in found], key=lambda s: (s[0][1], -s[0][2], s[1])):
        if b > reach.get(kind, -1):
            reach[kind] = b
            if new:
                out.append((kind, a, b))
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def personal_data(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with ``spans``: ``(kind, start, end, plain)`` of every find.

    Places count code points, ends are exclusive, and order is by start, then
    kind.  Plain finds of a kind don't overlap; a disguised one may contain a
    plain one it extends.  A null or empty text has none.  A column of
    ``docs`` named like ``spans`` is replaced.
    """
    kept = docs.drop(spans)
    fields = [*kept.columns, spans]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, 4 << 20):
                out = []
                for content in piece.column(text).to_pylist():
                    base = plain(content) if content else []
                    more = disguised(content, base) if content else []
                    known = set(base)
                    out.append([{"kind": k, "start": s, "end": e, "plain": (k, s, e) in known} for k, s, e in ordered(base + more)])
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(out, kind)], fields)

    schema = kept.withColumn(spans, F.lit(None).cast("array<struct<kind:string,start:int,end:int,plain:boolean>>")).schema
    return kept.mapInArrow(run, schema)


def redacted(found: DataFrame, text: str = "text", spans: str = "spans", column: str = "redacted") -> DataFrame:
    """``found`` with the text in which every span is replaced by its kind in square brackets; overlapping spans become one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    content = F.coalesce(F.col(text), F.lit(""))

    def step(acc, s):
        gap = F.substring(content, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        added = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), added.alias("out"))

    whole = F.aggregate(F.coalesce(spans, F.array().cast("array<struct<kind:string,start:int,end:int,plain:boolean>>")), start, step, lambda acc: F.concat(acc["out"], F.substring(content, acc["at"] + 1, F.length(content))))
    return found.withColumn(column, whole)
