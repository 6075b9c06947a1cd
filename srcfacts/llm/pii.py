"""Personal data with source offsets, through disguises.

Base spans come from the texts as they are: per kind the leftmost, non-overlapping matches of its expression, kept if
they pass the kind's check. Then a chain of transducers rewrites disguised text - homoglyphs and wide forms, invisible
characters, "[at]" and "dot", digits spelled as words - and keeps for every character it writes the source span that it
stands for. Identifiers found in the rewritten text are mapped back; those that touch no base span of their kind are
added. Offsets are code points, ends exclusive.

Null and empty texts have no spans; texts of any length are read whole; extra columns are ignored and repeated rows
keep a row each.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcfacts.llm.base import text_pass

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of ``ip`` never begins inside a run of digits, so looking back changes nothing but the time on long runs.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ back over the local part: a leftmost match begins where that run does."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        run = text[free:at]
        size = len(run) - len(run.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if size else None
        if m:
            found.append((at - size, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {"email": emails(text)}
    found["ip"] = [m.span() for m in IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split("."))]
    found["card"] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := DIGITS.sub("", m[0])) <= 19 and luhn(d)]
    found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGITS.sub("", m[0])) <= 15] if "+" in text else []
    return found


# --- transducers -------------------------------------------------------------------------------------------------
# Each takes (characters, source begins, source ends) and returns the same for what it writes.

#: Letters of other scripts that look like a Latin one.
LOOKALIKE = {
    **dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁһ", "ABEKMHOPCTYXaeopcyxijsdh", strict=True)),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοι", "ABEZHIKMNOPTYXvoi", strict=True)),
    **dict(zip("‐‑‒–—−﹣·•。․", "------- ...".replace(" ", "."), strict=True)),
}
LOOKALIKE |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # wide forms of ASCII
LOOKALIKE |= {chr(base + i): chr(48 + i) for base in (0x0660, 0x06F0, 0x0966) for i in range(10)}  # other scripts' digits
INVISIBLE = "​‌‍⁠﻿­"
ODD = re.compile("[" + re.escape("".join(LOOKALIKE)) + INVISIBLE + "]")

#: Digits in words: English, French, German, Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + "|[0-9]+)"
_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_GAP = r"(?:\s*[-,./]\s*|\s+|\s+(?:dot|point|punto|punkt)\s+)"
#: At least four digits, the first of them or the second in words, spelled one by one.
SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:plus\s+|\+\s*)?)(?:{_WORD}{_GAP}{_DIGIT}|[0-9]+{_GAP}{_WORD})(?:{_GAP}{_DIGIT}){{2,}}(?!\w)", re.I)
SPELLED_TOKEN = re.compile(rf"plus\s+|\+\s*|\s+(?:dot|point|punto|punkt)\s+|{_DIGIT}|\s*[-,./]\s*|\s+", re.I)
HINT = re.compile(rf"\b{_WORD}[\s,./-]+{_DIGIT}\b|\b[0-9]+[\s,./-]+{_WORD}\b", re.I)

BRACKETED = re.compile(r"[\[({<]\s*(at|dot|punkt|punto|point|arobase|arroba|@|\.)\s*[\])}>]\s*", re.I)
_AT, _DOT = "(?:at|arroba|arobase)", "(?:dot|punto|punkt|point)"
AT = re.compile(rf"@|(?<=[\s_-]){_AT}(?:\s+|[_-])", re.I)
DOT = re.compile(rf"\.|(?:\s+|[_-]){_DOT}(?:\s+|[_-])", re.I)
#: A hyphen that begins "-at-" or "-dot-" isn't a label's own, so that an address reads in one way only.
LABEL = re.compile(rf"(?:[A-Za-z0-9]|-(?!(?:{_AT}|{_DOT})[\s_-]))+", re.I)
ENDINGS = frozenset("com org net edu gov io info example test co de fr es uk us eu".split())
LOCAL_ONLY = re.compile(r"[A-Za-z]*[0-9._%+-]")
#: Letters that stand for digits inside a number.
DIGIT_LIKE = {"O": "0", "o": "0", "l": "1", "I": "1"}
DIGIT_RUN = re.compile(r"(?<![A-Za-z0-9])[+]?[0-9OolI][0-9OolI ().-]{6,}[0-9OolI](?![A-Za-z0-9])")
DIGIT_HINT = re.compile(r"[0-9][ ().-]?[OolI](?![a-km-np-zA-HJ-NP-Z])")
#: A cheap sign of bracketed words.
BRACKET_HINT = re.compile(r"[\[({<]\s*(?:at|dot|punkt|punto|point|arobase|arroba|@|\.)\s*[\])}>]", re.I)
APART = bytes(32 if b in b",./-+" else b for b in range(256))
SPELLED_BYTES = frozenset(w.encode() for w in SPELLED)


class Tape:
    """Text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.begins, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, new text), sorted and apart; each new character stands for the whole old span."""
        parts, begins, ends, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            begins += self.begins[at:a]
            ends += self.ends[at:a]
            if b > a:
                begins += [self.begins[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        self.text = "".join([*parts, self.text[at:]])
        self.begins, self.ends = begins + self.begins[at:], ends + self.ends[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.begins[a], self.ends[b - 1]


def _look_alikes(tape: Tape) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), LOOKALIKE.get(m[0], "")) for m in ODD.finditer(tape.text)]


def _brackets(tape: Tape) -> list[tuple[int, int, str]]:
    """The blanks around a bracket go with it."""
    text, edits, free = tape.text, [], 0
    for m in BRACKETED.finditer(text):
        start = free + len(text[free : m.start()].rstrip())
        edits.append((start, m.end(), "@" if m[1].lower() in ("at", "@", "arobase", "arroba") else "."))
        free = m.end()
    return edits


def addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits of bare "at" and "dot", only where they stand in a whole address with a well-known ending.

    One pass: each "at" (or @) with the name before it, back to the last "at" at most, and the labels behind it, up to the
    next. With plain dots only, the name has to look like more than a word: "look at example.com" is no address.
    """
    edits: list[tuple[int, int, str]] = []
    free = 0
    for m in AT.finditer(text):
        plain = m[0] == "@"
        before = text[free : m.start()]
        gap = 0 if plain else 1 if before[-1:] in ("_", "-") else len(before) - len(before.rstrip())
        name = before[: len(before) - gap]
        start = free + len(name.rstrip(LOCAL))
        begin, free = free, m.end()
        if start == begin + len(name) or start and (text[start - 1].isalnum() or text[start - 1] == "_") and start > begin:
            continue
        found: list[tuple[int, int, str]] = [] if plain else [(begin + len(name), m.end(), "@")]
        at, worded, kept = m.end(), False, 0
        label = LABEL.match(text, at)
        while label:
            at = label.end()
            dot = DOT.match(text, at)
            after = dot and LABEL.match(text, dot.end())
            if not after:
                break
            if dot[0] != ".":
                found.append((*dot.span(), "."))
            label = after
            if after[0].lower() in ENDINGS and not (text[after.end() : after.end() + 1].isalnum() or text[after.end() : after.end() + 1] == "_"):
                kept, worded = len(found), any(e[2] == "." for e in found)
                free = after.end()
        if free > m.end() and (worded or LOCAL_ONLY.match(text, start)):
            edits += found[:kept]
    return edits


def _bare_words(tape: Tape) -> list[tuple[int, int, str]]:
    return addresses(tape.text)


def _spelled(tape: Tape) -> list[tuple[int, int, str]]:
    edits = []
    for m in SPELLED_RUN.finditer(tape.text):
        for t in SPELLED_TOKEN.finditer(tape.text, *m.span()):
            low = t[0].strip().lower()
            new = "+" if low in ("plus", "+") else "." if low in ("dot", "point", "punto", "punkt", ".") else SPELLED.get(low, low if low.isdigit() else "")
            edits.append((*t.span(), new))
    return edits


def _digit_letters(tape: Tape) -> list[tuple[int, int, str]]:
    """In runs of six digits or more."""
    runs = [m for m in DIGIT_RUN.finditer(tape.text) if sum(c in "0123456789" for c in m[0]) >= 6]
    return [(i, i + 1, DIGIT_LIKE[tape.text[i]]) for m in runs for i in range(*m.span()) if tape.text[i] in DIGIT_LIKE]


def _needed(text: str) -> list[Callable]:
    """The transducers that have something to rewrite in this text."""
    plain = text.isascii()
    steps: list[Callable] = []
    if not plain and ODD.search(text):
        steps.append(_look_alikes)
    low = text.lower()
    if steps or BRACKET_HINT.search(text):
        steps.append(_brackets)
    if steps or ("at" in low or "@" in low or "aro" in low or "arr" in low) and addresses(text):
        steps.append(_bare_words)
    if steps or sum(map(SPELLED_BYTES.__contains__, low.encode("utf-8", "surrogatepass").translate(APART).split())) > 1 and HINT.search(text):
        steps.append(_spelled)
    if steps or DIGIT_HINT.search(text):
        steps.append(_digit_letters)
    return steps


def _apart(spans: list[tuple[int, int]], own: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch none of ``own``, which are sorted and apart."""
    begins = [a for a, _ in own]
    return [(a, b) for a, b in spans if not (k := bisect_left(begins, b)) or own[k - 1][1] <= a]


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, all spans) by kind, each sorted."""
    base = base_spans(text)
    steps = _needed(text)
    if not steps:
        return base, base
    tape, changed = Tape(text), False
    for step in steps:
        if edits := [e for e in step(tape) if tape.text[e[0] : e[1]] != e[2]]:
            tape.rewrite(edits)
            changed = True
    if not changed:
        return base, base
    every = {}
    for kind, spans in base_spans(tape.text).items():
        mapped = [tape.source(a, b) for a, b in spans]
        every[kind] = sorted([*base[kind], *_apart(mapped, base[kind])])
    return base, every


def _text_of(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind,start,end>>) of every row."""

    def run(texts: list[str]) -> list:
        return [[[{"kind": k, "start": a, "end": b} for k in KINDS for a, b in found[k]] for t in texts for found in [find(t)[1]]]]

    return text_pass(docs, run, [T.StructField("spans", SPANS)], id_col, text_col)


def redact(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans one mark remains."""
    spans = sorted((a, b, k) for k, found in find(text)[1].items() for a, b in found)
    parts, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            parts += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced in the text, in one pass; null texts stay null, other columns, whatever
    their names, as they are."""
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("row"), F.col(f"`{text_col}`").isNull().alias("missing"), F.col(f"`{text_col}`").alias("text"))
    out = text_pass(packed, lambda texts: [[redact(t) for t in texts]], [T.StructField("clean", T.StringType())], "row", "text", ("missing",))
    place = {c: F.col(f"row.c{i}") for i, c in enumerate(others)} | {text_col: F.when(~F.col("missing"), F.col("clean"))}
    return out.select(*[place[c].alias(c) for c in docs.columns])


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def run(texts: list[str]) -> list:
        rows = []
        for t in texts:
            base, every = find(t)
            rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(_text_of(base).encode()).hexdigest(), _text_of(every)))
        return list(map(list, zip(*rows, strict=True))) if rows else [[]] * 6

    longs = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    return text_pass(docs, run, [*longs, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
