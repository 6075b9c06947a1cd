"""Secrets in texts: every rule in one pass of one minimal automaton over the text's bytes.

The combined automaton reports where a rule's trigger ends; the rule's reversed automaton walks back to the leftmost
start, and its own automaton walks on to the longest end. Matches of a kind don't overlap; a match that fails its
rule's length check is dropped and what it covers isn't tried again. Offsets are code points, ends exclusive.

Null and empty texts have no spans. Texts of any length are scanned whole; extra columns are ignored and repeated
rows keep a row each.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from srcfacts.llm.automaton import Automaton
from srcfacts.llm.base import text_pass


class Rule(NamedTuple):
    kind: str
    pattern: str
    fold: bool = False  # letters of the pattern in either case
    least: int = 0  # characters of the match at least
    trigger: str = ""  # what the combined automaton looks for; empty: the pattern
    group: str = ""  # the match's last run of this class has ``group_least`` characters at least
    group_least: int = 0


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    Rule("assign", ASSIGN, True, 0, ASSIGN.replace("]+)", "])"), ASSIGN, 12),
    Rule("access", r"AKIA[A-Z0-9]+", False, 18, r"AKIA[A-Z0-9]"),
    Rule("hex", r"[0-9a-f]+", False, 16, r"[0-9a-f]{16}"),
]
#: Formats of well-known issuers, beyond the base.
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", False, 40, r"gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 15, r"xox[abprs]-[A-Za-z0-9]"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", False, 24, r"[sr]k_live_[A-Za-z0-9]"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", False, 39, r"AIza[A-Za-z0-9_-]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", False, 0, ""),
    Rule("url", r"[a-z][a-z0-9+.-]*://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@[A-Za-z0-9.-]+", False, 0, r"[a-z0-9+.-]://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@[A-Za-z0-9.-]"),
]


class Scanner:
    """The compiled rules; a few hundred states, built once in each Python worker."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.all = Automaton([(r.trigger or r.pattern, r.fold) for r in rules], anywhere=True)
        self.back = [Automaton([(r.trigger or r.pattern, r.fold)], anywhere=False, backwards=True) for r in rules]
        self.ahead = [Automaton([(r.pattern, r.fold)], anywhere=False) for r in rules]
        self.wide_start = [r.kind == "url" for r in rules]
        self.checks = [re.compile(r.group.encode(), re.I if r.fold else 0) if r.group else None for r in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, sorted."""
        found: list[tuple[int, int, int]] = []
        whole, step, s, accepting = self.all, self.all.step, self.all.start, self.all.accepting
        free = [0] * len(self.rules)  # up to here a rule's text is used up
        codes = iter(data.translate(whole.classes))
        for c in codes:
            s = step[s + c]
            if s >= accepting:
                self._hit(data, len(data) - codes.__length_hint__(), whole.rules[s], free, found)
        return sorted(found, key=lambda s: (s[0], s[2]))

    def _hit(self, data: bytes, at: int, rules: tuple[int, ...], free: list[int], found: list) -> None:
        for k in rules:
            if at <= free[k]:
                continue
            rule, back, ahead = self.rules[k], self.back[k], self.ahead[k]
            low = free[k]
            # translating a slice keeps this linear in the match, not in the text
            start = self._back(back, data, at, low)
            if start < 0:
                continue
            if self.wide_start[k]:  # the scheme may be longer than its trigger's one character
                while start > low and data[start - 1 : start] in SCHEME:
                    start -= 1
                while start < at and not data[start : start + 1].islower():
                    start += 1
            end = self._ahead(ahead, data, start)
            if end < 0:
                continue
            free[k] = end
            check = self.checks[k]
            long = end - start >= rule.least and (check is None or len(check.fullmatch(data, start, end)[2]) >= rule.group_least)
            if long:
                found.append((start, end, k))

    @staticmethod
    def _back(auto: Automaton, data: bytes, at: int, low: int) -> int:
        s, best, step, classes = auto.start, -1, auto.step, auto.classes
        while at > low:
            at -= 1
            s = step[s + classes[data[at]]]
            if s >= auto.accepting:
                best = at
            elif s == auto.dead:
                break
        return best

    @staticmethod
    def _ahead(auto: Automaton, data: bytes, at: int) -> int:
        s, best, step, classes = auto.start, -1, auto.step, auto.classes
        for at in range(at, len(data)):
            s = step[s + classes[data[at]]]
            if s >= auto.accepting:
                best = at + 1
            elif s == auto.dead:
                break
        return best


SCHEME = frozenset(bytes([b]) for b in b"abcdefghijklmnopqrstuvwxyz0123456789+.-")
_built: dict[tuple, Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _built:
        _built[rules] = Scanner(list(rules))
    return _built[rules]


def find(text: str, rules: tuple[Rule, ...] = (*BASE, *MORE)) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then by the rules' order."""
    data = text.encode("utf-8", "surrogatepass")
    spans = scanner(rules).spans(data)
    if len(data) == len(text) or not spans:
        return [(a, b, rules[k].kind) for a, b, k in spans]
    marks, seen, chars = {}, 0, 0
    for at in sorted({x for a, b, _ in spans for x in (a, b)}):
        chars += len(data[seen:at].decode("utf-8", "surrogatepass"))
        marks[at], seen = chars, at
    return [(marks[a], marks[b], rules[k].kind) for a, b, k in spans]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = (*BASE, *MORE)) -> DataFrame:
    """(id, spans array<struct<kind,start,end>>) of every row."""

    def run(texts: list[str]) -> list:
        return [[[{"kind": k, "start": a, "end": b} for a, b, k in find(t, rules)] for t in texts]]

    return text_pass(docs, run, [T.StructField("spans", SPANS)], id_col, text_col)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = {r.kind for r in BASE}

    def run(texts: list[str]) -> list:
        rows = []
        for t in texts:
            spans = find(t)
            own = [s for s in spans if s[2] in base]
            rows.append((*(sum(k == r.kind for _, _, k in own) for r in BASE), hashlib.sha256(joined(own).encode()).hexdigest(), joined(spans)))
        return list(map(list, zip(*rows, strict=True))) if rows else [[]] * 5

    longs = [T.StructField(f"n_{r.kind}", T.LongType()) for r in BASE]
    return text_pass(docs, run, [*longs, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
