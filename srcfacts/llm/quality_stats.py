"""Counts of one text for the quality rules."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
DROP_SYMBOLS = bytes(range(256))


def repeated(words: list[bytes], k: int = 5) -> int:
    """Words inside ``k``-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    number = [seen.setdefault(w, len(seen)) for w in words]
    if len(seen) > len(words) - k:  # two equal windows repeat k words
        return 0
    ids, bits = np.array(number, np.int64), max(len(seen) - 1, 1).bit_length()
    if bits * k <= 63:
        keys = ids[:n].copy()
        for i in range(1, k):
            keys = keys << bits | ids[i : i + n]
    else:  # too many distinct words for one number: number the prefixes, one word at a time
        keys = ids[:n]
        for i in range(1, k):
            keys = np.unique(keys << bits | ids[i : i + n], return_inverse=True)[1].astype(np.int64)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.nonzero(twice)[0]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and for the outliers distinct words and lines with a word."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    blanks = len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r"))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text) - blanks,
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
        len(set(words)),
        len(lines),
    )
