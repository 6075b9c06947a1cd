import random
import re
import time

import pytest

from srcfacts.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if good(k, m[0])] for k, p in PLAIN.items()}


def test_base_matches_plain_expressions():
    rng = random.Random(3)
    bits = ["@", ".", "a", "B9", "-", "%", " ", "+", "1", "25", "255.", "4111111111111111", "4111 1111-1111 1111", "(", ")", "é", "x@y.z", "+1 (555) 123-4567", "\n", "\t"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(text) == brute(text), text
        base, every = pii.find(text)
        assert all(set(base[k]) <= set(every[k]) for k in pii.KINDS)


def test_disguises_map_back_to_the_source():
    cases = [
        ("email", "write to john.doe [at] example [dot] com now", "john.doe [at] example [dot] com"),
        ("email", "write to john.doe at example dot com now", "john.doe at example dot com"),
        ("email", "é jоhn@ехаmple.com!", "jоhn@ехаmple.com"),
        ("email", "mail jo​hn＠example．com ok", "jo​hn＠example．com"),
        ("phone", "call plus one five five five one two three four five six seven today", "plus one five five five one two three four five six seven"),
        ("card", "card four one one one one one one one one one one one one one one one end", "four one one one one one one one one one one one one one one one"),
        ("phone", "ruf +49 one two three four five six seven eight an", "+49 one two three four five six seven eight"),
        ("phone", "tel +1 (5O5) l23-4567 now", "+1 (5O5) l23-4567"),
        ("card", "no 4111-llll-1111-1111.", "4111-llll-1111-1111"),
        ("email", "correo ana arroba example punto org hoy", "ana arroba example punto org"),
        ("email", "or jane.doe at example.com thanks", "jane.doe at example.com"),
        ("email", "or john_at_example_dot_com thanks", "john_at_example_dot_com"),
        ("ip", "host 192 [dot] 168 (dot) 0 [.] 1 up", "192 [dot] 168 (dot) 0 [.] 1"),
    ]
    for kind, text, want in cases:
        base, every = pii.find(text)
        assert [text[a:b] for a, b in every[kind]] == [want] and set(base[kind]) < {*every[kind]}


def test_clean_text_and_redaction():
    for text in ("", "he was at the dot of one two", "look at this. Dot com", "one, two, three, four", "3 lol 4 Ill", "look at example.com", "meet at noon. Dot", "vol. 3 l. 12 o 14"):
        assert pii.find(text)[1] == {k: [] for k in pii.KINDS}, text
    assert pii.redact("a x@y.zz b 1.2.3.4") == "a <email> b <ip>"


def test_long_runs_stay_linear():
    assert pii.find("7" * 200_000 + "a" * 200_000 + "@")[1]["email"] == []


def test_odd_numbers_and_separators_neither_fail_nor_hang():
    assert pii.find("0" * 5000 + ".1.1.1")[0]["ip"] == [(0, 5006)]
    assert not pii.find("9" * 5000 + ".1.1.1")[0]["ip"]
    assert not pii.find("x@a" + "-dot-a" * 5000)[1]["email"]


TOKENS = ["x@a", "-dot-", "-at-", "a", " at ", " dot ", "0", ".1", "one ", "1 one ", "O", "(", "+1", "+ ", " ", "[at]", "[ ", "\n", "plus ", "1-", "@", "а", "​", "%", "_dot_", "l", "٣", "a@b.c ", "1.1.1.1 "]


@pytest.mark.parametrize("token", TOKENS)
def test_time_grows_with_the_text(token):
    """Twice the text takes about twice the time, for every transducer."""

    def taken(n: int) -> float:
        texts = [start + (token * (n // len(token) + 1))[:n] for start in ("", "x [at] a ", "one two three four ")]
        start = time.process_time()
        for t in texts:
            pii.find(t)
        return time.process_time() - start

    short = min(taken(15_000) for _ in range(2))
    assert taken(60_000) < 4 * 2.5 * max(short, 0.02)


def test_tape_maps_back_whatever_is_rewritten():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 30)))
        tape, plain = pii.Tape(text), [(c, i, i + 1) for i, c in enumerate(text)]
        for _ in range(3):
            cuts = sorted(rng.sample(range(len(plain) + 1), min(len(plain) + 1, 2 * rng.randint(0, 3)) // 2 * 2))
            edits = [(a, b, rng.choice(["", "x", "yz"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
            tape.rewrite(edits)
            made, at = [], 0
            for a, b, new in edits:
                made += plain[at:a] + [(c, plain[a][1], plain[b - 1][2]) for c in new]
                at = b
            plain = made + plain[at:]
            assert tape.text == "".join(c for c, _, _ in plain)
            assert [tape.source(i, i + 1) for i in range(len(plain))] == [(a, b) for _, a, b in plain]


def test_planted_disguises_are_found_where_they_are():
    """Identifiers disguised at random, in plain text: the one span is the disguised stretch."""
    rng = random.Random(12)
    words = {"0": "zero", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine"}
    alike = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с"}
    wide = lambda s: "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in s)

    def email():
        name = "".join(rng.choice("abcdeop") for _ in range(rng.randint(3, 8))) + rng.choice(["", ".x", "7"]) + "2"
        name = "".join(alike.get(c, c) if rng.random() < 0.3 else c for c in name)
        name = name[0] + "​" * (rng.random() < 0.3) + name[1:]
        return name + rng.choice([" [at] ", "(at)", " at ", "＠", " { AT } "]) + "example" + rng.choice([".", " [dot] ", " dot ", "．", "(.)"]) + rng.choice(["com", "org", "net"])

    def phone():
        digits = "".join(rng.choice("123456789") for _ in range(rng.randint(9, 12)))
        return rng.choice(["plus " + " ".join(words[d] for d in digits), "+" + wide(digits), "+1 5O5 l" + digits[:2] + "-" + digits[2:6]])

    def ip():
        parts = [str(rng.randint(1, 255)) for _ in range(4)]
        return rng.choice([" [dot] ", "(dot)", " [.] "]).join(parts)

    for _ in range(1500):
        kind, made = rng.choice([("email", email), ("phone", phone), ("ip", ip)])
        text = made()
        before, after = rng.choice(["", "see ", "Größe: ", "ok, "]), rng.choice(["", " thanks", ", bye", "\nnext"])
        every = pii.find(before + text + after)[1]
        assert every[kind] == [(len(before), len(before) + len(text))], (before + text + after, every)
