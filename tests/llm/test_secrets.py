import random
import re
import time

from srcfacts.llm import secrets

PATTERNS = [("assign", secrets.ASSIGN, re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 0), ("hex", r"[0-9a-f]+", 0)]


def brute(text):
    found = []
    for k, (kind, pattern, flags) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text, flags):
            keep = len(m[2]) >= 12 if kind == "assign" else len(m[0]) >= (18 if kind == "access" else 16)
            if keep:
                found.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def test_base_spans_match_plain_expressions():
    rng = random.Random(7)
    bits = ["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "AKIAB9", "0123456789abcdef", "deadbeef", "é", "ß日", "\n", "x", "abcdefghijkl", "A-_./+=", "Z9" * 8, "ſecret"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [s for s in secrets.find(text) if s[2] in ("assign", "access", "hex")] == brute(text), text


def test_more_kinds():
    text = "é ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY----- postgres://u:p4ss@db.example.com/x eyJhbGci.eyJzdWIi.c2ln"
    kinds = {k: text[a:b] for a, b, k in secrets.find(text)}
    assert kinds["github"].startswith("ghp_") and kinds["pem"] == "-----BEGIN RSA PRIVATE KEY-----"
    assert kinds["url"] == "postgres://u:p4ss@db.example.com" and kinds["jwt"] == "eyJhbGci.eyJzdWIi.c2ln"
    assert secrets.find("") == []


def test_very_long_texts():
    for token in ("a", "0", "AKIA", "password=", "-----BEGIN ", " ", "é", "eyJ.", "postgres://", "ghp_"):
        text = token * (100_000 // len(token)) + " token=abcdefghijklmnop"
        start = time.process_time()
        assert [s for s in secrets.find(text) if s[2] in ("assign", "access", "hex")] == brute(text), token
        assert time.process_time() - start < 20, token


#: Its trigger asks for a letter or digit behind the prefix.
ASKED = {"slack": r"xox[abprs]-[A-Za-z0-9][A-Za-z0-9-]*"}


def brute_all(text):
    """Every rule by its expression alone: leftmost matches that don't overlap, failing ones used up."""
    found = []
    for k, rule in enumerate((*secrets.BASE, *secrets.MORE)):
        for m in re.finditer(ASKED.get(rule.kind, rule.pattern), text, (re.I if rule.fold else 0) | re.A):
            if m.end() - m.start() >= rule.least and (not rule.group or len(m[2]) >= rule.group_least):
                found.append((m.start(), k, m.end(), rule.kind))
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def test_all_rules_match_plain_expressions():
    rng = random.Random(11)
    bits = ["ghp_", "gho_x", "xoxb-", "xoxp-9", "sk_live_", "rk_live_Z", "AIza", "eyJ", ".", "eyJa", "eyJb.eyJc.", "eyJd.", "-----BEGIN ", "RSA ", "EC ", "PRIVATE KEY-----", "http", "s3+x", "://", "u", ":", "p4ß", "@", "host", "://u:p4ß", "@host.é", "a1B2" * 10, "-", "_", "/", " ", "é", "\n", "token", "=", "0f" * 8, "AKIA", "Z9" * 9]
    hit = set()
    for _ in range(12_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        wanted = brute_all(text)
        assert secrets.find(text) == wanted, text
        hit |= {k for _, _, k in wanted}
    assert hit == {r.kind for r in (*secrets.BASE, *secrets.MORE)}
