"""Repair of conversations against a search over whole edit strings, and the SQL against both."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from srcfacts.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, audit string, pos int, word string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    out = {}
    say = lambda v: " " if v is None else str(v)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, say(r[2]).encode(), say(r[3]).encode()))
    for conv, turn, role, text in order:
        kept = out.setdefault(conv, [])
        code = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        row = (turn, "user" if code == 4 else say(role), "" if code == 1 else re.sub("[.!?]", "", say(text)) if code == 2 else say(text))
        kept += [row] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def plain(conv, rows):
    """The result row of one conversation, its damaged rows given."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

    @lru_cache(maxsize=None)
    def best(i, made, inserts):
        """(cost, audit, lines) of the cheapest end, the roles so far being ``made`` (shortened to what the pattern sees)."""
        ways = []
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            ways.append((0, "", ()))
        options = [(5, "I", who, "") for who in ("user", "assistant") if inserts < 4]
        if i < len(rows):
            _, role, text = rows[i]
            extra = 5 * (faults[i] == "truncated")
            if faults[i] in ("", "truncated"):
                options += [(extra, "K", role, text)] + [(1 + extra, "R", who, text) for who in ("user", "assistant")]
            cost, audit, lines = best(i + 1, made, 0)
            ways.append((cost + 2, "D" + audit, lines))
        for price, edit, role, text in options:
            now = made + role[:1]
            if not role or not re.fullmatch("s?(ua)*u?", now):
                continue
            if len(now) > 4:
                now = now[:-2]
            cost, audit, lines = best(i + (edit != "I"), now, inserts + 1 if edit == "I" else 0)
            ways.append((cost + price, edit + audit, ((role, text), *lines)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha(text))


def expected(rows):
    kept = damage(rows)
    return sorted((plain(conv, kept[conv]) for conv in {r[0] for r in rows}), key=repr)


def made(seed, convs):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        turn = rng.choice([0, 1, 5])
        for _ in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "ux", ""])
            rows.append((conv, turn, role, rng.choice(["Yes.", "No!", "why? ", "cut", "", " \t", "é.\n", "a\nb."])))
            turn += rng.choice([1, 1, 1, 2, 0])
    return rows


ODD = [(None, None, None, None), (None, 3, "user", "Hi."), (900, None, "user", "x."), (900, None, "assistant", None), (901, 1, None, "y."), (902, 2, "user", "same."), (902, 2, "user", "same."), (902, 3, "user", "z" * 100_000 + " end"), (903, 0, "assistant", "ü.")]


def table(spark, folder, rows):
    spark.createDataFrame([(*r, "a", 1, "w") for r in rows], SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(spark, folder):
    return sorted((tuple(r) for r in C.op13_conversations(spark, folder).select(*COLUMNS).collect()), key=repr)


def test_query_and_sql(spark, tmp_path):
    import duckdb

    rows = made(5, 400) + ODD
    folder = table(spark, tmp_path, rows)
    wanted = expected(rows)
    assert got(spark, folder) == wanted
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(C.OP13_SQL).fetchall(), key=repr) == wanted


@pytest.mark.parametrize("rows", [[], [(7, t, "user", "a.") for t in range(60) if zlib.crc32(f"7:{t}".encode()) % 20 == 0]])
def test_nothing_left(spark, tmp_path, rows):
    assert got(spark, table(spark, tmp_path, rows)) == [(c, 0, 0, 0, 0, 0, 0, "", sha("")) for c in {r[0] for r in rows}]


def test_long_conversation(spark, tmp_path):
    rows = [(1, t, ("user", "assistant")[t % 2], f"row {t}.") for t in range(3000)]
    (row,) = got(spark, table(spark, tmp_path, rows))
    kept = damage(rows)[1]
    assert len(row[7].replace("I", "")) == len(kept) and row[6] >= 2 * sum(t == "" for _, _, t in kept)


def test_endings_are_shared(monkeypatch):
    """Each different ending is computed once for all words."""
    calls, real = [], C.node
    monkeypatch.setattr(C, "node", lambda char, after: calls.append(char) or real(char, after))
    rng = random.Random(3)
    words = {"".join(rng.choice("uaUs") for _ in range(rng.randint(0, 6))) for _ in range(2000)}
    found = list(C.plans(sorted(words, key=lambda w: w[::-1])))
    assert len(found) == len(words) and len(calls) == len({w[i:] for w in words for i in range(len(w))})


def test_repaired_rows(spark):
    rows = [(1, 1, "system", "Be kind."), (1, 2, "assistant", "Hello."), (1, 3, "assistant", "Hello."), (2, 1, "user", "cut off"), (3, 1, "user", "Q?"), (3, 2, "user", "A.")]
    found, texts = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: (r.audit, r.cost) for r in found.collect()} == {1: ("RKD", 3), 2: ("D", 2), 3: ("KR", 1)}
    assert [(r.conv_id, r.n, r.edit, r.role, r.text) for r in texts.orderBy("conv_id", "n").collect()] == [(1, 1, "R", "user", "Be kind."), (1, 2, "K", "assistant", "Hello."), (3, 1, "K", "user", "Q?"), (3, 2, "R", "assistant", "A.")]
