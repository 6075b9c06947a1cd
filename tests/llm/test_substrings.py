"""Repeated passages against all windows in a dictionary, and the SQL against both."""

import hashlib
import random
import re

import numpy as np
import pytest

from srcfacts.llm import substrings as S

SCHEMA = "doc_id long, text string, spans int, chunk string, n_words int"


def plain(rows, window=13):
    """(doc_id, n_words, n_removed, kept_sha256, spans) of each row."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (doc, _), own in zip(rows, words, strict=True):
        if doc is not None:
            for i in range(len(own) - window + 1):
                key = tuple(own[i : i + window])
                least[key] = min(least.get(key, doc), doc)
    out = []
    for (doc, _), own in zip(rows, words, strict=True):
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if doc is not None and least[tuple(own[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        edges = [i for i in range(len(own) + 1) if (i < len(own) and gone[i]) != (i > 0 and gone[i - 1])]
        kept = " ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out.append((doc, len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), tuple(zip(edges[::2], edges[1::2], strict=True))))
    return sorted(out, key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    some = ["a", "b", "the", "Ünï", "x1", "é", "の", "word", "Word", "0"]
    passages = [[rng.choice(some) for _ in range(k)] for k in (12, 13, 14, 19, 20, 27, 60, 13)]
    common = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        own = [f"{rng.choice(some)}{rng.randint(0, 40)}" for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(own))
            piece = rng.choice([*passages, common])
            a = rng.randint(0, 3)
            own[at:at] = piece[a : len(piece) - rng.randint(0, 3)]
        if i % 3 == 0:
            own[0:0] = common
        rows.append((rng.randint(0, 10_000), rng.choice([" ", "\n", "  ", "\t\x0b"]).join(own)))
    return rows


ODD = [(None, " ".join(["w%d" % i for i in range(30)])), (None, None), (20_000, None), (20_001, ""), (20_002, " \n "), (5, "one two"), (5, "one two"), (20_003, " ".join(["same"] * 50)), (20_004, " ".join(["same"] * 40)), (-7, " ".join(["same"] * 13)), (20_005, "y" * 400_000 + " z" * 30), (20_006, "y" * 400_000 + " z" * 30), (20_007, " ".join(["q" * 300_000] * 14)), (20_008, " ".join(["q" * 300_000] * 14))]


def table(spark, folder, rows, files=3):
    spark.createDataFrame([(*r, 7, "c", 1) for r in rows], SCHEMA).repartition(files).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize(("seed", "chunk"), [(1, 4 << 20), (2, 3000)])
def test_query_and_sql(spark, tmp_path, monkeypatch, seed, chunk):
    import duckdb

    monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
    rows = corpus(seed) + (ODD if seed == 1 else [])
    folder = table(spark, tmp_path, rows)
    wanted = [r[:4] for r in plain(rows)]
    assert sorted((tuple(r) for r in S.op12_substrings(spark, folder).collect()), key=repr) == sorted(wanted, key=repr)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert sorted(con.execute(S.OP12_SQL).fetchall(), key=repr) == sorted(wanted, key=repr)


def test_spans_and_texts(spark):
    rows = corpus(4, 60)
    got = S.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.id, r.n_words, tuple(map(tuple, r.spans))) for r in got), key=repr) == sorted(((d, n, s) for d, n, _, _, s in plain(rows)), key=repr)
    assert any(r.spans for r in got) and all(len(r.kept.split()) == r.n_words - sum(b - a for a, b in r.spans) for r in got)


def test_empty_tables(spark, tmp_path):
    assert S.op12_substrings(spark, table(spark, tmp_path, [])).count() == 0


def test_every_window_holds_a_block():
    for at in range(200):
        assert any(i % S.BLOCK == 0 for i in range(at, at + S.WINDOW - S.BLOCK + 1))


def test_words_and_hashes():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab é\n\t x") for _ in range(rng.randint(0, 200))).encode() for _ in range(300)] + [b"", b" ", b"v" * 300_000 + b" ab", b"ab"]
    words = S.Words.of(texts)
    plain_words = [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t.decode())] for t in texts]
    flat = [w for own in plain_words for w in own]
    assert words.count.tolist() == list(map(len, plain_words)) and words.size.tolist() == list(map(len, flat))
    assert bytes(words.data) == b"".join(w + b" " for w in flat)
    of = {}
    for w, h in zip(flat, words.hashes().tolist(), strict=True):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)
    assert len(np.unique(words.blocks()[1])) == len({tuple(own[i : i + S.BLOCK]) for own in plain_words for i in range(len(own) - S.BLOCK + 1)})
