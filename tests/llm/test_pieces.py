import os
import random

import numpy as np
import pytest

from srcfacts.llm import pieces as P

if not os.path.exists(P.MODEL):
    pytest.skip("no vocabulary files", allow_module_level=True)


@pytest.fixture(scope="module")
def table():
    return P.load()


def test_same_ids_as_the_library(table):
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=P.MODEL), random.Random(2)
    bits = [" ", "  ", "the", "tion", "é", "ß", "日本", "\n", "\t", ",", ".", "1999", "x", "Hello", "()", "😀", "▁", "ing", "A" * 20, " " * 17]
    encoder = P.Encoder(table, {})
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        ids = np.frombuffer(encoder(text), "<i4").tolist()
        assert ids == library.encode(text), text
        assert P.decode(ids, table) == text.replace("▁", " "), text


def test_relational_lattice(spark, table):
    words = ["▁the", "▁thtionha", "▁é", "x", "▁1999", "▁" + "ab" * 29, "日本語", "😀", "▁unbelievable,"]
    got = {r.word: r.symbols for r in P.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), table).collect()}
    assert got == {w: P.segment(w, table) for w in words}
    odd = ["▁" + "x" * 80, "▁▁a", "▁"]
    got = {r.word: r.symbols for r in P.encode_words(spark.createDataFrame([(w,) for w in odd], "word string"), table).collect()}
    assert got == {odd[0]: None, odd[1]: None, "▁": ["▁"]}


def test_corpus_against_the_library(spark, table, monkeypatch):
    """Odd blanks, very long words, repeated rows, clashing names; few words broadcast, few remembered."""
    import sentencepiece

    monkeypatch.setattr(P, "MOST_WORDS", 20)
    monkeypatch.setattr(P, "MOST_CACHED", 50)
    library, rng = sentencepiece.SentencePieceProcessor(model_file=P.MODEL), random.Random(5)
    bits = ["the", "of", "unbelievable,", "Straße", "日本語", "x1999", "a" * 70, "😀", "▁", "", "", "Hello\tyou", "(foo)", "\n"]
    texts = [" ".join(rng.choice(bits) + rng.choice(["", "s", "ing", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [" ", "", "a" * 5000]
    rows = [(i % 250, t, "r") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumns({"b": P.F.lit(1), "w": P.F.lit("w"), "word": P.F.lit("v")})
    got = P.encoded(df, table, keep=("text", "row", "b", "word")).collect()
    assert len(got) == len(rows) and {(r.row, r.b, r.word) for r in got} == {("r", 1, "v")}
    for r in got:
        assert list(r.ids) == library.encode(r.text) and r.n_pieces == len(r.ids), r.text
        assert r.exact == (P.SPACE not in r.text)


def test_viterbi_takes_the_largest_sum(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    scores = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): -rng.random() * 5 for _ in range(12)}
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(40)})
    rows = [(w, [(s, e, scores[w[s:e]]) for s in range(len(w)) for e in range(s + 1, len(w) + 1) if w[s:e] in scores]) for w in words]
    df = spark.createDataFrame(rows, "word string, edges array<struct<s:int,e:int,score:double>>")
    got = df.select("word", P._symbols(F.col("word"), P.viterbi(F.col("edges"), F.length("word"), -20.0)).alias("x")).collect()

    def best(w):
        top = [0.0] + [-1e9] * len(w)
        for e in range(1, len(w) + 1):
            top[e] = max(top[s] + max(scores.get(w[s:e], -1e9), -20.0 if e - s == 1 else -1e9) for s in range(e))
        return top[-1]

    for r in got:
        assert "".join(r.x) == r.word
        assert abs(sum(max(scores.get(x, -1e9), -20.0 if len(x) == 1 else -1e9) for x in r.x) - best(r.word)) < 1e-9


def test_rows(spark, table):
    df = spark.createDataFrame([(1, "a b", "q"), (1, "a b", "q"), (2, None, "q"), (None, "", "q"), (3, "  x\n", None)], "doc_id long, text string, ids string")
    got = P.encoded(df, table)
    rows = got.collect()
    assert len(rows) == 5 and all(r.exact for r in rows) and sorted(r.n_pieces for r in rows)[:2] == [0, 0]
    texts = P.decoded(got, table).collect()
    assert sorted(r.text for r in texts) == ["", "", "  x\n", "a b", "a b"]
    assert P.encoded(df.limit(0), table).count() == 0


def test_every_word_goes_through_the_relational_lattice(spark, table):
    """Rare words, long ones and runs of blanks included: tasks get a table in which they'd find no piece themselves."""
    import sentencepiece

    poor = table._replace(begun={p: k for p, k in table.begun.items() if k == table.tied})
    assert P.segment("▁the", poor) != P.segment("▁the", table)
    library, rng = sentencepiece.SentencePieceProcessor(model_file=P.MODEL), random.Random(6)
    letters = "aeinrstthé.,X日1"
    words = ["".join(rng.choice(letters) for _ in range(rng.choice((1, 5, 9, 58, 59, 60, 61, 62, 200)))) for _ in range(400)] + ["", "", "▁", "a▁b", "the" * 700]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(120)] + [w * 2 for w in words]
    got = P.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), poor, keep=("text",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "hashpartitioning(word" not in plan  # grouped where the words are
    for r in got.collect():
        assert list(r.ids) == library.encode(r.text), r.text
        assert r.exact == (P.decode(r.ids, table) == r.text)


def test_only_substrings_with_a_head_are_looked_up(spark, table):
    """Two substrings a start at most are exploded, longer ones only in sizes that pieces of that beginning have; edges as by brute force."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    words = sorted({P.SPACE + "".join(rng.choice(["a", "e", "n", "t", "th", "ing", "é", "日", "x"]) for _ in range(rng.randint(0, 20))) for _ in range(200)})
    chunks = spark.createDataFrame([(0, w, 0, w) for w in words], "bucket int, word string, at int, chunk string").repartition(3, "bucket")
    pieces = P.table_of(spark, table)
    got = P.lattice(chunks, pieces, ("bucket",))
    want = {w: sorted((table.order[w[s:e]] << 36) + s * 64 + e - s for s in range(len(w)) for e in range(s + 2, len(w) + 1) if table.order.get(w[s:e], table.tied) != table.tied) for w in words}
    assert {r.word: list(r.edges) for r in got.collect()} == {w: x for w, x in want.items() if x}
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert P.heads_at(spark).groupBy("n", "s").count().agg(F.max("count")).first()[0] == 2
    sizes = {(p[: P.HEAD], len(p)) for p, k in table.order.items() if k != table.tied}
    rows = P.heads_of(pieces).collect()
    assert len(rows) == len(sizes) and {(r.head, r["size"]) for r in rows} == sizes
    assert all((r.own is None) == (r["size"] > P.HEAD or r.head not in table.order) for r in rows)


def test_words_are_learnt_all_at_once(table):
    """By cuts, by edges and with characters that have no piece, as one by one; none, too."""
    import pyarrow as pa

    words = ["the", "", "x", "日本😀", "a\nb", "unbelievable,", "é" * 58, "y" * 70]
    cuts = []
    for w in words[:-1]:
        at = np.cumsum([0, *(len(x) for x in P.segment(P.SPACE + w, table))])
        cuts.append(sum(1 << int(i) for i in at))
    encoder = P.Encoder(table, {})
    encoder.learn(words, pa.array([*cuts, None], pa.int64()), pa.array([None] * 7 + [[7]], pa.list_(pa.int64())))
    assert encoder.edges == {words[-1]: [7]}
    assert encoder.known == {w: np.array(P.ids_of(P.segment(P.SPACE + w, table), table), "<i4").tobytes() for w in words[:-1]}
    encoder.learn([], pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())))
    encoder.learn(["z" * 70], pa.array([None], pa.int64()), pa.array([[9]], pa.list_(pa.int64())))
    assert encoder.edges == {words[-1]: [7], "z" * 70: [9]} and len(encoder.known) == 7
