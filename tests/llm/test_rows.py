"""Nulls, empty and long texts, repeated rows, empty tables, clashing names: every text operator."""

import zlib

import pytest
from pyspark.sql import functions as F

from srcfacts.llm import base, html, langid, pii, secrets, toxicity
from srcfacts.llm import queries as Q


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Hello World, hello. Mail a@b.cc token=abcdefghijklmnop", "en"), (1, "Hello World, hello. Mail a@b.cc token=abcdefghijklmnop", "en"), (2, None, "en"), (None, "bonjour le monde", None), (3, "", "fr"), (4, "1 2 3", "fr"), (5, "x" * 300_000 + " Ünï " * 20_000, "de")]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return made.withColumns({c: F.lit(7) for c in ("spans", "score", "lang_pred", "sentences", "accepted", "held_out", "page_id")}).withColumn("html", F.col("text"))


def test_langid(docs, spark):
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == 7 and {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got) and all(r.lang_pred in ("en", "fr", "de", "und") for r in got)
    assert langid.fit(docs.limit(0)) is None and langid.predict(docs.limit(0), None).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_held_out(docs):
    for r in docs.select("doc_id", base.split_of().alias("s")).collect():
        assert r.s == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4


def test_languages_are_told_apart(spark):
    import random

    rng = random.Random(8)
    sounds = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ein", "ung", "el"], "cc": ["ción", "ar", "os", "que"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[x]) for _ in range(3)) for _ in range(30)), x) for i in range(300) for x in [sorted(sounds)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(df, langid.fit(df)).collect()}
    assert sum(got[i].lang_pred != x for i, _, x in rows) == 0
    odd = langid.predict(spark.createDataFrame([(1, "zzzz qqqq wwww " * 30)], "doc_id long, text string"), langid.fit(df)).first()
    assert not odd.accepted


def test_spans(docs):
    for scan, kinds in ((pii.scan, {"email"}), (secrets.scan, {"assign"})):
        got = scan(docs).collect()
        assert len(got) == 7 and [{s.kind for s in r.spans} for r in got if r.doc_id == 1] == [kinds, kinds]
        assert all(r.spans == [] for r in got if r.doc_id != 1)
        assert scan(docs.limit(0)).count() == 0


def test_redacted_keeps_columns(docs):
    got = pii.redacted(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert [r.text for r in rows if r.doc_id == 1] == ["Hello World, hello. Mail <email> token=abcdefghijklmnop"] * 2
    assert [r.text for r in rows if r.doc_id == 2] == [None] and all(r.spans == 7 for r in rows)


def test_html(docs):
    got = html.extract(docs).collect()
    assert len(got) == 7 and sum(r.text == "" for r in got) == 2 and html.extract(docs.limit(0)).count() == 0


def test_toxicity_without_labels(docs, spark):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.fit(docs, none)).collect()
    assert len(got) == 7 and {r.score for r in got} == {0.0}


@pytest.mark.parametrize("name", ["op7_langid", "op8_pii", "op9_secrets", "op10_toxicity", "op5_quality", "op1_mixing", "op2_simhash"])
def test_queries_on_odd_tables(spark, tmp_path, name):
    rows = [(i, None if i == 3 else "" if i == 4 else f"word{i} other text here and more of it, a@b.cc", None if i == 5 else "en", None if i == 6 else "s") for i in range(12)] + [(None, "x", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert Q.QUERIES[name](spark, str(tmp_path)).count() == 13
