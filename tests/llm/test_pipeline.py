import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from srcfacts.llm import mixing, pieces, pii, simhash, toxicity

if not os.path.exists(pieces.MODEL):
    pytest.skip("no vocabulary files", allow_module_level=True)


@pytest.fixture()
def folder(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]
    rows = []
    for i in range(240):
        body = " ".join(words[(i * 7 + j * j) % 8] + str((i * 31 + j) % 97) for j in range(30))
        if i % 6 == 0:
            body += ". you absolute zork, zork and " + words[i % 8] + "."
        if i % 9 == 1:
            body += f" mail u{i}@example.com"
        rows.append((i, body, "en", f"s{i % 3}", len(body)))
    rows += [(1000 + i, rows[i][1], "en", "s1", rows[i][4]) for i in range(1, 240, 40)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    start = {r.doc_id: r for r in docs.collect()}
    out = P.drop_toxic(spark, docs, folder)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    heads = toxicity.heads_of(model[0])
    want = {i for i, r in start.items() if toxicity.score(r.text or "", *model, heads)[0] < toxicity.THRESHOLD}
    assert out.columns == columns and {r.doc_id for r in out.collect()} == want
    assert not any(i % 6 == 0 for i in want if i < 240) and len(want) >= 200

    out = spark.createDataFrame(out.collect(), docs.schema)
    rows = out.collect()
    kept = P.drop_copies(spark, out, folder)
    prints = {r.doc_id: simhash.fingerprint(r.text or "") & (2**64 - 1) for r in rows}
    root = {i: i for i in prints}
    for _ in prints:
        new = {i: min(root[j] for j in prints if bin(prints[i] ^ prints[j]).count("1") <= 2) for i in prints}
        if new == root:
            break
        root = new
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {i for i in prints if root[i] == i}

    kept = spark.createDataFrame(kept.collect(), docs.schema)
    clean = {r.doc_id: r for r in P.replace_personal_data(spark, kept, folder).collect()}
    for r in kept.collect():
        assert clean[r.doc_id].text == (pii.redact(r.text) if r.text is not None else None)
        assert clean[r.doc_id].n_chars == (len(clean[r.doc_id].text) if r.text is not None else None)

    mixed = P.mix_sources(spark, kept, folder)
    assert mixed.columns == columns
    assert [r.doc_id for r in mixed.collect()] == [r.doc_id for r in mixing.mix(kept).orderBy(F.col("position").asc_nulls_last()).collect()]


def test_run(spark, folder):
    got = P.run(spark, folder).collect()
    assert all(r.exact for r in got) and {"doc_id", "source", "n_pieces", "ids", "exact"} == set(got[0].asDict())
    table = pieces.load()
    text = {r.doc_id: pieces.decode(r.ids, table) for r in got}
    assert "u1@example.com" not in "".join(text.values()) and "<email>" in "".join(text.values())


def test_repeated_ids_and_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    twice = docs.union(docs)
    assert P.drop_copies(spark, twice, folder).count() == P.drop_copies(spark, docs, folder).count()
    none = docs.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_run_keeps_the_mix(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    want = [r.doc_id for r in mixing.mix(docs).orderBy(F.col("position").asc_nulls_last()).collect()]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        assert [r.doc_id for r in P.run(spark, folder).collect()] == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_last_stage_has_the_order_of_the_files(spark, tmp_path):
    """Larger files are read first; the order in which the files were written must come back."""
    rows = [(i, f"{i} " + "alpha beta " * (1 + 400 * (i // 30)), "en", "s0", 0) for i in range(120)]
    docs = spark.sparkContext.parallelize(rows, 4).toDF("doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/mixing")
    again = spark.read.parquet(f"{tmp_path}/mixing")
    assert [r.doc_id for r in again.collect()] != list(range(120))
    assert [r.doc_id for r in P.encode(spark, again, "").collect()] == list(range(120))


def test_stages_keep_columns_of_any_name(spark, folder):
    """Names that the operators use themselves."""
    names = ["score", "sentences", "row", "missing", "clean", "component", "rep", "sig", "position", "slot", "file", "at", "__null", "__spare", "__text", "hash", "range", "_metadata", "c0"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60").withColumns({n: F.lit(n) for n in names})
    for name, stage in P.STAGES[:-1]:
        docs.write.parquet(f"{folder}/{name}-in")
        out = stage(spark, spark.read.parquet(f"{folder}/{name}-in"), folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == n for r in rows for n in names), name
        docs = spark.createDataFrame(rows, docs.schema)
    docs.write.parquet(f"{folder}/last-in")
    assert P.encode(spark, spark.read.parquet(f"{folder}/last-in"), folder).count() == docs.count()


def test_texts_of_one_id_are_documents_each(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a, 1), (7, a, 2), (7, b, 3), (9, c, 4), (9, c, 5), (None, a, 6), (8, None, 7), (8, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = P.drop_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, a), (7, b), (9, c), (None, a), *[(r.doc_id, r.text) for r in got.where("doc_id = 8").collect()]], key=str)
    assert got.where("doc_id = 8").count() == 1
