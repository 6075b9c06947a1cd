"""The manifest against a plain tree, and its SQL against both."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from srcfacts.llm import manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, path int, idx string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def level(nodes):
    return [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))

    def path(nodes, i):
        out = []
        while len(nodes) > 1:
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            out.append((run[: i % 8], run[i % 8 + 1 :]))
            nodes, i = level(nodes), i // 8
        return out, nodes[0]

    kept = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in order}
    subroots = [path([leaf(r) for r in kept[g]], 0)[1] for g in order]
    out = []
    for at, g in enumerate(order):
        for i, r in enumerate(kept[g]):
            low, sub = path([leaf(x) for x in kept[g]], i)
            high, root = path(subroots, at)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            claim = leaf((*r[:4], lower(r[4]))) if hit else leaf(r)
            for left, right in low + high:
                claim = sha(*left, claim, *right)
            out.append((r[0], leaf(r), sub, root, sha(*["".join(a + b) for a, b in low + high]), claim, claim == root))
    return sorted(out, key=repr)


def table(spark, folder, rows):
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def got(spark, folder):
    return sorted((tuple(r) for r in M.op11_manifest(spark, folder).collect()), key=repr)


def rows_of(sizes):
    made, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            made.append((i, f"s{i % 3}", lang, i * 7, f"Text {i} Ünï ABC" * (i % 4)))
            i += 1
    return made


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 9}, {None: 65, "fr": 1, "é": 64, "z": 17, **{f"l{i}": 1 for i in range(9)}}])
def test_plain(spark, tmp_path, sizes):
    rows = rows_of(sizes)
    assert got(spark, table(spark, tmp_path, rows)) == plain(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "s", None, 3, "Aé"), (5, "s", "en", 1, "A"), (5, "s", "en", 1, "A"), (5, "s", "en", 1, "B"), (6, None, "en", None, None), (7, "", "", 0, ""), (9, "s", "en", 2, "X" * 200_000), (-3, "s", "en", 2, "x")]
    folder = table(spark, tmp_path, rows)
    assert got(spark, folder) == plain(rows)


def test_empty(spark, tmp_path):
    assert got(spark, table(spark, tmp_path, [])) == []


def test_sql(spark, tmp_path):
    import duckdb

    rows = rows_of({None: 3, "en": 70, "de": 8}) + [(900, None, "en", None, None)]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{table(spark, tmp_path, rows)}/documents.parquet/*.parquet'")
    assert sorted(con.execute(M.OP11_SQL).fetchall(), key=repr) == plain(rows)


def test_some_requests_and_records(spark):
    rows = rows_of({"en": 100, "de": 3})
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    leaves = M.leaves(docs)
    made = M.build(leaves)
    some = leaves.where("rank in (0, 77) or grp = '=de'").select("grp", "rank", "id", F.lit("00").alias("claim")).union(spark.createDataFrame([("=en", 500, 1, "00"), ("=en", 103, 1, "00")], "grp string, rank long, id long, claim string"))
    found = {(r.grp, r.rank): r for r in M.proofs(made, some).collect()}
    assert sorted(found) == [("=de", 0), ("=de", 1), ("=de", 2), ("=en", 0), ("=en", 77)]
    assert all(r.claim == "00" and r.leaf == leaf(rows[r.id]) for r in found.values())
    records = {r.digest: r.children for r in made.records().collect()}
    assert all(sha(*kids) == digest for digest, kids in records.items()) and made.root().first().digest in records and len(records) == 13 + 2 + 1 + 1 + 1
