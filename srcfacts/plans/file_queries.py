"""Registered queries of readers, writers and streams: rows of the tables are written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcfacts.functions import text as X
from srcfacts.operators import mining as M
from srcfacts.plans.registry import add
from srcfacts.sources import files as S
from srcfacts.streaming import live

c = F.col


def _written(i, name, df, how="json", **options):
    """The folder that the rows were written to."""
    folder = i.folder(name)
    df.write.options(**options).format(how).save(folder)
    return folder


# --- S1: whole files, one a size
def _source_files(i):
    lines = i.table("part").select(c("p_size").alias("size"), "p_partkey", F.concat(F.lit("int v"), "p_partkey", F.lit(";")).alias("value"))
    folder = i.folder("sources")
    lines.repartition("size").sortWithinPartitions("size", "p_partkey").select("size", "value").write.partitionBy("size").text(folder)
    found = S.read_source_files(i.spark, folder, "*.txt")
    return found.select(F.regexp_extract("file", r"size=(\d+)", 1).cast("long").alias("size"), "text")


add("s01_source_files", _source_files, "SELECT CAST(p_size AS BIGINT) AS size, string_agg('int v' || p_partkey || ';' || chr(10), '' ORDER BY p_partkey) AS text FROM part GROUP BY 1")


# --- S3, S4: declarations
_ALL_KINDS = [*S.KINDS, "Alien"]


def _snippets(i):
    place = lambda line, col: F.struct(line.cast("int").alias("line"), F.lit(col).alias("col"))
    kind = F.get(F.array(*map(F.lit, _ALL_KINDS)), (c("p_size") % len(_ALL_KINDS)).cast("int"))
    rows = i.table("part").select(
        c("p_partkey").cast("long").alias("id"), F.concat(F.lit("n"), "p_partkey").alias("name"), kind.alias("kind"), F.concat(F.lit("f"), "p_size", F.lit(".c")).alias("file"), place(c("p_size"), 1).alias("begin"), place(c("p_size") + 1, 9).alias("end"),
        F.when(c("p_size") % 2 == 0, F.array(F.concat(F.lit("x"), "p_size"))).alias("fields"), F.concat(F.lit("int \"v\"\n"), "p_partkey").alias("code"),
    )
    edge = lambda n: rows.select(c("id").alias("src"), F.floor(c("id") / n).cast("long").alias("dst")).where("dst > 0")
    folder = i.folder("snippets")
    S.write_snippets(rows, edge(2), edge(3), folder)
    return S.read_snippets(i.spark, folder, multi_line=False)


_KNOWN = f"(SELECT *, {_ALL_KINDS}[p_size % {len(_ALL_KINDS)} + 1] AS kind FROM part WHERE p_size % {len(_ALL_KINDS)} < {len(S.KINDS)})"
add("s03_snippets", lambda i: _snippets(i)["snippets"].select("id", "name", "kind", "file", c("begin.line").alias("line"), c("end.col").alias("last_col"), "code"), f"SELECT CAST(p_partkey AS BIGINT) AS id, 'n' || p_partkey AS name, kind, 'f' || p_size || '.c' AS file, CAST(p_size AS INTEGER) AS line, CAST(9 AS INTEGER) AS last_col, 'int \"v\"' || chr(10) || p_partkey AS code FROM {_KNOWN}")
add("s03_snippet_keys", lambda i: _snippets(i)["keys"], f"SELECT CAST(p_partkey AS BIGINT) AS id, 'n' || p_partkey AS key FROM {_KNOWN} UNION ALL SELECT p_partkey, 'x' || p_size FROM {_KNOWN} WHERE p_size % 2 = 0")


def _snippet_edges(i):
    found = _snippets(i)
    return found["deps"].withColumn("kind", F.lit("dep")).union(found["outers"].withColumn("kind", F.lit("outer")))


add("s04_snippet_edges", _snippet_edges, f"SELECT CAST(p_partkey AS BIGINT) AS src, CAST(p_partkey // 2 AS BIGINT) AS dst, 'dep' AS kind FROM {_KNOWN} WHERE p_partkey >= 2 UNION ALL SELECT p_partkey, p_partkey // 3, 'outer' FROM {_KNOWN} WHERE p_partkey >= 3")


# --- S5, S6, S18: includes, libraries, repositories
def _includes(i):
    rows = i.table("orders").select(F.concat(F.lit("f"), "o_custkey").alias("file"), F.concat(F.lit("h"), c("o_orderkey") % 50, F.lit(".h")).alias("target"), (c("o_orderkey") % 2 == 0).alias("is_system"))
    folder = i.folder("includes")
    S.write_includes(rows, folder)
    return S.read_includes(i.spark, folder, multi_line=False)


add("s05_includes", _includes, "SELECT DISTINCT 'f' || o_custkey AS file, 'h' || (o_orderkey % 50) || '.h' AS target, o_orderkey % 2 = 0 AS is_system FROM orders")


def _libraries(i):
    rows = i.table("customer").select(F.concat(F.lit("p"), "c_custkey").alias("package"), F.when(c("c_custkey") % 3 == 0, F.array(F.lit("a.h"))).alias("includes"), F.array(F.concat(F.lit("/usr/lib/libq"), "c_custkey", F.lit(".so.1")), F.lit("/x.a")).alias("libs"), F.array(F.lit("-O")).alias("flags"))
    return S.read_libraries(i.spark, _written(i, "libraries", rows), multi_line=False).select("package", "includes", "libs", "flags")


add("s06_libraries", _libraries, "SELECT 'p' || c_custkey AS package, CASE c_custkey % 3 WHEN 0 THEN ['a.h'] ELSE [] END AS includes, ['/usr/lib/libq' || c_custkey || '.so.1', '/x.a'] AS libs, ['-O', '-lq' || c_custkey] AS flags FROM customer")


def _repos(i):
    rows = i.table("customer").select(F.concat(F.lit("r"), "c_custkey").alias("name"), c("c_custkey").alias("stars"), F.create_map(F.lit("C"), c("c_custkey") * 3, F.lit("Go"), F.lit(1).cast("long")).alias("languages"))
    return S.read_repos(i.spark, _written(i, "repos", rows), multi_line=False).select("name", "stars", F.coalesce("size", F.lit(0)).alias("size"), F.element_at("languages", F.lit("C")).alias("c_bytes"))


add("s18_repos", _repos, "SELECT 'r' || c_custkey AS name, c_custkey AS stars, CAST(0 AS BIGINT) AS size, c_custkey * 3 AS c_bytes FROM customer")


# --- S7, S8, S14: tables as text
def _csv(i):
    rows = i.table("orders").select("o_orderkey", c("o_custkey").alias("cust"), F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")).alias("status"))
    return S.read_csv_table(i.spark, _written(i, "csv", rows, "csv", header=True))


add("s07_csv_table", _csv, "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS status FROM orders")


def _org(i):
    """A head, then rules, comments and rows, in the order of their keys."""
    key, own = c("o_orderkey"), F.concat(F.lit("| "), "o_orderkey", F.lit(" | "), "o_orderstatus", F.lit(" |"))
    body = i.table("orders").select(key.alias("at"), F.when(key % 7 == 0, "|---+---|").when(key % 7 == 1, F.concat(F.lit("# "), own)).when(key % 7 == 2, F.concat(own, F.lit(" x |"))).otherwise(own).alias("value"))
    head = i.spark.range(1).select(F.lit(-1).cast("long").alias("at"), F.lit("| key | status |").alias("value"))
    folder = i.folder("org")
    body.union(head).repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(folder)
    return S.read_org_table(i.spark, folder)


add("s08_org_table", _org, "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status FROM orders WHERE o_orderkey % 7 > 2")


def _poi(i):
    rows = i.table("orders").select(F.concat(F.lit("b"), c("o_custkey") % 7).alias("benchmark"), F.concat(F.lit("f"), "o_custkey").alias("file"), c("o_orderkey").alias("linum"), c("o_orderstatus").alias("type"), F.concat(F.lit("x > "), "o_orderkey").alias("failure-condition"))
    return S.read_poi(i.spark, _written(i, "poi", rows, "csv", header=True), "b3")


add("s14_poi", _poi, "SELECT 'b3' AS benchmark, 'f' || o_custkey AS file, CAST(o_orderkey AS INTEGER) AS linum, o_orderstatus AS type, 'x > ' || o_orderkey AS failure_condition FROM orders WHERE o_custkey % 7 = 3")


# --- S9, S10, S15: tags, selections, error reports
_LETTERS = "cdefglmnpstuvxZ"


def _tags(i):
    letter = F.substring(F.lit(_LETTERS), (c("p_size") % len(_LETTERS) + 1).cast("int"), F.lit(1))
    line = F.concat(F.lit("n"), "p_partkey", F.lit("\tf"), "p_size", F.lit(".c\t"), F.when(c("p_partkey") % 2 == 0, F.concat("p_partkey", F.lit(';"\t'), letter)).otherwise(F.concat(F.lit('/^x$/;"\tkind:'), letter, F.lit("\tline:"), "p_partkey")))
    rows = i.table("part").select(F.when(c("p_partkey") % 10 == 5, F.lit("!_TAG\tx")).otherwise(line).alias("value"))
    return S.read_tags(i.spark, _written(i, "tags", rows, "text"))


_NAMED = [S.TAG_KINDS.get(x, "other") for x in _LETTERS]
add("s09_tags", _tags, f"SELECT 'n' || p_partkey AS name, 'f' || p_size || '.c' AS path, CAST(p_partkey AS INTEGER) AS line, {_NAMED}[p_size % {len(_LETTERS)} + 1] AS kind FROM part WHERE p_partkey % 10 <> 5")


def _selections(i):
    rows = i.table("orders").select(F.concat(F.lit("s"), c("o_custkey") % 5).alias("sel_id"), F.concat(F.lit("f"), "o_custkey").alias("file"), (c("o_orderkey") % 100).cast("int").alias("line"), F.when(c("o_orderstatus") == "F", (c("o_orderkey") % 9).cast("int")).alias("col"))
    folder = i.folder("selections")
    S.write_selection(rows, folder)
    return S.read_selection(i.spark, folder, multi_line=False).select("file", "line", F.coalesce("col", F.lit(-1)).alias("col"))


add("s10_selections", _selections, "SELECT 'f' || o_custkey AS file, CAST(o_orderkey % 100 AS INTEGER) AS line, CASE o_orderstatus WHEN 'F' THEN CAST(o_orderkey % 9 AS INTEGER) ELSE -1 END AS col FROM orders")


def _errors(i):
    frame = lambda line: F.struct(F.concat(F.lit("f"), "o_custkey").alias("fn"), F.lit("a.c").alias("file"), line.cast("int").alias("line"))
    kind = F.when(c("o_orderstatus") == "F", "InvalidRead").when(c("o_orderstatus") == "O", "InvalidWrite").otherwise("Leak")
    rows = i.table("orders").select(F.concat(F.lit("0x"), "o_orderkey").alias("unique"), kind.alias("kind"), F.array(F.struct(F.array(frame(c("o_orderkey") % 50), frame(c("o_custkey") % 50)).alias("frame"))).alias("stack"))
    return S.read_error_xml(i.spark, _written(i, "errors", rows, "xml", rootTag="out", rowTag="error"))


add("s15_error_frames", _errors, """SELECT '0x' || o_orderkey AS error, CASE o_orderstatus WHEN 'F' THEN 'InvalidRead' WHEN 'O' THEN 'InvalidWrite' ELSE 'Leak' END AS kind, f AS frame, 'f' || o_custkey AS function, 'a.c' AS source, CAST(CASE f WHEN 0 THEN o_orderkey % 50 ELSE o_custkey % 50 END AS INTEGER) AS line
 FROM orders, (VALUES (CAST(0 AS INTEGER)), (1)) v(f)""")
add("s15_errors_at_line", lambda i: S.errors_at_line(_errors(i), 7), "SELECT '0x' || o_orderkey AS error, CASE o_orderstatus WHEN 'F' THEN 'InvalidRead' ELSE 'InvalidWrite' END AS kind FROM orders WHERE o_orderstatus IN ('F', 'O') AND (o_orderkey % 50 = 7 OR o_custkey % 50 = 7)")


# --- S19, S20, S22: stored facts, traces, fragments
def _facts(i):
    folder = i.folder("facts")
    S.save_facts({"calls": i.edges(), "spans": i.intervals()}, folder)
    found = S.load_facts(i.spark, folder, ["calls", "spans"])
    return found["calls"].join(found["spans"].select(c("id").alias("src"), "begin"), "src")


add("s19_stored_facts", _facts, "SELECT src, dst, label, begin FROM edges JOIN intervals ON id = src")


def _trace_csv(i):
    runs = M.wide(i.trace(), ["input_int_qty", "output_int_d", "output_addr_n"]).join(i.runs().select("seg", "test", "reach_code", "status_code"), ["seg", "test"])
    folder = i.folder("trace")
    S.write_trace_csv(runs, folder)
    return i.spark.read.csv(folder, header=True, schema="seg long, test long, input_int_qty string, output_addr_n string, output_int_d string, reach_code int, status_code int")


add("s20_trace_csv", _trace_csv, "SELECT seg, test, CAST(qty AS VARCHAR) AS input_int_qty, '(nil)' AS output_addr_n, CASE WHEN line <> 7 THEN CAST(qty % 7 AS VARCHAR) ELSE 'NA' END AS output_int_d, reach_code, status_code FROM runs")


def _fragments(i):
    rows = i.table("supplier").select(c("s_suppkey").alias("id"), F.concat(F.lit("/r/b"), c("s_suppkey") % 4, F.lit("/x.c")).alias("path"), F.lit(1).alias("begin"), (c("s_suppkey") % 9).cast("int").alias("end"))
    folder = i.folder("fragments")
    S.write_partitioned(rows, folder, "/r")
    return i.spark.read.schema("id long, path string, begin int, `end` int").json(folder).select("bench", c("frag").cast("long").alias("frag"), "id", "path", c("end").cast("int").alias("end"))


add("s22_partitioned", _fragments, "SELECT 'b' || (s_suppkey % 4) AS bench, CAST(s_suppkey AS BIGINT) AS frag, CAST(s_suppkey AS BIGINT) AS id, '/r/b' || (s_suppkey % 4) || '/x.c' AS path, CAST(s_suppkey % 9 AS INTEGER) AS \"end\" FROM supplier")


# --- X18
def _xml(i):
    text = F.concat(F.lit("<unit><decl><type><name>t"), c("p_size") % 5, F.lit("</name></type><name>v"), "p_partkey", F.lit("</name></decl><comment>no</comment> = <call><name>f"), "p_size", F.lit("</name></call>;</unit>"))
    return i.table("part").select("p_partkey", text.alias("x"))


add("x18_xml", lambda i: _xml(i).select("p_partkey", X.xml_names(c("x")).alias("names"), X.xml_calls(c("x")).alias("calls"), X.xml_types(c("x")).alias("types"), X.xml_declared(c("x")).alias("declared"), X.xml_text(c("x")).alias("text")),
    "SELECT p_partkey, ['t' || (p_size % 5), 'v' || p_partkey, 'f' || p_size] AS names, ['f' || p_size] AS calls, ['t' || (p_size % 5)] AS types, ['v' || p_partkey] AS declared, 't' || (p_size % 5) || 'v' || p_partkey || ' = ' || 'f' || p_size || ';' AS text FROM part")


# --- Y1, Y2: the log as files that a stream picks up, all that are there
def _log_files(i):
    from pyspark.sql import Window

    numbered = i.log().select(c("file").cast("string").alias("file"), F.row_number().over(Window.partitionBy("file").orderBy("ts", "event_id")).cast("long").alias("line_no"), "line")
    return live.read_lines(i.spark, _written(i, "log", numbered.repartition(4)), maxFilesPerTrigger=2)


def _live_counts(i):
    folder = i.folder("counts")
    counts = live.live_counts(_log_files(i), patterns={"success": "SUCCESS", "error": "FAILURE", "values": "="})
    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/rows")).trigger(availableNow=True).start()
    query.awaitTermination()
    return i.spark.read.parquet(f"{folder}/rows")


add("y01_live_counts", _live_counts, "SELECT CAST(file AS VARCHAR) AS file, sum(contains(line, 'SUCCESS')::INT) AS success, sum(contains(line, 'FAILURE')::INT) AS error, sum(contains(line, '=')::INT) AS values FROM log GROUP BY 1")


def _live_records(i):
    folder = i.folder("records")
    query = live.live_records(_log_files(i)).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return i.spark.read.parquet(f"{folder}/rows")


_W = "PARTITION BY file ORDER BY ts, event_id"
add("y02_live_records", _live_records, f"""WITH m AS (SELECT *, CASE line WHEN 'INPUT_SPEC' THEN 2 END AS code, CASE line WHEN 'TEST_SUCCESS' THEN 0 WHEN 'TEST_FAILURE' THEN 1 END AS status FROM log),
 t AS (SELECT *, 1 + coalesce(sum(CASE WHEN status IS NOT NULL THEN 1 ELSE 0 END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS test FROM m),
 r AS (SELECT file, test, max(code) AS reach_code, max(status) AS status_code FROM t GROUP BY 1, 2 HAVING max(status) IS NOT NULL),
 v AS (SELECT file, test, 'input' AS side, trim(split_part(line, '=', 1)) AS key, arg_max(trim(split_part(line, '=', 2)), (ts, event_id)) AS value FROM t WHERE contains(line, '=') GROUP BY 1, 2, 3, 4)
 SELECT CAST(r.file AS VARCHAR) AS file, CAST(r.test AS BIGINT) AS test, side, key, value, coalesce(reach_code, 1) AS reach_code, status_code FROM r LEFT JOIN v ON v.file = r.file AND v.test = r.test""")
