"""Registered queries of the operators on lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcfacts.functions import text as X
from srcfacts.operators import experiments as E
from srcfacts.operators import logs as L
from srcfacts.plans.registry import add

ORDER = ("ts", "event_id")
_W = "PARTITION BY file ORDER BY ts, event_id"


def _docs(i):
    return i.table("documents").select(F.col("doc_id").alias("file"), "text")


_LINES = "(SELECT doc_id AS file, CAST(i + 1 AS INTEGER) AS line_no, parts[i + 1] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(len(parts))) AS i))"
add("s02_lines", lambda i: L.to_lines(_docs(i)), f"SELECT * FROM {_LINES}")
add("s02_matching_lines", lambda i: L.matching_lines(L.to_lines(_docs(i)), "555"), f"SELECT * FROM {_LINES} WHERE contains(line, '555')")
add("s02_first_match", lambda i: L.first_match(L.to_lines(_docs(i)), "token"), f"SELECT file, min(line_no) AS line_no FROM {_LINES} WHERE contains(line, 'token') GROUP BY 1")
add("p14_dedupe_lines", lambda i: L.dedupe_lines(L.to_lines(_docs(i))), f"SELECT file, min(line_no) AS line_no, line FROM {_LINES} GROUP BY file, line")
add("w02_trace_records", lambda i: L.trace_records(i.log(), order=ORDER), f"""WITH m AS (SELECT *, CASE line WHEN 'INPUT_SPEC' THEN 2 END AS code, CASE line WHEN 'TEST_SUCCESS' THEN 0 WHEN 'TEST_FAILURE' THEN 1 END AS status, CASE line WHEN 'INPUT_SPEC' THEN 'input' END AS opened FROM log),
 t AS (SELECT *, 1 + coalesce(sum(CASE WHEN status IS NOT NULL THEN 1 ELSE 0 END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS test FROM m),
 r AS (SELECT file, test, max(code) AS reach_code, max(status) AS status_code FROM t GROUP BY 1, 2 HAVING max(status) IS NOT NULL),
 s AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY file, test ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sd FROM t),
 v AS (SELECT file, test, coalesce(sd, 'input') AS side, trim(split_part(line, '=', 1)) AS key, arg_max(trim(split_part(line, '=', 2)), (ts, event_id)) AS value FROM s WHERE contains(line, '=') GROUP BY 1, 2, 3, 4)
 SELECT r.file, CAST(r.test AS BIGINT) AS test, side, key, value, coalesce(reach_code, 1) AS reach_code, status_code FROM r LEFT JOIN v ON v.file = r.file AND v.test = r.test""")
add("w03_last_complete_block", lambda i: L.last_complete_block(i.log(), opens="INPUT_SPEC", order=ORDER), f"""SELECT file, ts, event_id, line FROM (SELECT *, max(block) OVER (PARTITION BY file) AS blocks FROM (SELECT *, sum(CASE line WHEN 'INPUT_SPEC' THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS block FROM log))
 WHERE block = 0 OR block = greatest(1, blocks - 1)""")


def _counts_log(i):
    kind, value = F.col("event_type"), F.floor("value").cast("long")
    line = F.when(kind == "view", F.concat(F.lit("IOData: "), value % 3, F.lit(" in, "), value % 4)).when(kind == "purchase", F.concat(F.lit("Output written to d/sel-"), F.col("event_id"), F.lit(".json"))).otherwise(kind)
    return i.table("events").select(F.col("user_id").alias("file"), "ts", "event_id", line.alias("line"))


add("w04_written_with_counts", lambda i: L.written_with_counts(_counts_log(i), order=ORDER), """SELECT file, event_id AS id, CAST(n_input AS INTEGER) AS n_input, CAST(n_output AS INTEGER) AS n_output, 'd/sel-' || event_id || '.json' AS path FROM (
 SELECT user_id AS file, event_id, event_type, last_value(CASE event_type WHEN 'view' THEN CAST(floor(value) AS BIGINT) % 3 END IGNORE NULLS) OVER w AS n_input,
 last_value(CASE event_type WHEN 'view' THEN CAST(floor(value) AS BIGINT) % 4 END IGNORE NULLS) OVER w AS n_output FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
 WHERE event_type = 'purchase' AND n_input > 0 AND n_output > 0""")
add("w05_dense_numbers", lambda i: L.number_rows(i.table("orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], "id", 0).withColumn("id", F.col("id").cast("long")), "SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS id FROM orders")
add("w06_first_error", lambda i: L.first_after(i.log(), "INPUT_SPEC", "FAILURE", ORDER), f"""SELECT file, ts, event_id, line, CAST(block AS BIGINT) AS block FROM (SELECT *, row_number() OVER (PARTITION BY file, block ORDER BY ts, event_id) AS nth FROM (
 SELECT *, sum(CASE line WHEN 'INPUT_SPEC' THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS block FROM log) WHERE block > 0 AND line = 'TEST_FAILURE') WHERE nth = 1""")


def _session_log(i):
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("NO. 1 b"), F.col("event_id"))).when(F.col("event_type") == "error", "x error: y").otherwise(F.col("event_type"))
    return i.table("events").select(F.col("user_id").alias("file"), "ts", "event_id", line.alias("line"))


add("w07_a09_errors_per_session", lambda i: L.errors_per_session(L.sessions(_session_log(i), order=ORDER)), """SELECT file, CAST(session AS BIGINT) AS session, max(CASE event_type WHEN 'signup' THEN 'b' || event_id END) AS session_name, sum(CASE event_type WHEN 'error' THEN 1 ELSE 0 END) AS errors, sum(CASE event_type WHEN 'error' THEN 1 ELSE 0 END) = 0 AS good FROM (
 SELECT user_id AS file, event_id, event_type, sum(CASE event_type WHEN 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM events) WHERE session > 0 GROUP BY 1, 2""")


def _run_log(i):
    """Orders as segments: a line that opens one, and a line for each of its fields."""
    o = i.table("orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.floor("o_totalprice").cast("long").alias("p"))
    texts = F.array(F.lit("Processing query x"), F.concat(F.lit("Segment Size: "), F.col("p")), F.concat(F.lit("Compile: "), F.when(F.col("o_orderstatus") == "F", "true").otherwise("false")), F.concat(F.lit("Stmt Coverage: "), F.col("p") % 100, F.lit("% of 7")), F.concat(F.lit("Total fail poi: "), F.col("p") % 5))
    return o.select(F.col("o_custkey").alias("file"), "o_orderkey", F.posexplode(texts).alias("k", "line")).select("file", (F.col("o_orderkey") * 10 + F.col("k")).alias("line_no"), "line")


add("w01_segment_results", lambda i: L.segment_results(_run_log(i)).select("file", "seg", "seg_size", "compilible", "stmt_cov", "bug_triggered_num", "loop_num"), """SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seg, CAST(floor(o_totalprice) AS INTEGER) AS seg_size, o_orderstatus = 'F' AS compilible,
 (CAST(floor(o_totalprice) AS BIGINT) % 100) || '% of 7' AS stmt_cov, CAST(CAST(floor(o_totalprice) AS BIGINT) % 5 AS INTEGER) AS bug_triggered_num, CAST(NULL AS INTEGER) AS loop_num FROM orders""")
add("x09_coverage", lambda i: L.segment_results(_run_log(i)).select("file", "seg", X.coverage_percent(F.col("stmt_cov")).alias("percent"), X.coverage_of(F.col("stmt_cov")).alias("of")), "SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seg, CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) AS percent, CAST(7 AS BIGINT) AS of FROM orders")


def _preprocessed(i):
    """Order lines as preprocessed text: a marker now and then, of the file itself or another."""
    marker = F.concat(F.lit("# "), F.col("o_orderkey") % 50, F.lit(' "f'), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).otherwise(0), F.lit('.c"'))
    return i.table("orders").select(F.concat(F.lit("src/f"), F.col("o_custkey"), F.lit(".c")).alias("file"), F.col("o_orderkey").alias("line_no"), F.when(F.col("o_orderkey") % 4 == 0, marker).otherwise(F.concat(F.lit("x"), F.col("o_orderkey"))).alias("line"))


_PRE = "(SELECT 'src/f' || o_custkey || '.c' AS file, o_orderkey AS line_no, o_orderkey % 4 = 0 AS mark, o_orderkey % 3 = 0 AND TRUE AS own, CAST(o_orderkey % 50 AS INTEGER) AS mark_line, 'x' || o_orderkey AS text, o_custkey FROM orders)"
add("p08_keep_own_lines", lambda i: L.keep_own_lines(_preprocessed(i)), f"""SELECT file, line_no, text AS line FROM (SELECT *, last_value(CASE WHEN mark THEN own OR o_custkey = 0 END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS state FROM {_PRE}) WHERE NOT mark AND state""")
add("p13_map_lines", lambda i: L.map_lines(_preprocessed(i), i.table("customer").select(F.concat(F.lit("src/f"), F.col("c_custkey"), F.lit(".c")).alias("file"), (F.col("c_custkey") % 60).cast("int").alias("line"))), f"""SELECT file, line, marker + 1 + line - mark_line AS mapped FROM (
 SELECT c.file, c.line, p.mark_line, p.line_no AS marker, row_number() OVER (PARTITION BY c.file, c.line ORDER BY p.mark_line DESC, p.line_no DESC) AS nth
 FROM (SELECT DISTINCT 'src/f' || c_custkey || '.c' AS file, CAST(c_custkey % 60 AS INTEGER) AS line FROM customer) c JOIN {_PRE} p ON p.file = c.file AND p.mark AND (p.own OR p.o_custkey = 0) AND p.mark_line <= c.line) WHERE nth = 1""")


def _includes(i):
    line = F.when(F.col("o_orderkey") % 5 == 0, "#include <assert.h>").when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("  # include <sys/h"), F.col("o_orderkey") % 9, F.lit(".h>"))).otherwise(F.concat(F.lit('#include "l'), F.col("o_orderkey") % 9, F.lit('.h"')))
    return i.table("orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line_no"), line.alias("line"))


add("p09_neutralize_assert", lambda i: L.neutralize_assert(_includes(i)), """SELECT o_custkey AS file, o_orderkey AS line_no, CASE o_orderkey % 5 WHEN 0 THEN '// #include <assert.h>' WHEN 1 THEN '  # include <sys/h' || (o_orderkey % 9) || '.h>' ELSE '#include "l' || (o_orderkey % 9) || '.h"' END AS line FROM orders""")
add("p09_angle_includes", lambda i: L.angle_includes(_includes(i)), "SELECT o_custkey AS file, list(CASE o_orderkey % 5 WHEN 0 THEN 'assert.h' ELSE 'sys/h' || (o_orderkey % 9) || '.h' END ORDER BY o_orderkey) AS includes FROM orders WHERE o_orderkey % 5 < 2 GROUP BY 1")
add("x05_include_target", lambda i: _includes(i).select("file", "line_no", X.include_target(F.col("line")).alias("target"), X.include_is_system(F.col("line")).alias("is_system")), "SELECT o_custkey AS file, o_orderkey AS line_no, CASE o_orderkey % 5 WHEN 0 THEN 'assert.h' WHEN 1 THEN 'sys/h' || (o_orderkey % 9) || '.h' ELSE 'l' || (o_orderkey % 9) || '.h' END AS target, o_orderkey % 5 < 2 AS is_system FROM orders")


def _error_lines(i):
    line = F.concat(F.lit("a.c:"), F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(": error: no type '"), F.col("o_custkey"), F.lit("'"))).when(F.col("o_orderstatus") == "O", F.concat(F.lit(": fatal error: bad "), F.col("o_custkey") % 7)).otherwise(": warning: x"))
    return i.table("orders").select(line.alias("line"))


add("a08_error_histogram", lambda i: E.error_histogram(_error_lines(i)), "SELECT message, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN ': no type ' ELSE ': bad ' || (o_custkey % 7) END AS message FROM orders WHERE o_orderstatus IN ('F', 'O')) GROUP BY 1")
add("x15_compile_message", lambda i: _error_lines(i).select(X.compile_message(F.col("line")).alias("message")), "SELECT CASE o_orderstatus WHEN 'F' THEN ': no type ' WHEN 'O' THEN ': bad ' || (o_custkey % 7) ELSE 'a.c:' || o_orderkey || ': warning: x' END AS message FROM orders")


def _buildrate_log(i):
    o = i.table("orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    texts = F.array(F.concat(F.lit("./p"), F.col("o_orderkey")), F.when(F.col("o_orderstatus") == "F", "success").otherwise("timeout"), F.concat(F.lit("SUCCESS: "), F.col("o_orderkey") % 9, F.lit(" ERROR: "), F.col("o_orderkey") % 5, F.lit(" RATE: "), F.when(F.col("o_orderkey") % 2 == 0, ".25").otherwise("")))
    return o.select(F.col("o_custkey").alias("file"), "o_orderkey", F.posexplode(texts).alias("k", "line")).select("file", (F.col("o_orderkey") * 10 + F.col("k")).alias("line_no"), "line")


add("s23_buildrate_log", lambda i: L.parse_buildrate_log(_buildrate_log(i)), "SELECT o_custkey AS file, './p' || o_orderkey AS project, CASE o_orderstatus WHEN 'F' THEN 0 ELSE -1 END AS exit_status, CAST(o_orderkey % 9 AS INTEGER) AS success, CAST(o_orderkey % 5 AS INTEGER) AS error, CASE o_orderkey % 2 WHEN 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS rate FROM orders")


def _io_lines(i):
    line = F.when(F.col("l_linenumber") % 3 == 0, "noise = 1").when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("input: int q"), F.col("l_linenumber"), F.lit("="), F.col("l_quantity").cast("long"))).otherwise(F.concat(F.lit("output: char * s = "), F.col("l_returnflag")))
    return i.table("lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line_no"), line.alias("line"))


add("s12_io_values", lambda i: L.parse_io_values(_io_lines(i)), "SELECT l_orderkey AS file, l_linenumber AS line_no, CASE l_linenumber % 3 WHEN 1 THEN 'input' ELSE 'output' END AS side, CASE l_linenumber % 3 WHEN 1 THEN 'int' ELSE 'char *' END AS type, CASE l_linenumber % 3 WHEN 1 THEN 'q' || l_linenumber ELSE 's' END AS key, CASE l_linenumber % 3 WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE l_returnflag END AS value FROM lineitem WHERE l_linenumber % 3 <> 0")


def _slice_report(i):
    o = i.table("orders")
    texts = F.array(F.lit("===="), F.concat(F.lit("a.c "), F.col("o_orderkey") % 90), F.concat(F.lit("src/b.c "), F.col("o_orderkey") % 7), F.concat(F.lit("/usr/x.h "), F.col("o_orderkey") % 5), F.concat(F.lit("c.c:"), F.col("o_custkey")))
    return o.select(F.col("o_custkey").alias("file"), "o_orderkey", F.posexplode(texts).alias("k", "line")).select("file", (F.col("o_orderkey") * 10 + F.col("k")).alias("line_no"), "line")


add("s13_slices", lambda i: L.parse_slices(_slice_report(i)), "SELECT DISTINCT o_custkey AS report, 'a.c' AS crit_file, CAST(o_orderkey % 90 AS INTEGER) AS crit_line, path, CAST(line AS INTEGER) AS line FROM (SELECT *, 'src/b.c' AS path, o_orderkey % 7 AS line FROM orders UNION ALL SELECT *, 'c.c', o_custkey FROM orders)")


def _clone_report(i):
    o = i.table("orders")
    texts = F.array(F.concat(F.lit("-- Type: "), F.col("o_orderkey") % 3 + 1), F.concat(F.lit("File: /r/b"), F.col("o_custkey"), F.lit("/x.c")), F.concat(F.lit(" Position: line "), F.col("o_orderkey") % 40, F.lit(" - line "), F.col("o_orderkey") % 40 + 9), F.lit("File: /r/z.c"), F.lit(" Position: line 1 - line 2"))
    return o.select(F.col("o_custkey").alias("file"), "o_orderkey", F.posexplode(texts).alias("k", "line")).select("file", (F.col("o_orderkey") * 10 + F.col("k")).alias("line_no"), "line")


add("s11_clone_report", lambda i: L.parse_clone_report(_clone_report(i)), """SELECT file, class, type, row_number() OVER (ORDER BY file, o_orderkey, k) AS id, path, begin, "end" FROM (
 SELECT o_custkey AS file, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS class, CAST(o_orderkey % 3 + 1 AS INTEGER) AS type, 1 AS k, '/r/b' || o_custkey || '/x.c' AS path, CAST(o_orderkey % 40 AS INTEGER) AS begin, CAST(o_orderkey % 40 + 9 AS INTEGER) AS "end" FROM orders
 UNION ALL SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), CAST(o_orderkey % 3 + 1 AS INTEGER), 2, '/r/z.c', 1, 2 FROM orders) WHERE type <> 1""")
add("s16_coverage", lambda i: L.parse_coverage(i.table("lineitem").select(F.col("l_orderkey").alias("file"), F.concat(F.when(F.col("l_returnflag") == "A", "Lines executed:").when(F.col("l_returnflag") == "R", "Branches executed:").otherwise("Calls:"), F.col("l_quantity").cast("long"), F.lit("% of 9")).alias("line"))),
    "SELECT l_orderkey AS file, CAST(max(CASE l_returnflag WHEN 'A' THEN l_quantity END) AS DOUBLE) AS statement, CAST(max(CASE l_returnflag WHEN 'R' THEN l_quantity END) AS DOUBLE) AS branch FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag IN ('A', 'R'))")
