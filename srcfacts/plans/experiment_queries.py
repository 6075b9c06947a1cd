"""Registered queries of the statistics over projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcfacts.functions import text as X
from srcfacts.operators import experiments as E
from srcfacts.plans.registry import add

_R = "(SELECT project, count(*) AS total, sum((outcome <> 'P')::INT) AS built, sum((outcome = 'F')::INT) AS ran FROM builds GROUP BY 1)"


def _built():
    return F.col("outcome") != "P"


def _ran():
    return F.col("outcome") == "F"


add("a01_build_rate", lambda i: E.build_rate(i.builds(), "project", _built(), _ran()), f"SELECT *, built / total AS build_rate, CASE WHEN built > 0 THEN ran / built END AS run_rate FROM {_R}")
add("a01_build_rate_cut", lambda i: E.build_rate(i.builds(), "project", _built(), _ran(), 2), f"SELECT project, total, built, ran, floor(built / total * 100) / 100 AS build_rate, CASE WHEN built > 0 THEN floor(ran / built * 100) / 100 END AS run_rate FROM {_R}")
add("a02_ratio_by_size", lambda i: E.ratio_by(i.builds(), "size", _ran()), "SELECT size, count(*) AS n, avg((outcome = 'F')::INT) AS ratio FROM builds GROUP BY 1")
add("a03_size_profile", lambda i: E.size_profile(i.builds(), "project", "size", _ran()), """SELECT project, min(size) FILTER (outcome = 'F') AS min_success, max(size) FILTER (outcome = 'F') AS max_success, avg(size) FILTER (outcome = 'F') AS mean_success,
 min(size) FILTER (outcome <> 'F') AS min_error, max(size) FILTER (outcome <> 'F') AS max_error, avg(size) FILTER (outcome <> 'F') AS mean_error FROM builds GROUP BY 1""")
add("a06_outcome_ranges", lambda i: E.outcome_ranges(i.builds(), "project", "outcome", "id", ["F", "O"]), """SELECT project, min(id) FILTER (outcome = 'F') AS "F_min", max(id) FILTER (outcome = 'F') AS "F_max", nullif(count(id) FILTER (outcome = 'F'), 0) AS "F_count",
 min(id) FILTER (outcome = 'O') AS "O_min", max(id) FILTER (outcome = 'O') AS "O_max", nullif(count(id) FILTER (outcome = 'O'), 0) AS "O_count" FROM builds GROUP BY 1""")


def _pages_lines(i):
    return i.table("documents").select("source", F.explode(F.split("text", "\n", -1)).alias("line"))


add("a11_loc_and_asserts", lambda i: E.loc_and_asserts(_pages_lines(i).select("source", F.regexp_replace("line", "tion", "Assert").alias("line")), "source"), "SELECT source, count(*) AS loc, sum(contains(line, 'tion')::INT) AS asserts FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")


def _repos(i):
    """A repository per user: bytes by language from the kinds of its events, errors in a language of the user's own."""
    own = F.get(F.array(*map(F.lit, _LANGUAGES)), F.pmod("user_id", F.lit(len(_LANGUAGES))).cast("int"))
    kind = F.when(F.col("event_type") == "view", "C").when(F.col("event_type") == "error", own).otherwise("make")
    counts = i.table("events").groupBy("user_id", kind.alias("lang")).agg(F.sum(F.when(F.col("event_type") == "view", 3000).otherwise(200)).alias("n"), F.count("*").alias("k"))
    return counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("languages"), (F.sum("k") * 5).alias("size")).withColumnRenamed("user_id", "name")


_LANGUAGES = ["Objective-C", "C++", "Ruby", "Java", "JavaScript", "Python", "Go"]
_REPOS = f"(SELECT user_id AS name, sum((event_type = 'view')::INT) * 3000 AS c, sum((event_type = 'error')::INT) AS errors, {_LANGUAGES}[user_id % {len(_LANGUAGES)} + 1] AS language, sum(CASE event_type WHEN 'view' THEN 3000 ELSE 200 END) AS total, count(*) * 5 AS size FROM events GROUP BY 1)"
add("a12_language_share", lambda i: E.language_share(_repos(i), "languages", "C").select("name", "size", "share"), f"SELECT name, size, c / total AS share FROM {_REPOS}")
add("p05_c_repositories", lambda i: E.filter_c_repos(_repos(i)).select("name", "size"), f"SELECT name, size FROM {_REPOS} WHERE c > 0 AND NOT (errors > 0 AND language IN ('Objective-C', 'C++', 'Ruby', 'Java', 'JavaScript')) AND c / total >= 0.7 AND c <= 100000 AND size <= 1000")
add("p06_healthy", lambda i: E.healthy(i.builds().select("id", F.when(F.col("outcome") == "F", True).when(F.col("outcome") == "O", None).otherwise(False).alias("ok"), F.col("size").alias("br")), ["ok"], least=3), "SELECT id, CASE outcome WHEN 'F' THEN TRUE END AS ok, size AS br FROM builds WHERE outcome <> 'P' AND size >= 3")
add("a13_o04_top_projects", lambda i: E.top_projects(i.builds(), "project", "size"), "SELECT project, sum(size) AS total FROM builds GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
add("a13_above", lambda i: E.top_projects(i.builds(), "project", "size", min_sum=60), "SELECT project, sum(size) AS total FROM builds GROUP BY 1 HAVING sum(size) > 60")
add("a14_patch_size", lambda i: E.patch_size(i.table("lineitem").select("l_suppkey", F.col("l_linenumber").alias("original"), F.col("l_quantity").cast("long").alias("patched"), "l_linestatus"), "l_suppkey", "original", "patched", F.col("l_linestatus") == "F"), """SELECT l_suppkey, count(*) AS n, sum(l_linenumber) AS original, sum(CAST(l_quantity AS BIGINT)) AS patched, sum((l_linenumber = CAST(l_quantity AS BIGINT))::INT) AS unchanged,
 avg(l_linenumber) AS mean_original, avg(CAST(l_quantity AS BIGINT)) AS mean_patched FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber <> 0 GROUP BY 1""")
add("a16_duplicate_functions", lambda i: E.duplicate_definitions(i.table("lineitem"), "l_suppkey", "l_partkey"), "SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
add("a17_removal_verdicts", lambda i: E.removal_verdicts(i.table("lineitem").select((F.col("l_linenumber") % 3).alias("h1"), (F.col("l_orderkey") % 3).alias("h2"), (F.col("l_suppkey") % 3).alias("h3")), "h1", "h2", "h3"), """SELECT CASE WHEN a = b AND b = c THEN '123' WHEN a = b THEN '12,3' WHEN a = c THEN '13,2' WHEN b = c THEN '23,1' ELSE '1,2,3' END AS verdict, count(*) AS n
 FROM (SELECT l_linenumber % 3 AS a, l_orderkey % 3 AS b, l_suppkey % 3 AS c FROM lineitem) GROUP BY 1""")
add("a20_x13_status_counts", lambda i: E.status_counts(i.builds().select(F.when(F.col("outcome") == "F", 0).when(F.col("outcome") == "O", 124).otherwise(2).alias("code")), "code"), "SELECT CASE outcome WHEN 'F' THEN 'success' WHEN 'O' THEN 'timeout' ELSE 'crash' END AS status, count(*) AS n FROM builds GROUP BY 1")
add("o05_within_limits", lambda i: E.within_limits(i.builds(), "project", ["id"], 5, F.col("outcome") == "P", 2), """SELECT id, project, outcome, size FROM (SELECT *, row_number() OVER w AS n, coalesce(sum((outcome = 'P')::INT) OVER (PARTITION BY project ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM builds WINDOW w AS (PARTITION BY project ORDER BY id)) WHERE n <= 5 AND e < 2""")
add("s17_blocklist", lambda i: E.apply_blocklist(i.table("customer").select(F.col("c_custkey").alias("project")), i.table("supplier").select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "# ").otherwise(" "), F.col("s_suppkey"), F.lit(" why")).alias("line"))), "SELECT c_custkey AS project FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 1)")
add("j14_project_facts", lambda i: E.join_facts([i.builds().groupBy("project").agg(F.count("*").alias("builds")), i.builds().groupBy("project").agg(F.sum("size").alias("loc")), i.table("customer").select(F.col("c_custkey").alias("project"), "c_mktsegment")], "project"), "SELECT project, count(*) AS builds, sum(size) AS loc, any_value(c_mktsegment) AS c_mktsegment FROM builds JOIN customer ON c_custkey = project GROUP BY 1")
add("u04_first_page_rows", lambda i: E.first_page_rows(i.table("orders").select(F.col("o_custkey").alias("name"), (F.col("o_orderkey") % 10).alias("page"), F.col("o_orderkey").alias("pos"))), "SELECT name, page, pos FROM (SELECT o_custkey AS name, o_orderkey % 10 AS page, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 10, o_orderkey) AS n FROM orders) WHERE n = 1")
add("x10_address_value", lambda i: i.runs().select("seg", "test", X.address_value(F.concat(F.lit("0x"), F.lower(F.hex("part")))).cast("long").alias("value")), "SELECT seg, test, part AS value FROM runs")
add("x12_repository_id", lambda i: i.table("pages").select("page_id", X.repository_id(F.col("url")).alias("id")), r"SELECT page_id, replace(regexp_extract(url, '([^/:]+/[^/]+?)(\.git)?/*$', 1), '/', '--') AS id FROM pages")
add("x08_paths", lambda i: i.table("pages").select("page_id", X.last_component(F.col("url")).alias("last"), X.extension(F.col("url")).alias("extension"), X.relative_path(F.col("url"), "https:/").alias("relative")), r"SELECT page_id, string_split(url, '/')[-1] AS last, regexp_extract(url, '\.([^./]*)$', 1) AS extension, CASE WHEN starts_with(url, 'https://') THEN substring(url, 8) ELSE url END AS relative FROM pages")
add("x07_split", lambda i: i.table("documents").select("doc_id", F.size(X.split_blank(F.col("text"))).alias("words"), F.size(X.split_any(F.col("text"), ".,")).alias("parts")), r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS INTEGER) AS words, CAST(len(list_filter(regexp_split_to_array(text, '[.,]'), lambda x: x <> '')) AS INTEGER) AS parts FROM documents")
add("p11_is_number", lambda i: i.table("events").select("event_id", X.is_number(F.col("event_type")).alias("a"), X.is_number(F.floor("value").cast("string")).alias("b")), "SELECT event_id, FALSE AS a, regexp_full_match(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), '[-0-9]+') AS b FROM events")
add("p12_path_suffix", lambda i: i.table("part").select("p_partkey", X.has_path_suffix(F.concat(F.lit("/a/b"), F.col("p_size"), F.lit("/c.c")), F.concat(F.lit("b"), F.col("p_partkey") % 50, F.lit("/c.c"))).alias("hit")), "SELECT p_partkey, p_size = p_partkey % 50 AS hit FROM part")
add("p10_type_bits", lambda i: i.table("part").select("p_partkey", X.type_bits(F.concat(F.when(F.col("p_size") % 2 == 0, "int").otherwise("struct x"), F.when(F.col("p_size") % 3 == 0, " *").otherwise(""), F.when(F.col("p_size") % 5 == 0, "[4]").otherwise(""))).alias("bits")), "SELECT p_partkey, (p_size % 2 = 0)::INT + 8 * (p_size % 3 = 0)::INT + 4 * (p_size % 5 = 0)::INT AS bits FROM part")
add("x11_escape_name", lambda i: i.table("part").select("p_partkey", X.escape_name(F.concat(F.lit("a["), F.col("p_size"), F.lit("].b"))).alias("name")), "SELECT p_partkey, 'a_' || p_size || '_.b' AS name FROM part")
add("x14_condition_parts", lambda i: i.table("part").select("p_partkey", X.condition_parts(F.concat(F.lit("x + 1 >= "), F.col("p_size"), F.lit(" + y"))).alias("c")).select("p_partkey", "c.lhs", "c.op", X.condition_tokens(F.col("c.rhs")).alias("tokens")), "SELECT p_partkey, 'x + 1' AS lhs, '>=' AS op, [CAST(p_size AS VARCHAR), 'y'] AS tokens FROM part")
add("x16_formula", lambda i: i.table("part").select("p_partkey", X.formula(F.col("p_size") % 4, F.col("p_partkey") % 3, F.lit("n")).alias("f")), "SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'n' ELSE (p_size % 4) || ' * n' END || CASE p_partkey % 3 WHEN 0 THEN '' ELSE ' + ' || (p_partkey % 3) END AS f FROM part")
add("x06_assertion_condition", lambda i: i.table("part").select("p_partkey", X.assertion_condition(F.concat(F.lit("  assert(p"), F.col("p_size"), F.lit(" != NULL);"))).alias("c")), "SELECT p_partkey, 'output_int_p' || p_size || ' != 0' AS c FROM part")
add("x19_options", lambda i: i.table("part").select("p_partkey", X.option_flags(F.concat(F.lit("ab:c"), F.col("p_size") % 10)).alias("flags"), X.option_values(F.lit("ab:c")).alias("values")), "SELECT p_partkey, ['a', 'c', CAST(p_size % 10 AS VARCHAR)] AS flags, ['b'] AS values FROM part")
add("x04_declarations", lambda i: i.table("part").select("p_partkey", X.function_declaration(F.concat(F.lit("static inline int f"), F.col("p_partkey"), F.lit("(int a)\n{ return a; }"))).alias("f"), X.record_declaration(F.concat(F.lit("struct s"), F.col("p_partkey"), F.lit(" {\n int a; }"))).alias("r")), "SELECT p_partkey, 'static int f' || p_partkey || '(int a);' AS f, 'struct s' || p_partkey || ';' AS r FROM part")
add("x17_marked_tokens", lambda i: i.table("part").select("p_partkey", X.marked_tokens(F.repeat(F.lit("(a *b)"), F.col("p_size") % 5)).alias("n")), "SELECT p_partkey, CAST(p_size % 5 AS INTEGER) AS n FROM part")
