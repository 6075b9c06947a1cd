"""Registered queries of the mining operators."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from srcfacts.operators import mining as M
from srcfacts.operators import regression as L
from srcfacts.plans.registry import add

FORMULAS = ["output_int_a > input_int_qty", "output_int_e >= input_int_qty", "output_int_c = 3", "output_addr_n = nil", "input_int_qty < input_int_line + output_int_e", "output_int_zz = 1"]
_HOLDS = """SELECT f.formula, l.seg, l.test, CASE f.op WHEN '>' THEN l.v > r WHEN '>=' THEN l.v >= r WHEN '=' THEN l.v = r ELSE l.v < r END AS holds
 FROM (VALUES ('output_int_a > input_int_qty', 'output_int_a', '>', 'input_int_qty', NULL, 0), ('output_int_e >= input_int_qty', 'output_int_e', '>=', 'input_int_qty', NULL, 0),
  ('output_int_c = 3', 'output_int_c', '=', NULL, NULL, 3), ('output_addr_n = nil', 'output_addr_n', '=', NULL, NULL, 0),
  ('input_int_qty < input_int_line + output_int_e', 'input_int_qty', '<', 'input_int_line', 'output_int_e', 0)) f(formula, lhs, op, r1, r2, k)
 JOIN values_of l ON l.name = f.lhs LEFT JOIN values_of a ON a.name = f.r1 AND a.seg = l.seg AND a.test = l.test
 LEFT JOIN values_of b ON b.name = f.r2 AND b.seg = l.seg AND b.test = l.test, LATERAL (SELECT coalesce(a.v, 0) + coalesce(b.v, 0) + f.k AS r) WHERE (f.r1 IS NULL OR a.v IS NOT NULL) AND (f.r2 IS NULL OR b.v IS NOT NULL)"""


def _formulas(i):
    return i.spark.createDataFrame([(f,) for f in FORMULAS], "formula string")


add("m01_wide", lambda i: M.wide(i.trace(), ["input_int_qty", "input_addr_p", "output_int_a", "output_int_d", "output_addr_n"]),
    "SELECT seg, test, CAST(qty AS VARCHAR) AS input_int_qty, '0x' || part AS input_addr_p, CAST((seg % 3 + 1) * qty + seg % 5 AS VARCHAR) AS output_int_a, CAST(CASE WHEN line <> 7 THEN qty % 7 END AS VARCHAR) AS output_int_d, '(nil)' AS output_addr_n FROM runs")
add("m01_long", lambda i: M.long(M.wide(i.trace(), ["input_int_qty", "output_int_d"])), "SELECT seg, test, side, key, value FROM known WHERE (side, key) IN (('input', 'int_qty'), ('output', 'int_d'))")
add("m02_constants", lambda i: M.constants(i.trace()), "SELECT seg, y AS key, CASE min(yv) WHEN '(nil)' THEN 'nil' ELSE min(yv) END AS value, count(*) AS n FROM outs GROUP BY 1, 2 HAVING count(*) >= 3 AND min(yv) = max(yv)")
add("m03_address_copies", lambda i: M.address_copies(i.trace()), "SELECT seg, x, y, count(*) AS n FROM pairs WHERE contains(x, 'addr') AND contains(y, 'addr') GROUP BY ALL HAVING count(*) >= 3 AND bool_and(xv = yv)")
LINEAR_SQL = """WITH s AS (SELECT seg, x, y, count(*) AS n, sum(CAST(xv AS HUGEINT)) AS sx, sum(CAST(yv AS HUGEINT)) AS sy, sum(CAST(xv AS HUGEINT) * CAST(xv AS HUGEINT)) AS sxx,
  sum(CAST(xv AS HUGEINT) * CAST(yv AS HUGEINT)) AS sxy, sum(CAST(yv AS HUGEINT) * CAST(yv AS HUGEINT)) AS syy FROM pairs WHERE NOT contains(x, 'addr') AND NOT contains(y, 'addr') GROUP BY ALL),
 t AS (SELECT *, n * sxy - sx * sy AS top, n * sxx - sx * sx AS bottom, n * syy - sy * sy AS spread FROM s WHERE n >= 3),
 k AS (SELECT *, CAST(top // bottom AS BIGINT) AS slope, round((CAST(sy AS DOUBLE) - CAST(top // bottom AS DOUBLE) * CAST(sx AS DOUBLE)) / n, 3) AS intercept FROM t WHERE bottom <> 0 AND spread <> 0 AND top % bottom = 0 AND top <> 0 AND top * top = bottom * spread)
 SELECT seg, y, x, slope, intercept, n, y || ' = ' || CASE WHEN slope = 1 THEN x ELSE slope || ' * ' || x END || CASE WHEN intercept = 0 THEN '' ELSE ' + ' || regexp_replace(CAST(intercept AS VARCHAR), '\\.0+$', '') END AS rule FROM k"""
add("m04_linear", lambda i: M.linear(i.trace()), LINEAR_SQL)
add("m05_linear_two", lambda i: M.linear_two(i.trace()), """WITH s AS (SELECT p.seg, p.x AS x1, q.x AS x2, y, count(*) AS n, CAST(sum(CAST(p.xv AS BIGINT)) AS HUGEINT) AS sa, CAST(sum(CAST(q.xv AS BIGINT)) AS HUGEINT) AS sb, CAST(sum(CAST(yv AS BIGINT)) AS HUGEINT) AS sc,
  sum(CAST(p.xv AS BIGINT) * CAST(p.xv AS BIGINT)) AS saa, sum(CAST(q.xv AS BIGINT) * CAST(q.xv AS BIGINT)) AS sbb, sum(CAST(yv AS BIGINT) * CAST(yv AS BIGINT)) AS scc,
  sum(CAST(p.xv AS BIGINT) * CAST(q.xv AS BIGINT)) AS sab, sum(CAST(p.xv AS BIGINT) * CAST(yv AS BIGINT)) AS sac, sum(CAST(q.xv AS BIGINT) * CAST(yv AS BIGINT)) AS sbc
  FROM ins p JOIN ins q ON p.seg = q.seg AND p.test = q.test AND p.x < q.x JOIN outs o ON o.seg = p.seg AND o.test = p.test WHERE NOT contains(p.x, 'addr') AND NOT contains(q.x, 'addr') AND NOT contains(y, 'addr') GROUP BY ALL),
 v AS (SELECT *, n * saa - sa * sa AS vaa, n * sbb - sb * sb AS vbb, n * scc - sc * sc AS vcc, n * sab - sa * sb AS vab, n * sac - sa * sc AS vac, n * sbc - sb * sc AS vbc FROM s WHERE n >= 3),
 d AS (SELECT *, vaa * vbb - vab * vab AS det, vac * vbb - vbc * vab AS t1, vbc * vaa - vac * vab AS t2 FROM v), k AS (SELECT *, t1 // det AS k1, t2 // det AS k2 FROM d WHERE det <> 0 AND vcc <> 0 AND t1 % det = 0 AND t2 % det = 0)
 SELECT seg, y, x1, x2, CAST(k1 AS BIGINT) AS slope1, CAST(k2 AS BIGINT) AS slope2, round(CAST(sc - k1 * sa - k2 * sb AS DOUBLE) / n, 3) AS intercept, n FROM k WHERE k1 <> 0 AND k2 <> 0 AND k1 * vac + k2 * vbc = vcc""")
add("m06_argument_outputs", lambda i: M.argument_outputs(i.trace()), """SELECT o.seg, y, count(*) AS n, sum(CASE WHEN a.xv IS NULL THEN 1 ELSE 0 END) AS missed FROM outs o LEFT JOIN (SELECT DISTINCT seg, test, xv FROM ins WHERE contains(x, 'argv')) a
 ON a.seg = o.seg AND a.test = o.test AND a.xv = o.yv GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(CASE WHEN a.xv IS NULL THEN 1 ELSE 0 END) < 0.1 * count(*)""")
_NUMBER = lambda v: f"CASE WHEN {v} = '(nil)' THEN 0 ELSE CAST({v} AS BIGINT) END"  # noqa: E731  reads 0x.. as well
_REL = f"SELECT seg, x, y, count(*) AS confidence, bool_and(a = b) AS eq, bool_and(a <= b) AS le, bool_and(a >= b) AS ge, bool_and(a < b) AS lt, bool_and(a > b) AS gt FROM (SELECT seg, x, y, {_NUMBER('xv')} AS a, {_NUMBER('yv')} AS b FROM pairs WHERE contains(x, 'addr') = contains(y, 'addr')) GROUP BY 1, 2, 3 HAVING count(*) >= 2"
add("m07_relations", lambda i: M.relations(i.trace()), f"SELECT seg, x, y, CASE WHEN eq THEN '=' WHEN le THEN '<=' ELSE '>=' END AS op, confidence FROM ({_REL}) WHERE eq OR le OR ge")
add("m07_relations_strict", lambda i: M.relations(i.trace(), strict=True), f"SELECT seg, x, y, CASE WHEN eq THEN '=' WHEN lt THEN '<' WHEN gt THEN '>' WHEN le THEN '<=' ELSE '>=' END AS op, confidence FROM ({_REL}) WHERE eq OR le OR ge")
add("m08_distances", lambda i: M.distances(i.trace()), f"""SELECT seg, x, y, min(d) AS distance, count(*) AS n FROM (SELECT seg, x, y, {_NUMBER('yv')} - {_NUMBER('xv')} AS d FROM pairs
 WHERE contains(x, 'addr') = contains(y, 'addr')) GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND min(d) = max(d)""")
add("m09_discovered_constants", lambda i: M.discovered_constants(i.trace()), "SELECT seg, key, min(v) AS value FROM numbers GROUP BY seg, side, key HAVING count(*) >= 2 AND min(v) = max(v)")
add("m10_preconditions", lambda i: M.preconditions(i.trace()), """SELECT r.seg, x, constant, CASE WHEN low = constant AND high = constant THEN '=' WHEN high <= constant THEN '<=' ELSE '>=' END AS op
 FROM (SELECT seg, key AS x, min(v) AS low, max(v) AS high FROM numbers WHERE side = 'input' GROUP BY 1, 2 HAVING count(*) >= 2) r
 JOIN (SELECT DISTINCT seg, constant FROM (SELECT seg, side, key, min(v) AS constant FROM numbers GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND min(v) = max(v))) c USING (seg) WHERE high <= constant OR low >= constant""")
add("m11_templates", lambda i: M.check_templates(i.trace(), _formulas(i)), f"SELECT seg, formula, count(*) AS n FROM ({_HOLDS}) GROUP BY 1, 2 HAVING bool_and(holds)")
add("m12_column_ranges", lambda i: M.column_ranges(i.trace()), "SELECT seg, side, key, count(*) AS n, min(v) AS low, max(v) AS high FROM numbers GROUP BY 1, 2, 3")
add("m12_full_pairs", lambda i: M.full_pairs(i.trace()), """WITH f AS (SELECT seg, side || '_' || key AS key FROM numbers GROUP BY seg, side, key HAVING count(*) > 5 AND count(*) = (SELECT count(*) FROM runs r WHERE r.seg = numbers.seg)),
 k AS (SELECT n.seg, n.test, side || '_' || n.key AS key, v FROM numbers n JOIN f ON f.seg = n.seg AND f.key = side || '_' || n.key)
 SELECT seg, x, y, CASE WHEN eq THEN '=' WHEN le THEN '<=' ELSE '>=' END AS op FROM (SELECT a.seg, a.key AS x, b.key AS y, bool_and(a.v = b.v) AS eq, bool_and(a.v <= b.v) AS le, bool_and(a.v >= b.v) AS ge FROM k a JOIN k b ON a.seg = b.seg AND a.test = b.test AND a.key < b.key GROUP BY 1, 2, 3) WHERE eq OR le OR ge""")
add("m13_sign_facts", lambda i: M.sign_facts(i.trace()), """SELECT seg, side, key, CASE WHEN min(v) > 0 THEN '0<' WHEN min(v) >= 0 THEN '0<=' WHEN max(v) < 0 THEN '<0' ELSE '<=0' END AS fact FROM numbers GROUP BY 1, 2, 3 HAVING min(v) >= 0 OR max(v) <= 0
 UNION ALL SELECT seg, side, key, 'not null' FROM known WHERE contains(key, 'addr') GROUP BY 1, 2, 3 HAVING NOT bool_or(value IN ('(nil)', '0x0'))""")
add("m13_pair_facts", lambda i: M.pair_facts(i.trace()), """WITH v AS (SELECT seg, test, side || '_' || key AS name, v FROM numbers), c AS (SELECT seg, name, count(*) AS n FROM v GROUP BY 1, 2),
 r AS (SELECT a.seg, a.name AS x, b.name AS y, count(*) AS n, bool_and(a.v <= b.v) AS le, bool_or(a.v = b.v) AS eq FROM v a JOIN v b ON a.seg = b.seg AND a.test = b.test AND a.name <> b.name GROUP BY 1, 2, 3)
 SELECT r.seg, x, y, CASE WHEN eq THEN '<=' ELSE '<' END AS fact FROM r JOIN c p ON p.seg = r.seg AND p.name = x JOIN c q ON q.seg = r.seg AND q.name = y WHERE le AND r.n >= 2 AND p.n = q.n""")
add("m14_column_classes", lambda i: M.column_classes(i.trace()), "SELECT seg, side, key, CASE WHEN min(value) = max(value) THEN 'unchanged' WHEN bool_and(value IN ('0', '1')) THEN 'binary' ELSE 'changed' END AS class FROM known GROUP BY 1, 2, 3")
add("m15_features", lambda i: M.features(i.runs().select("seg", "test", "qty", "line"), ["qty", "line"]), """SELECT seg, test, qty, line, CAST(qty AS DOUBLE) * line AS qty_x_line, CAST(qty AS DOUBLE) / nullif(line, 0) AS qty_by_line, CAST(line AS DOUBLE) / nullif(qty, 0) AS line_by_qty,
 CAST(qty AS DOUBLE) * qty AS qty_2, CAST(qty AS DOUBLE) * qty * qty AS qty_3, CAST(line AS DOUBLE) * line * line AS line_3 FROM runs""")
add("m19_run_differences", lambda i: M.run_differences(*[i.trace().where(f"side = '{s}' and key in ('int_qty', 'int_a')").select(F.concat_ws("_", "seg", "test").alias("row"), F.concat(F.lit("int_"), F.col("seg")).alias("key"), "value") for s in ("input", "output")]),
    "SELECT 'int_' || seg AS key, min(CAST(yv AS BIGINT) - CAST(xv AS BIGINT)) AS difference, count(*) AS n FROM pairs WHERE x = 'int_qty' AND y = 'int_a' GROUP BY 1 HAVING count(*) >= 3 AND min(CAST(yv AS BIGINT) - CAST(xv AS BIGINT)) = max(CAST(yv AS BIGINT) - CAST(xv AS BIGINT))")
_TRANSFERS = "SELECT seg, 'output_' || y AS lhs, min_by('input_' || x, x) AS rhs FROM pairs WHERE NOT contains(x, 'addr') AND NOT contains(y, 'addr') GROUP BY seg, y, x HAVING count(*) >= 2 AND bool_and(xv = yv)"


def _transfers(i):
    same = M.relations(i.trace()).where("op = '='")
    return same.select("seg", F.concat(F.lit("output_"), "y").alias("lhs"), F.concat(F.lit("input_"), "x").alias("rhs"), F.col("x").alias("pos"))


def _conditions(i):
    return i.spark.createDataFrame([(1, "output_int_d > 5"), (2, "output_int_d > output_int_a"), (3, "output_addr_q = nil"), (4, "1 > 2")], "id int, condition string")


_SAME = "SELECT seg, 'output_' || y AS lhs, min('input_' || x) AS rhs FROM (SELECT seg, x, y FROM pairs WHERE contains(x, 'addr') = contains(y, 'addr') GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND bool_and(xv = yv)) GROUP BY 1, 2"
add("m20_used_transfers", lambda i: M.used_transfers(_transfers(i), _conditions(i)), f"SELECT id, seg, s.lhs, rhs FROM ({_SAME}) s JOIN (VALUES (1, 'output_int_d'), (2, 'output_int_d'), (2, 'output_int_a'), (3, 'output_addr_q')) c(id, lhs) ON c.lhs = s.lhs")
add("m21_mappable", lambda i: M.mappable(_transfers(i), _conditions(i)), f"""WITH t AS (SELECT seg, 'output_' || y AS lhs, 'input_' || x AS rhs FROM (SELECT seg, x, y FROM pairs WHERE contains(x, 'addr') = contains(y, 'addr') GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND bool_and(xv = yv))),
 c AS (SELECT * FROM (VALUES (1, 'output_int_d'), (2, 'output_int_d'), (2, 'output_int_a'), (3, 'output_addr_q')) v(id, lhs))
 SELECT id, seg, count(*) = count(CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.seg = s.seg AND t.lhs = c.lhs AND contains(rhs, 'argv')) THEN 1 END) AS mapped FROM c, (SELECT DISTINCT seg FROM t) s GROUP BY 1, 2""")
add("m22_condition_truth", lambda i: M.condition_truth(i.trace(), _formulas(i)), f"""SELECT s.seg, f.formula, CASE WHEN h.every THEN 'always' WHEN NOT h.some THEN 'never' WHEN h.some THEN 'sometimes' ELSE 'unknown' END AS truth
 FROM (SELECT DISTINCT seg FROM runs) s, (VALUES {", ".join(f"('{f}')" for f in FORMULAS)}) f(formula) LEFT JOIN (SELECT seg, formula, bool_and(holds) AS every, bool_or(holds) AS some FROM ({_HOLDS}) GROUP BY 1, 2) h ON h.seg = s.seg AND h.formula = f.formula""")


def _profiles(i):
    rules = M.constants(i.trace()).select("seg", F.concat_ws("=", "key", "value").alias("fact"))
    return rules.groupBy("seg").agg(F.array_join(F.array_sort(F.collect_list("fact")), ";").alias("transfer")).select("seg", (F.col("seg") % 4).alias("head"), "transfer", F.concat_ws("|", "transfer", (F.col("seg") % 2).cast("string")).alias("transfer_all"))


add("m23_merge_segments", lambda i: M.merge_segments(_profiles(i)), """SELECT head, list_sort(list(seg)) AS merged FROM (SELECT seg, seg % 4 AS head, string_agg(key || '=' || value, ';' ORDER BY key || '=' || value) AS transfer FROM
 (SELECT seg, y AS key, CASE min(yv) WHEN '(nil)' THEN 'nil' ELSE min(yv) END AS value FROM outs GROUP BY 1, 2 HAVING count(*) >= 3 AND min(yv) = max(yv)) GROUP BY 1, 2) GROUP BY head, transfer""")
add("p01_trials_fail", lambda i: M.select_trials(i.runs(), "fail"), "SELECT * FROM runs WHERE reach_code = 5 AND status_code = 1")
add("p01_trials_success", lambda i: M.select_trials(i.runs(), "success"), "SELECT * FROM runs WHERE reach_code = 5 AND status_code = 0")
add("p01_trials_all", lambda i: M.select_trials(i.runs(), "all"), "SELECT * FROM runs WHERE reach_code >= 5")
add("p02_drop_status", lambda i: M.drop_status(i.runs()), "SELECT seg, test, qty, line, part FROM runs")
add("a04_trial_meta", lambda i: M.trial_meta(i.runs()), "SELECT seg, count(*) AS tests, sum((reach_code >= 5)::INT) AS reached, sum((reach_code = 5 AND status_code = 1)::INT) AS failed FROM runs GROUP BY 1")
add("a05_segment_flags", lambda i: M.segment_flags(i.runs()), "SELECT seg, bool_or(reach_code >= 5) AS covered, bool_or(reach_code = 5 AND status_code = 1) AS triggered FROM runs GROUP BY 1")
add("a07_reach_summary", lambda i: M.reach_summary(i.runs()), """SELECT seg, sum((reach_code >= 5 AND status_code = 0)::INT) AS reached_success, sum((reach_code >= 5 AND status_code <> 0)::INT) AS reached_failure,
 sum((reach_code < 5 AND status_code = 0)::INT) AS missed_success, sum((reach_code < 5 AND status_code <> 0)::INT) AS missed_failure, count(*) AS total FROM runs GROUP BY 1""")


# --- least squares: closed forms of centred sums over the tests that have all number columns of their segment
_INS = ("int_argv_1", "int_line", "int_qty")


def _square(rows, columns):
    """Determinant of centred sums c_<row>_<column> in SQL, along the first row."""
    if not rows:
        return "1.0"
    rest = [f"c_{rows[0]}_{c} * ({_square(rows[1:], [x for x in columns if x != c])})" for c in columns]
    return " ".join(("+ " if k % 2 == 0 else "- ") + term for k, term in enumerate(rest))


def _fitted(xs):
    """(slopes, r2) in SQL of y on the inputs, by Cramer's rule."""
    whole = _square(xs, xs)
    slopes = [f"({_square(xs, xs[:k] + ('y',) + xs[k + 1:])}) / ({whole})" for k in range(len(xs))]
    return slopes, "(" + " + ".join(f"{s} * c_{x}_y" for s, x in zip(slopes, xs, strict=True)) + ") / c_y_y"


_PAIRS = [(a, b) for k, a in enumerate((*_INS, "y")) for b in (*_INS, "y")[k:]]
_CENTRED = "WITH w AS (SELECT seg, test, " + ", ".join(f"max(CASE WHEN side = 'input' AND key = '{x}' THEN v END)::HUGEINT AS {x}" for x in _INS) + ", count(DISTINCT (side, key)) AS k FROM numbers GROUP BY 1, 2), " + \
    "full_ AS (SELECT w.* FROM w JOIN (SELECT seg, count(DISTINCT (side, key)) AS k FROM numbers GROUP BY 1) s ON s.seg = w.seg AND s.k = w.k), " + \
    "p AS (SELECT f.*, o.key AS name, o.v::HUGEINT AS y FROM full_ f JOIN numbers o ON o.seg = f.seg AND o.test = f.test AND o.side = 'output'), " + \
    "c AS (SELECT seg, 'output_' || name AS name, count(*) AS n, " + ", ".join(f"(count(*) * sum({a} * {b}) - sum({a}) * sum({b}))::DOUBLE AS c_{a}_{b}" for a, b in _PAIRS) + " FROM p GROUP BY 1, 2), " + \
    "d AS (SELECT *, " + ", ".join(f"c_{a}_{b} AS c_{b}_{a}" for a, b in _PAIRS if a != b) + " FROM c)"


def _rows_sql(xs):
    slopes, r2 = _fitted(xs)
    named = ", ".join(f"'input_{x}'" for x in xs)
    return f"SELECT seg, name AS y, [{named}] AS xs, [{', '.join(f'round({s}, 4) + 0.0' for s in slopes)}] AS slopes, round({r2}, 6) AS r2, {r2} AS exact, n FROM d WHERE c_y_y <> 0"


def _rounded(df):
    return df.select("seg", "y", "xs", F.transform("slopes", lambda v: F.round(v, 4) + F.lit(0.0)).alias("slopes"), F.round("r2", 6).alias("r2"), "n")


_SUBSETS = [xs for size in (1, 2, 3) for xs in combinations(_INS, size)]
add("m16_least_squares", lambda i: _rounded(L.least_squares(i.trace())), f"""{_CENTRED} SELECT seg, y, xs, slopes, r2, n FROM ({_rows_sql(_INS)}) WHERE n > 3 AND exact > 0.9
 UNION ALL SELECT seg, name, []::VARCHAR[], []::DOUBLE[], 1.0, n FROM d WHERE n >= 3 AND c_y_y = 0""")
add("m17_subset_regression", lambda i: _rounded(L.subset_regression(i.trace())), f"{_CENTRED} SELECT seg, y, xs, slopes, r2, n FROM ({' UNION ALL '.join(map(_rows_sql, _SUBSETS))}) WHERE n >= greatest(3, len(xs) + 2) AND exact >= 0.8")
add("m18_piecewise", lambda i: L.piecewise(i.trace()))
