"""Operators on ordered lines: state carried along a file, blocks, records.

Lines are (file, line_no, line) with line_no giving the order in the file. What is carried along a file goes through ``scan``, which
works in pieces: a file of any length is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcfacts.functions import text as X
from srcfacts.operators.scan import scanned
from srcfacts.session import cut


def _one(opens: Column) -> Column:
    return F.when(opens, 1).otherwise(0)


def to_lines(files: DataFrame) -> DataFrame:
    """(file, text) to (file, line_no from 1, line)."""
    return files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).select("file", (F.col("line_no") + 1).alias("line_no"), "line")


def matching_lines(lines: DataFrame, text: str) -> DataFrame:
    return lines.where(F.contains("line", F.lit(text)))


def first_match(lines: DataFrame, text: str) -> DataFrame:
    return matching_lines(lines, text).groupBy("file").agg(F.min("line_no").alias("line_no"))


#: What a line holds, tested in this order: (text, side or None, reach code). Ends come before their beginnings.
STAGES = (("INPUT_SPEC_END", None, 3), ("INPUT_SPEC", "input", 2), ("POI_INSTRUMENT_END", None, 5), ("POI_INSTRUMENT", "output", 4), ("AFTER_POI", None, 6))
CLOSINGS = (("TEST_SUCCESS", 0), ("TEST_FAILURE", 1))


def trace_records(lines: DataFrame, stages=STAGES, closings=CLOSINGS, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """(file, test, side, key, value, reach_code, status_code): log lines to the values of each test.

    A closing line ends a test and is its status; what follows the last closing is dropped. ``k = v`` belongs to the side
    that was opened last in the test (input before any); of a repeated key the last value counts; text behind
    a second = is dropped. Tests are numbered from 1; a test without values has one row with null key.
    """
    line = F.col("line")
    code, status, opened = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for text, side, reach in reversed(stages):
        code = F.when(F.contains(line, F.lit(text)), reach).otherwise(code)
        opened = F.when(F.contains(line, F.lit(text)), side).otherwise(opened)
    for text, value in closings:
        status = F.coalesce(status, F.when(F.contains(line, F.lit(text)), value))
    marked = lines.withColumn("code", code).withColumn("opened", opened).withColumn("status", F.when(F.col("code").isNull(), status))
    ends = F.col("status").isNotNull()
    side = F.when(ends, F.struct(F.lit(None).cast("string").alias("at"))).when(F.col("opened").isNotNull(), F.struct(F.col("opened").alias("at")))
    rows = scanned(marked, last={"side": side}, sums={"closed": _one(ends)}, order=order)
    rows = rows.withColumn("test", F.col("closed") - _one(ends) + 1).withColumn("side", F.col("side.at"))
    part = F.split(line, "=", -1)
    is_value = F.col("code").isNull() & F.col("status").isNull() & line.contains("=")
    place = F.struct(*[F.col(c) for c in order])
    rows = rows.withColumn("key", F.when(is_value, F.trim(part[0]))).withColumn("value", F.when(is_value, F.trim(part[1]))).withColumn("place", place)
    tests = rows.groupBy("file", "test").agg(F.max_by("code", F.when(F.col("code").isNotNull(), F.col("place"))).alias("reach_code"), F.max("status").alias("status_code")).where("status_code is not null")
    values = rows.where("key is not null").groupBy("file", "test", F.coalesce("side", F.lit("input")).alias("side"), "key").agg(F.max_by("value", "place").alias("value"))
    return tests.join(values, ["file", "test"], "left").select("file", "test", "side", "key", "value", F.coalesce("reach_code", F.lit(1)).alias("reach_code"), "status_code")


# Field lines of a run log, as (text, column, type).
RUN_FIELDS = (
    ("Segment Size", "seg_size", "int"), ("Procedure Number", "proc_num", "int"), ("Branch Number", "branch_num", "int"), ("Loop Number", "loop_num", "int"),
    ("Compile", "compilible", "boolean"), ("Number of input", "var_num", "int"), ("Number of tests", "test_num", "int"), ("Test Generation Time", "gen_time", "string"),
    ("Total Testing Time", "total_time", "string"), ("Stmt Coverage", "stmt_cov", "string"), ("Branch Coverage", "branch_cov", "string"), ("Number of Pass Test", "pass_num", "int"),
    ("Number of Fail Test", "fail_num", "int"), ("Total reach poi", "covered_num", "int"), ("Total fail poi", "bug_triggered_num", "int"),
)


def segment_results(lines: DataFrame, opens: str = "Processing query", fields=RUN_FIELDS) -> DataFrame:
    """One row a segment: a line with ``opens`` begins it, field lines ``name: value`` fill its columns, the last value wins.
    Every segment has its row, the last one too; columns without a line are null."""
    rows = scanned(lines, sums={"seg": _one(F.contains("line", F.lit(opens)))}).where("seg > 0")
    value = F.trim(F.split("line", ":", -1)[1])

    def field(text: str, name: str, kind: str) -> Column:
        here = F.contains("line", F.lit(text))
        last = F.max_by(F.when(here, value), F.when(here, F.col("line_no")))
        return (last == "true" if kind == "boolean" else last.try_cast(kind) if kind != "string" else last).alias(name)

    return rows.groupBy("file", "seg").agg(*[field(*f) for f in fields])


def last_complete_block(lines: DataFrame, opens: str = "POI_INSTRUMENT", order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Lines before the first block and those of the last block but one, as the last may be cut off; a single block stays."""
    begins = _one(F.col("line").rlike(rf"\b{opens}\b"))
    rows = scanned(lines, sums={"block": begins}, totals={"blocks": begins}, order=order)
    return rows.where((F.col("block") == 0) | (F.col("block") == F.greatest(F.lit(1), F.col("blocks") - 1))).drop("block", "blocks")


def written_with_counts(lines: DataFrame, counts: str = r"IOData\D*(\d+)\D+(\d+)", written: str = r"Output written to\s+(\S*sel-(\d+)\.json)", order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """(file, id, n_input, n_output, path): each written file with the latest counts before it, where both aren't 0.

    Once a line with two counts was seen, later files without one of their own take it; a line with a 0 resets it.
    """
    line = F.col("line")
    i, o = (F.regexp_extract(line, counts, k).try_cast("int") for k in (1, 2))
    state = F.when(line.rlike(counts), F.struct(i.alias("i"), o.alias("o")))
    rows = scanned(lines, last={"state": state}, order=order).where(line.rlike(written) & (F.col("state.i") > 0) & (F.col("state.o") > 0))
    return rows.select("file", F.regexp_extract("line", written, 2).cast("long").alias("id"), F.col("state.i").alias("n_input"), F.col("state.o").alias("n_output"), F.regexp_extract("line", written, 1).alias("path"))


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Dense numbers over all rows in an order, nulls first, without a window over all of them.

    Rows go to ranges of the order, are sorted there and checkpointed with their place; what is ordered as a whole is one
    count a range. No key has to fit into a task.
    """
    place = F.monotonically_increasing_id()  # the range in the upper 31 bits, the place in it in the lower 33
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row a range
    joined = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + start).drop("__part", "__before", "__at")


def first_after(lines: DataFrame, opens: str, wanted: str, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """The first ``wanted`` line after each ``opens`` line (regular expressions)."""
    rows = scanned(lines, sums={"block": _one(F.col("line").rlike(opens))}, order=order).where((F.col("block") > 0) & F.col("line").rlike(wanted) & ~F.col("line").rlike(opens))
    first = rows.groupBy("file", "block").agg(F.min_by(F.struct(*rows.columns), F.struct(*[F.col(c) for c in order])).alias("x"))
    return first.select("x.*")


def sessions(lines: DataFrame, opens: str = r"NO\.", name: str = r"^\S+\s+\S+\s+(\S+)", order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Lines with ``session`` (0 before the first) and the name in the session's opening line."""
    found = F.when(F.col("line").rlike(opens), F.regexp_extract("line", name, 1))
    return scanned(lines, last={"session_name": found}, sums={"session": _one(F.col("line").rlike(opens))}, order=order)


def errors_per_session(sessions_df: DataFrame, error: str = "error:") -> DataFrame:
    """(file, session, session_name, errors, good) of each session."""
    found = sessions_df.where("session > 0").groupBy("file", "session").agg(F.first("session_name", ignorenulls=True).alias("session_name"), F.sum(F.when(F.contains("line", F.lit(error)), 1).otherwise(0)).alias("errors"))
    return found.withColumn("good", F.col("errors") == 0)


MARKER = r'^#\s*(?:line\s+)?(\d+)\s+"([^"]*)"'


def keep_own_lines(lines: DataFrame) -> DataFrame:
    """Preprocessed lines whose latest ``# n "name"`` marker names the file itself; markers are left out, malformed ones change nothing."""
    line = F.col("line")
    name = F.when(line.rlike(MARKER), F.regexp_extract(line, MARKER, 2))
    rows = scanned(lines, last={"own": F.when(name.isNotNull(), X.has_path_suffix(F.col("file"), name) | X.has_path_suffix(name, F.col("file")))})
    return rows.where(F.coalesce("own", F.lit(False)) & ~line.startswith("#")).drop("own")


def neutralize_assert(lines: DataFrame) -> DataFrame:
    """Includes of <assert.h> become comments."""
    hit = F.col("line").rlike(r"^\s*#\s*include\s*<assert\.h>")
    return lines.withColumn("line", F.when(hit, F.concat(F.lit("// "), "line")).otherwise(F.col("line")))


def angle_includes(lines: DataFrame) -> DataFrame:
    """(file, includes array): angled targets in order."""
    target = X.include_target(F.col("line"))
    rows = lines.where(X.include_is_system(F.col("line"))).select("file", F.struct("line_no", target.alias("t")).alias("x"))
    return rows.groupBy("file").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]).alias("includes"))


def map_lines(lines: DataFrame, points: DataFrame) -> DataFrame:
    """(file, line, mapped): a line of the source to its line in the preprocessed text, through the markers of the file itself."""
    own = X.has_path_suffix(F.col("file"), F.regexp_extract("line", MARKER, 2)) | X.has_path_suffix(F.regexp_extract("line", MARKER, 2), F.col("file"))
    markers = lines.where(F.col("line").rlike(MARKER) & own).select("file", F.regexp_extract("line", MARKER, 1).cast("int").alias("at"), F.col("line_no").alias("marker"))
    asked = points.select("file", "line").distinct().select("file", F.col("line").alias("at"), F.lit(None).cast(markers.schema["marker"].dataType).alias("marker"), F.lit(1).alias("kind"))
    both = markers.withColumn("kind", F.lit(0)).union(asked)
    found = scanned(both, last={"m": F.when(F.col("kind") == 0, F.struct("at", "marker"))}, order=("at", "kind", "marker")).where("kind = 1 and m is not null")
    return found.select("file", F.col("at").alias("line"), (F.col("m.marker") + 1 + F.col("at") - F.col("m.at")).alias("mapped"))


def dedupe_lines(lines: DataFrame) -> DataFrame:
    """The first of equal lines of a file."""
    return lines.groupBy("file", "line").agg(F.min("line_no").alias("line_no")).select("file", "line_no", "line")


def parse_clone_report(lines: DataFrame) -> DataFrame:
    """(file, class, type, id, path, begin, end): fragments of classes that aren't of type 1; ids dense over those kept.

    A line ``-- Type: n`` opens a class, ``File:`` names a fragment's file and ``Position: line a - line b`` its lines.
    """
    line = F.col("line")
    opens = line.rlike(r"^--\s*Type")
    kind = F.when(opens, F.regexp_extract(line, r"Type:?\s*(\d+)", 1).try_cast("int"))
    path = F.when(opens, F.struct(F.lit(None).cast("string").alias("at"))).when(line.rlike(r"^\s*File:"), F.struct(F.trim(F.regexp_extract(line, r"File:(.*)", 1)).alias("at")))
    rows = scanned(lines, last={"type": kind, "path": path}, sums={"class": _one(opens)}).withColumn("path", F.col("path.at"))
    position = r"Position:\D*(\d+)\D+(\d+)"
    kept = rows.where(line.rlike(position) & (F.col("type") != 1)).select("file", "line_no", "class", "type", "path", F.regexp_extract("line", position, 1).cast("int").alias("begin"), F.regexp_extract("line", position, 2).cast("int").alias("end"))
    return number_rows(kept, ["file", "line_no"], "id").select("file", "class", "type", F.col("id").cast("long").alias("id"), "path", "begin", "end")


IO_VALUE = r"^\s*(input|output):\s*(.*?)\s*([A-Za-z_][\w.\[\]]*)\s*=\s*(.*?)\s*$"


def parse_io_values(lines: DataFrame) -> DataFrame:
    """``input: int a=8`` to (file, line_no, side, type, key, value)."""
    part = lambda i: F.regexp_extract("line", IO_VALUE, i)
    return lines.where(F.col("line").rlike(IO_VALUE)).select("file", "line_no", part(1).alias("side"), part(2).alias("type"), part(3).alias("key"), part(4).alias("value"))


def parse_slices(lines: DataFrame) -> DataFrame:
    """(report, crit_file, crit_line, path, line): blocks opened by ``====``, a criterion line, then ``file line`` rows;
    absolute paths are dropped."""
    rows = scanned(lines, sums={"block": _one(F.startswith("line", F.lit("====")))}).where((F.col("block") > 0) & ~F.startswith("line", F.lit("====")) & (F.trim("line") != ""))
    part = F.split(F.trim("line"), r"[\s:]+")
    rows = rows.select("file", "block", "line_no", part[0].alias("path"), F.get(part, 1).try_cast("int").alias("at")).where("at is not null")
    first = cut(rows.groupBy("file", "block").agg(F.min("line_no").alias("head"), F.min_by(F.struct("path", "at"), "line_no").alias("criterion")))
    rows = rows.join(first, ["file", "block"])  # of a checkpointed side: a block with many rows is split
    return rows.where((F.col("line_no") > F.col("head")) & ~F.startswith("path", F.lit("/"))).select(F.col("file").alias("report"), F.col("criterion.path").alias("crit_file"), F.col("criterion.at").alias("crit_line"), "path", F.col("at").alias("line")).distinct()


def parse_coverage(lines: DataFrame) -> DataFrame:
    """(file, statement, branch): ``Lines executed:`` and ``Branches executed:`` percentages, the largest of a file."""
    line = F.col("line")
    value = F.regexp_extract(line, r":\s*([0-9.]+)%", 1).try_cast("double")
    return lines.groupBy("file").agg(F.max(F.when(line.startswith("Lines executed"), value)).alias("statement"), F.max(F.when(line.startswith("Branches executed"), value)).alias("branch")).where("statement is not null or branch is not null")


def parse_buildrate_log(lines: DataFrame) -> DataFrame:
    """(file, project, exit_status, success, error, rate): ``./name`` opens a project; success = 0, timeout = -1; no rate = 0."""
    line = F.col("line")
    rows = scanned(lines, sums={"block": _one(line.startswith("./"))}).where("block > 0")
    counts = r"^SUCCESS:\s*(\d+)\s+ERROR:\s*(\d+)\s+RATE:\s*([0-9.]*)"
    found = lambda i, kind: F.max(F.when(line.rlike(counts), F.regexp_extract(line, counts, i).try_cast(kind)))
    return rows.groupBy("file", "block").agg(
        F.max(F.when(line.startswith("./"), F.trim("line"))).alias("project"),
        F.max(F.when(line.startswith("success"), 0).when(line.startswith("timeout"), -1)).alias("exit_status"),
        found(1, "int").alias("success"),
        found(2, "int").alias("error"),
        F.coalesce(found(3, "double"), F.lit(0.0)).alias("rate"),
    ).drop("block")
