"""Readers and writers: everything goes through Spark's own formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcfacts.functions import text as X

LOCATION = "struct<line:int,col:int>"
SNIPPET = f"id long, name string, kind string, file string, begin {LOCATION}, end {LOCATION}, fields array<string>, deps array<long>, outers array<long>, code string"
KINDS = ("Macro", "Function", "FunctionDecl", "Var", "Typedef", "Record", "RecordDecl", "Enum")


def _whole(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, text) of whole files; Spark gives no row for a file without a byte."""
    found = spark.read.format("binaryFile").options(**options).load(path)
    return found.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"))


def read_source_files(spark: SparkSession, path: str, glob: str = "*.[ch]") -> DataFrame:
    """(file, text): every matching file below a folder, one row each."""
    return _whole(spark, path, recursiveFileLookup=True, pathGlobFilter=glob)


def read_snippets(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """snippets, keys (id, key), deps and outers (src, dst) from snippet JSON; unknown kinds are left out.

    multi_line: a file is one array or object; else one object a line, as the writers here leave it.
    """
    rows = spark.read.schema(SNIPPET).option("multiLine", multi_line).json(path).where(F.col("kind").isin(*KINDS))
    own = rows.select("id", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("fields", F.expr("cast(array() as array<string>)"))))).alias("key")).where("key is not null")
    edges = lambda c: rows.select(F.col("id").alias("src"), F.explode(c).alias("dst")).distinct()
    return {"snippets": rows.drop("deps", "outers"), "keys": own, "deps": edges("deps"), "outers": edges("outers")}


def write_snippets(snippets: DataFrame, deps: DataFrame, outers: DataFrame, path: str) -> None:
    """Snippet JSON, one object a line, with sorted deps and outers; missing ones are empty."""
    sets = lambda df, n: df.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias(n))
    none = F.expr("cast(array() as array<bigint>)")
    rows = snippets.join(sets(deps, "deps"), "id", "left").join(sets(outers, "outers"), "id", "left")
    rows.withColumn("deps", F.coalesce("deps", none)).withColumn("outers", F.coalesce("outers", none)).write.mode("overwrite").json(path)


def read_includes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(file, target, is_system) from objects {file, local, system}."""
    rows = spark.read.schema("file string, local array<string>, system array<string>").option("multiLine", multi_line).json(path)
    part = lambda c, flag: rows.select("file", F.explode(c).alias("target"), F.lit(flag).alias("is_system"))
    return part("local", False).union(part("system", True))


def write_includes(includes: DataFrame, path: str) -> None:
    target = lambda flag: F.array_sort(F.collect_set(F.when(F.col("is_system") == flag, F.col("target"))))
    includes.groupBy("file").agg(target(False).alias("local"), target(True).alias("system")).write.mode("overwrite").json(path)


def read_libraries(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(package, size, includes, libs, flags): ``flags`` gets ``-lNAME`` for each libs entry ``.../libNAME.so``; absent lists are empty."""
    rows = spark.read.schema("package string, size string, includes array<string>, libs array<string>, flags array<string>").option("multiLine", multi_line).json(path)
    full = lambda c: F.coalesce(c, F.expr("cast(array() as array<string>)"))
    named = F.filter(F.transform(full(F.col("libs")), lambda x: F.regexp_extract(x, r"/lib([^/]+)\.so[0-9.]*$", 1)), lambda x: x != "")
    links = F.transform(named, lambda x: F.concat(F.lit("-l"), x))
    return rows.select("package", "size", full(F.col("includes")).alias("includes"), full(F.col("libs")).alias("libs"), F.array_union(full(F.col("flags")), links).alias("flags"))


def _cells_table(lines: DataFrame, cells: Column, spark: SparkSession) -> DataFrame:
    """Rows of cells under the cells of the first line of the first file; rows of another width, and the same head line in other
    files, are dropped."""
    rows = lines.select("file", "line_no", cells.alias("cells"))
    first = rows.orderBy("file", "line_no").first()
    if first is None:
        return spark.createDataFrame([], "empty string")
    header = first["cells"]
    body = rows.where((F.size("cells") == len(header)) & (F.col("cells") != F.array(*map(F.lit, header))))
    return body.select(*[F.col("cells")[i].alias(name or f"_{i}") for i, name in enumerate(header)])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, in the order of each file."""
    whole = _whole(spark, path).select("file", F.posexplode(F.split("text", "\r?\n", -1)).alias("line_no", "line"))
    return whole.withColumn("line_no", F.col("line_no") + 1)


def read_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """All-string table of a CSV file with a header: cells trimmed, comments (#), blank lines and rows of another width dropped."""
    lines = numbered_lines(spark, path).where((F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("#")))
    return _cells_table(lines, F.transform(F.split("line", ",", -1), lambda c: X.trimmed(c)), spark)


def read_org_table(spark: SparkSession, path: str) -> DataFrame:
    """All-string table of ``| a | b |`` lines; comments, blank lines and rules are skipped."""
    line = F.trim("line")
    lines = numbered_lines(spark, path).where((line != "") & ~F.startswith(line, F.lit("#")) & ~line.rlike(r"^\|[-+|]+$"))
    inner = F.regexp_replace(line, r"^\||\|$", "")
    return _cells_table(lines, F.transform(F.split(inner, r"\|", -1), lambda c: X.trimmed(c)), spark)


#: One-letter kinds of a tags file.
TAG_KINDS = {"c": "class", "d": "macro", "e": "enumerator", "f": "function", "g": "enum", "l": "local", "m": "member", "n": "namespace", "p": "prototype", "s": "struct", "t": "typedef", "u": "union", "v": "variable", "x": "extern"}


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(name, file, line, kind); unknown letters are ``other``."""
    rows = numbered_lines(spark, path).where(~F.startswith("line", F.lit("!")) & F.contains("line", F.lit("\t")))
    part = F.split("line", "\t", -1)
    number = F.coalesce(F.regexp_extract("line", r"\tline:(\d+)", 1).try_cast("int"), F.regexp_extract(part[2], r"^(\d+)", 1).try_cast("int"))
    letter = F.regexp_extract("line", r';"\t(?:kind:)?([A-Za-z])\b', 1)
    kind = F.lit("other")
    for k, name in TAG_KINDS.items():
        kind = F.when(letter == k, name).otherwise(kind)
    return rows.select(part[0].alias("name"), part[1].alias("path"), number.alias("line"), kind.alias("kind"))


def read_selection(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(sel_id, file, line, col or null) from [{file, sel: [{line, col?}]}]; sel_id is the file's name."""
    rows = spark.read.schema("file string, sel array<struct<line:int,col:int>>").option("multiLine", multi_line).json(path)
    return rows.select(X.last_component(F.col("_metadata.file_path")).alias("sel_id"), "file", F.explode("sel").alias("s")).select("sel_id", "file", "s.line", "s.col")


def write_selection(selection: DataFrame, path: str) -> None:
    """One folder a selection, a JSON object for each of its files."""
    rows = selection.groupBy("sel_id", "file").agg(F.array_sort(F.collect_list(F.struct("line", "col"))).alias("sel"))
    rows.write.mode("overwrite").partitionBy("sel_id").json(path)


def read_poi(spark: SparkSession, path: str, benchmark: str) -> DataFrame:
    """(benchmark, file, linum, type, failure_condition) of one benchmark, from an org or CSV table; missing required columns raise."""
    found = read_org_table(spark, path) if path.endswith(".org") else read_csv_table(spark, path)
    names = {c.replace("-", "_"): c for c in found.columns}
    if lost := {"benchmark", "file", "linum", "type"} - names.keys():
        raise ValueError(f"columns missing: {sorted(lost)}")
    condition = F.coalesce(F.col(f"`{names['failure_condition']}`"), F.lit("")) if "failure_condition" in names else F.lit("")
    rows = found.where(F.col(f"`{names['benchmark']}`") == benchmark)
    return rows.select(*[F.col(f"`{names[c]}`").alias(c) for c in ("benchmark", "file")], F.col(names["linum"]).try_cast("int").alias("linum"), F.col(names["type"]).alias("type"), condition.alias("failure_condition"))


def read_error_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file, error, kind, frame, source, line): the frames of a memory checker's reported errors."""
    schema = "unique string, kind string, stack array<struct<frame:array<struct<fn:string,file:string,line:int>>>>"
    rows = spark.read.format("xml").option("rowTag", "error").schema(schema).load(path).select("unique", "kind", F.posexplode(F.flatten(F.transform("stack", lambda s: s["frame"]))).alias("frame", "f"))
    return rows.select(F.col("unique").alias("error"), "kind", "frame", F.col("f.fn").alias("function"), F.col("f.file").alias("source"), F.col("f.line").alias("line"))


def errors_at_line(frames: DataFrame, line: int, kinds: tuple[str, ...] = ("InvalidRead", "InvalidWrite")) -> DataFrame:
    """Errors of the kinds with a frame at the line."""
    return frames.where(F.col("kind").isin(*kinds) & (F.col("line") == line)).select("error", "kind").distinct()


def read_repos(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema("name string, full_name string, stars long, language string, size long, languages map<string,long>").option("multiLine", multi_line).json(path)


def save_facts(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_facts(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def write_trace_csv(wide: DataFrame, path: str) -> None:
    """Wide trace with a header: inputs, outputs, both by name, then the codes; missing is NA."""
    order = [c for c in ("seg", "test") if c in wide.columns] + sorted(c for c in wide.columns if c.startswith("input_")) + sorted(c for c in wide.columns if c.startswith("output_"))
    wide.select(*order, *[c for c in ("reach_code", "status_code") if c in wide.columns]).write.mode("overwrite").option("header", True).option("nullValue", "NA").option("emptyValue", "").csv(path)


def graph_to_text(nodes: DataFrame, edges: DataFrame, fmt: str = "dot") -> DataFrame:
    """(value): lines of a graph, in order: dot, grs, or xml (node kind by label; an edge labelled ``back`` is backward).

    nodes: (id, label); edges: (src, dst, label). The text has a head and a foot, so it is one ordered file: write it
    with one partition.
    """
    quoted = lambda c: F.regexp_replace(F.col(c), r'(["\\])', r"\\$1")
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    if fmt == "dot":
        head, foot = ["digraph {"], ["}"]
        node = F.concat(F.lit('  "'), "id", F.lit('" [label="'), quoted("label"), F.lit('"];'))
        edge = F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), quoted("label"), F.lit('"];'))
    elif fmt == "grs":
        head, foot = ["new graph"], ["show graph"]
        node = F.concat(F.lit("new :Node($=\""), "id", F.lit('", label="'), quoted("label"), F.lit('")'))
        edge = F.concat(F.lit("new @(\""), "src", F.lit('")-:Edge(label="'), quoted("label"), F.lit('")->@("'), "dst", F.lit('")'))
    elif fmt == "xml":
        head, foot = ["<graph>"], ["</graph>"]
        node = F.concat(F.lit('  <node id="'), "id", F.lit('" type="'), safe("label"), F.lit('"/>'))
        edge = F.concat(F.lit('  <edge from="'), "src", F.lit('" to="'), "dst", F.lit('" type="'), F.when(F.col("label") == "back", "backward").otherwise("forward"), F.lit('" label="'), safe("label"), F.lit('"/>'))
    else:
        raise ValueError(fmt)
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, 0, line) for line in head] + [(3, 0, line) for line in foot], "part int, at int, value string").select("part", F.col("at").cast("string").alias("at"), "value")
    rows = nodes.select(F.lit(1).alias("part"), F.col("id").cast("string").alias("at"), node.alias("value")).union(edges.select(F.lit(2), F.concat_ws(" ", "src", "dst"), edge))
    return ends.union(rows).orderBy("part", "at").select("value")


def benchmark_of(path: Column, common: Column | str) -> Column:
    """First part of a path behind the common prefix."""
    return F.split(X.relative_path(path, common), "/")[0]


def write_partitioned(fragments: DataFrame, path: str, common: str) -> None:
    """Fragments (id, path, begin, end) by benchmark and id, a folder each. All tasks write, each fragment's rows to one file, and each task puts its
    own files in place, as the driver would go through all folders one by one."""
    named = fragments.withColumn("bench", benchmark_of(F.col("path"), common)).withColumn("frag", F.col("id"))
    many = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named.repartition(many, "bench", "frag").write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("bench", "frag").json(path)
