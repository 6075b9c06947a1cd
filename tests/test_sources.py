import json

import pytest
from pyspark.sql import functions as F

from srcfacts.sources import files as S


def _write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_source_files_and_lines(spark, tmp_path):
    _write(tmp_path, "a/x.c", "int a;\nint b;")
    _write(tmp_path, "a/b/y.h", "\n")
    _write(tmp_path, "a/b/empty.h", "")
    _write(tmp_path, "a/z.txt", "no")
    got = {r.file.rsplit("/", 1)[1]: r.text for r in S.read_source_files(spark, str(tmp_path / "a")).collect()}
    assert got == {"x.c": "int a;\nint b;", "y.h": "\n"}


def test_snippets_round_trip(spark, tmp_path):
    rows = [{"id": 1, "name": "A1", "kind": "Record", "file": "a.h", "begin": {"line": 1, "col": 1}, "end": {"line": 2, "col": 1}, "code": "struct A1 {\n}"},
            {"id": 2, "name": "A2", "kind": "Enum", "fields": ["x", "y"], "file": "a.h", "begin": {"line": 3, "col": 1}, "end": {"line": 3, "col": 9}, "deps": [1, 1], "outers": [], "code": "enum A2"},
            {"id": 3, "name": "Z", "kind": "Alien"}]
    got = S.read_snippets(spark, _write(tmp_path, "s.json", json.dumps(rows)))
    assert {r.id for r in got["snippets"].collect()} == {1, 2}
    assert {(r.id, r.key) for r in got["keys"].collect()} == {(1, "A1"), (2, "A2"), (2, "x"), (2, "y")}
    assert [(r.src, r.dst) for r in got["deps"].collect()] == [(2, 1)] and got["outers"].count() == 0
    S.write_snippets(got["snippets"], got["deps"], got["outers"], str(tmp_path / "out"))
    again = S.read_snippets(spark, str(tmp_path / "out"), multi_line=False)
    assert sorted(map(tuple, again["keys"].collect())) == sorted(map(tuple, got["keys"].collect()))
    assert [(r.src, r.dst) for r in again["deps"].collect()] == [(2, 1)]


def test_includes_libraries_repos(spark, tmp_path):
    inc = spark.createDataFrame([("a.c", "b.h", False), ("a.c", "stdio.h", True)], "file string, target string, is_system boolean")
    S.write_includes(inc, str(tmp_path / "inc"))
    assert sorted(map(tuple, S.read_includes(spark, str(tmp_path / "inc"), multi_line=False).collect())) == sorted(map(tuple, inc.collect()))
    path = _write(tmp_path, "lib.json", json.dumps([{"package": "p", "libs": ["/usr/lib/libfoo.so", "/usr/lib/x.a"], "flags": ["-O"]}, {"package": "q"}]))
    got = {r.package: r for r in S.read_libraries(spark, path).collect()}
    assert got["p"].flags == ["-O", "-lfoo"] and got["q"].includes == [] and got["q"].flags == []
    repo = S.read_repos(spark, _write(tmp_path, "r.json", json.dumps({"name": "n", "stars": 3, "languages": {"C": 5}}))).first()
    assert repo.languages == {"C": 5} and repo.size is None


def test_tables(spark, tmp_path):
    csv = S.read_csv_table(spark, _write(tmp_path, "t.csv", "a, b ,c\n1, 2,3\n# note\n\n1,2\n1,2,3,4\n x ,,y\n"))
    assert csv.columns == ["a", "b", "c"] and sorted(map(tuple, csv.collect())) == [("1", "2", "3"), ("x", "", "y")]
    org = S.read_org_table(spark, _write(tmp_path, "t.org", "# c\n| a | b |\n|---+---|\n| 1 | 2 |\n|---+---|\n| 3 |  |\n"))
    assert sorted(map(tuple, org.collect())) == [("1", "2"), ("3", "")]
    poi = _write(tmp_path, "p.org", "| benchmark | file | linum | type |\n| x | a.c | 7 | stmt |\n| y | b.c | 9 | loop |\n")
    assert [tuple(r) for r in S.read_poi(spark, poi, "x").collect()] == [("x", "a.c", 7, "stmt", "")]
    with pytest.raises(ValueError):
        S.read_poi(spark, _write(tmp_path, "q.csv", "benchmark,file\nx,a\n"), "x")
    assert S.read_csv_table(spark, _write(tmp_path, "e.csv", "")).count() == 0


def test_tags_selection_xml(spark, tmp_path):
    tags = _write(tmp_path, "tags", '!_TAG\tx\ty\nmain\ta.c\t/^int main$/;"\tf\tline:12\nFOO\tb.h\t3;"\td\nq\tb.h\t4;"\tZ\n')
    assert [tuple(r) for r in S.read_tags(spark, tags).orderBy("name").collect()] == [("FOO", "b.h", 3, "macro"), ("main", "a.c", 12, "function"), ("q", "b.h", 4, "other")]
    sel = spark.createDataFrame([("s1", "a.c", 1, 2), ("s1", "a.c", 3, None), ("s2", "b.c", 4, None)], "sel_id string, file string, line int, col int")
    S.write_selection(sel, str(tmp_path / "sel"))
    back = spark.read.json(str(tmp_path / "sel"))
    assert sorted((r.sel_id, r.file, len(r.sel)) for r in back.collect()) == [("s1", "a.c", 2), ("s2", "b.c", 1)]
    one = S.read_selection(spark, _write(tmp_path, "q.json", json.dumps([{"file": "a.c", "sel": [{"line": 1}, {"line": 2, "col": 5}]}])))
    assert sorted((r.sel_id, r.line, r.col or 0) for r in one.collect()) == [("q.json", 1, 0), ("q.json", 2, 5)]
    frame = "<frame><fn>f</fn><file>a.c</file><line>%d</line></frame>"
    xml = "<out>" + "".join(f"<error><unique>{u}</unique><kind>{k}</kind><stack>{frame % a}{frame % b}</stack></error>" for u, k, a, b in (("0x1", "InvalidRead", 3, 9), ("0x2", "Leak", 9, 9), ("0x3", "InvalidWrite", 1, 2))) + "</out>"
    frames = S.read_error_xml(spark, _write(tmp_path, "e.xml", xml))
    assert frames.count() == 6 and [tuple(r) for r in S.errors_at_line(frames, 9).collect()] == [("0x1", "InvalidRead")]


def test_store_graph_and_trace(spark, tmp_path):
    S.save_facts({"x": spark.range(3)}, str(tmp_path / "f"))
    assert S.load_facts(spark, str(tmp_path / "f"), ["x"])["x"].count() == 3
    wide = spark.createDataFrame([(1, "5", None, 5, 1)], "test int, output_b string, input_a string, reach_code int, status_code int")
    S.write_trace_csv(wide.coalesce(1), str(tmp_path / "t"))
    assert next((tmp_path / "t").glob("*.csv")).read_text() == "test,input_a,output_b,reach_code,status_code\n1,NA,5,5,1\n"
    nodes = spark.createDataFrame([(1, 'a"b'), (2, "<c>")], "id long, label string")
    edges = spark.createDataFrame([(1, 2, "back")], "src long, dst long, label string")
    text = {f: [r.value for r in S.graph_to_text(nodes, edges, f).collect()] for f in ("dot", "grs", "xml")}
    assert text["dot"] == ["digraph {", '  "1" [label="a\\"b"];', '  "2" [label="<c>"];', '  "1" -> "2" [label="back"];', "}"]
    assert text["xml"][2] == '  <node id="2" type="&lt;c&gt;"/>' and 'type="backward"' in text["xml"][3] and len(text["grs"]) == 5
    frags = spark.createDataFrame([(1, "/r/b1/x.c", 1, 2), (2, "/r/b2/y.c", 3, 4)], "id long, path string, begin int, end int")
    S.write_partitioned(frags, str(tmp_path / "p"), "/r")
    assert {r.bench for r in spark.read.json(str(tmp_path / "p")).select("bench").collect()} == {"b1", "b2"}
    assert frags.select(S.benchmark_of(F.col("path"), "/r").alias("b")).first().b == "b1"


def test_partitioned_fragments_are_one_file_each(spark, tmp_path):
    """Rows of a fragment that lie in several partitions, and all fragments not in one task."""
    rows = [(i % 12, f"/r/b{i % 12 % 3}/x.c", 1, i) for i in range(96)]
    S.write_partitioned(spark.createDataFrame(rows, "id long, path string, begin int, end int").repartition(8, "end"), str(tmp_path / "p"), "/r")
    files = [f for f in (tmp_path / "p").rglob("part-*.json")]
    assert len(files) == 12 and len({f.parent for f in files}) == 12 and len({f.name.split("-")[1] for f in files}) > 1
    back = spark.read.json(str(tmp_path / "p"))
    assert sorted((r.frag, r.id, f"/r/{r.bench}/x.c", r.end) for r in back.collect()) == sorted((a, a, p, e) for a, p, _, e in rows)
