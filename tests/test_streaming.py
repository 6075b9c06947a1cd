import json
import time

from srcfacts.operators import logs
from srcfacts.streaming import live

TEXT = ["INPUT_SPEC", "a = 1", "INPUT_SPEC_END", "POI_INSTRUMENT", "b = 2", "TEST_SUCCESS", "c = 3", "TEST_FAILURE", "d = 4"]


def _run(query, name):
    q = query.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_counts_and_records(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"file": f, "line_no": i + 1, "line": x} for f in ("p", "q") for i, x in enumerate(TEXT)]
    (folder / "b.json").write_text("\n".join(json.dumps(r) for r in rows[9:] + rows[4:9]))  # later lines come first
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in rows[:4]))
    lines = live.read_lines(spark, str(folder), maxFilesPerTrigger=1)
    _run(live.live_counts(lines, patterns={"success": "TEST_SUCCESS", "values": "="}).writeStream.outputMode("complete"), "counts")
    assert sorted(map(tuple, spark.table("counts").collect())) == [("p", 1, 4), ("q", 1, 4)]
    _run(live.live_records(lines).writeStream.outputMode("append"), "records")
    batch = logs.trace_records(spark.read.schema(live.LINES).json(str(folder)))
    assert sorted(map(tuple, spark.table("records").collect())) == sorted(map(tuple, batch.select(*spark.table("records").columns).collect()))


def test_restart_and_late_lines(spark, tmp_path):
    """What waits behind a late line is kept over a restart; each record comes once."""
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    text = ["INPUT_SPEC", "late = 0", *[f"k{i} = {i}" for i in range(500)], "TEST_SUCCESS", "a = 9", "TEST_FAILURE"]

    def more(name, numbers):
        (folder / name).write_text("\n".join(json.dumps({"file": "p", "line_no": n, "line": text[n - 1]}) for n in numbers))
        query = live.live_records(live.read_lines(spark, str(folder))).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.read.schema(live.RECORD).parquet(f"{out}/rows").collect()

    assert more("a.json", [1, *range(3, len(text) + 1)]) == []
    rows = more("b.json", [1, 2, 3])
    assert len(rows) == 501 + 1 and {r.status_code for r in rows if r.test == 1} == {0} and [(r.key, r.value) for r in rows if r.test == 2] == [("a", "9")]
    assert len(more("c.json", [2, 5])) == 502


def test_files_that_stop(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, rows: (folder / name).write_text("\n".join(json.dumps({"file": f, "line_no": n, "line": x}) for f, n, x in rows))
    put("a.json", [("p", 1, "a = 1"), ("p", 4, "lost = 1")])
    query = live.live_records(live.read_lines(spark, str(folder)), idle_ms=1000).writeStream.format("memory").queryName("stopped").outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not any(p["numInputRows"] for p in query.recentProgress):
            time.sleep(0.3)
        time.sleep(5)  # its timer goes off
        put("b.json", [("p", 2, "b = 2"), ("p", 5, "c = 3"), ("p", 6, "TEST_SUCCESS")])
        while time.time() < deadline and not spark.table("stopped").count():
            time.sleep(0.3)
        assert [(r.test, r.key, r.value) for r in spark.table("stopped").collect()] == [(2, "c", "3")]
    finally:
        query.stop()
