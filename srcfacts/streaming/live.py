"""Logs that still grow, as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from srcfacts.operators.logs import CLOSINGS, STAGES

LINES = "file string, line_no long, line string"
PATTERNS = {"success": "TEST_SUCCESS", "error": "error", "reached": "reach", "not_reached": "no"}


def read_lines(spark: SparkSession, path: str, schema: str = LINES, fmt: str = "json", **options) -> DataFrame:
    """A stream of (file, line_no, line) records; new files are picked up as they come."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def live_counts(lines: DataFrame, key: str = "file", patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """Counts of lines that hold each text, by benchmark; for output mode ``complete`` or ``update``."""
    return lines.groupBy(key).agg(*[F.sum(F.when(F.contains("line", F.lit(text)), 1).otherwise(0)).alias(name) for name, text in patterns.items()])


RECORD = "file string, test long, side string, key string, value string, reach_code int, status_code int"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Records(StatefulProcessor):
    """Keyed state of one file: a row for the open test, a map of its values, and a map of the lines that wait for a missing one.

    Maps are entries of the state store, on disk where they are many: what waits behind a late line is never one row. With
    ``idle_ms`` a file that has no new lines for so long gives up its open test and what waits; only the number of its next line stays, so that
    lines that came before are still known.
    """

    def __init__(self, stages=STAGES, closings=CLOSINGS, idle_ms: int | None = None):
        self.stages, self.closings, self.idle_ms = stages, closings, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "test long, reach int, side string, following long")
        self.held = handle.getMapState("held", "side string, key string", "value string")
        self.waiting = handle.getMapState("waiting", "line_no long", "line string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        test, reach, side, following = self.head.get() if self.head.exists() else (1, 1, "input", 1)
        for b in rows:
            out = []
            for n, line in sorted(zip(b.line_no.tolist(), b.line.tolist(), strict=True), key=lambda x: x[0]):
                if n > following:
                    self.waiting.updateValue((n,), (line,))
                    continue
                while n == following:
                    line, following = line or "", following + 1
                    stage = next((s for s in self.stages if s[0] in line), None)
                    closing = next((c for c in self.closings if c[0] in line), None)
                    if stage:
                        reach, side = stage[2], stage[1] or side
                    elif closing:
                        values = [(k[0], k[1], v[0]) for k, v in self.held.iterator()] or [(None, None, None)]
                        out += [(key[0], test, *x, reach, closing[1]) for x in values]
                        self.held.clear()
                        test, reach, side = test + 1, 1, "input"
                    elif "=" in line:
                        name, value = line.split("=")[:2]
                        self.held.updateValue((side, name.strip(" ")), (value.strip(" "),))
                    if self.waiting.containsKey((following,)):
                        n, line = following, self.waiting.getValue((following,))[0]
                        self.waiting.removeKey((n,))
            yield pd.DataFrame(out, columns=COLUMNS)
        self.head.update((test, reach, side, following))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = max((k[0] for k in self.waiting.keys()), default=0)
        test, _, _, following = self.head.get()
        self.head.update((test + 1, 1, "input", max(following, last + 1)))
        self.held.clear()
        self.waiting.clear()
        yield pd.DataFrame([], columns=COLUMNS)

    def close(self) -> None:
        pass


def live_records(lines: DataFrame, stages=STAGES, closings=CLOSINGS, idle_ms: int | None = None) -> DataFrame:
    """Test records as their closing line arrives; the batch form is ``logs.trace_records``.

    State per file, see ``Records``; it needs the RocksDB store, which the session is set to. Line numbers start
    at 1 and have no gaps; a line that came before is ignored.
    """
    lines.sparkSession.conf.set(PROVIDER, ROCKS)
    return lines.groupBy("file").transformWithStateInPandas(Records(stages, closings, idle_ms), RECORD, "append", "None" if idle_ms is None else "ProcessingTime")
