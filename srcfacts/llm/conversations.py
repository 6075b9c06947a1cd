"""Repair of conversations: the cheapest edits that give the roles ``(s?(ua)+)?``, found once for each different ending.

A conversation is a word of symbols, one a row: the role's initial and the row's fault. Words with the same ending share the nodes of
that ending in one automaton: a node is a different suffix, made from its last symbol on, and holds for each state of the role
grammar the cost to go and the edits to begin with. Different words are dealt by ranges of their reversed text, so that a
task meets words with equal endings one after another and computes every node of its range once; it keeps the nodes of one word.

An edit string is the audit: (D)elete, (I)nsert, (K)eep, (R)erole, in order. Of equally cheap ones the least in ASCII order is
taken; as the first edits of two ways out of a node never begin one another, that is decided at the node.

Nulls: a null role or text counts as one space, which makes such a row blank or its role no role; null turns come first and
make no gap; rows without a conversation id are one conversation. Rows of one turn are ordered by role and text. Empty texts are blank faults. A conversation without rows left has
zeros, an empty audit and the hash of the empty text. Repeated rows are duplicates. Texts may have any length and conversations any number of rows: only their symbols,
a byte a row, meet in a task's memory. An empty table gives no rows. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from srcfacts.llm.base import bound_batches
from srcfacts.llm.manifest import crc32_sql
from srcfacts.session import cut

BLANK = r"[^\x20\x09-\x0D]"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 2, 1, 5, 5

#: States of the grammar: nothing yet, after s, after u, after a; what each takes, and where it leads.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: What an inserted or changed row is in each state; the role decides where it leads.
WANTED = ("user", "user", "assistant", "user")
#: Inserts in a row at most: a third one only comes back to where the first one led.
MOST_INSERTS = 2
GONE = "x"


def symbol(role: Column, fault: Column) -> Column:
    """One character a row: x where only deletion is left, else the role's initial (o: another), as a capital where truncated."""
    first = F.substring(role, 1, 1)
    plain = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), GONE).when(fault == "truncated", F.upper(plain)).otherwise(plain)


def _to(state: int) -> int:
    return STEPS[state][WANTED[state][0]]


def _inserted(state: int) -> list[tuple[int, str, int]]:
    """(cost, edits, state) after no, one or two inserts."""
    out = [(0, "", state)]
    for _ in range(MOST_INSERTS):
        cost, edits, at = out[-1]
        out.append((cost + INSERT_COST, edits + "I", _to(at)))
    return out


#: Behind the last row: what it takes to end, for each state.
LAST = tuple(min((c, e, s) for c, e, s in _inserted(q) if s in ENDS) for q in range(4))


def _options(char: str) -> tuple[tuple[tuple[int, str, int], ...], ...]:
    """For each state the ways (cost, edits, next state) past one row."""
    role, extra = char.lower(), TRUNCATED_COST if char.isupper() else 0
    out = []
    for state in range(4):
        ways = []
        for cost, edits, at in _inserted(state):
            ways.append((cost + DELETE_COST, edits + "D", at))
            if char != GONE:
                ways.append((cost + REROLE_COST + extra, edits + "R", _to(at)))
                if role in STEPS[at]:
                    ways.append((cost + extra, edits + "K", STEPS[at][role]))
        out.append(tuple(ways))
    return tuple(out)


OPTIONS = {c: _options(c) for c in "suaoSUAOx"}
Node = tuple[tuple[int, str, int], ...]


def node(char: str, after: Node) -> Node:
    """(cost to go, first edits, next state) in each state, from the node of what comes after."""
    return tuple(min((cost + after[to][0], edits, to) for cost, edits, to in ways) for ways in OPTIONS[char])


def plans(words: Iterable[str]) -> Iterator[tuple[str, int, str]]:
    """(word, cost, audit) of words ordered by their reversed text: nodes of a common ending are computed once."""
    path: list[Node] = [LAST]  # path[i]: the node of the last i symbols
    before = ""
    for word in words:
        turned, shared = word[::-1], 0
        most = min(len(turned), len(before))
        while shared < most and turned[shared] == before[shared]:
            shared += 1
        del path[shared + 1 :]
        for char in turned[shared:]:
            path.append(node(char, path[-1]))
        state, audit = 0, []
        for i in range(len(word), -1, -1):
            _, edits, state = path[i][state]
            audit.append(edits)
        before = turned
        yield word, path[-1][0][0], "".join(audit)


def audits(words: DataFrame) -> DataFrame:
    """(word, cost, audit) of each different word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = plans(w for b in batches for w in b.column(0).to_pylist())
        while rows := list(islice(found, 1024)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["word", "cost", "audit"])

    own = words.select("word").where("word is not null").distinct().withColumn("turned", F.reverse("word"))
    return own.repartitionByRange("turned").sortWithinPartitions("turned").select("word").mapInArrow(run, "word string, cost long, audit string")


def _said(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def as_given(rows: DataFrame) -> DataFrame:
    """Rows without any damage, with the columns of ``damaged``."""
    return rows.select("conv_id", "turn", _said("role").alias("role"), _said("text").alias("text"), F.lit(True).alias("alive"), _said("role").alias("r0"), _said("text").alias("t0"), F.lit(0).alias("copy"))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive, r0, t0, copy): each row as the digest of its conversation and turn says: dropped (alive is false), emptied, without its
    ends of sentences, twice, or with the role user; r0 and t0 are what role and text were."""
    code = F.crc32(F.concat(_said("conv_id"), F.lit(":"), _said("turn")).cast("binary")) % 20
    base = rows.select("conv_id", "turn", _said("role").alias("r0"), _said("text").alias("t0"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("t0", "[.!?]", "")).otherwise(F.col("t0"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("r0")).alias("role"), text.alias("text"), (F.col("code") != 0).alias("alive"), "r0", "t0", F.explode(copies).alias("copy"))


def diagnosed(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, pos from 1, role, text, alive, fault, sym, illegal, new_turn): each living row's first fault, its symbol, whether its role can't follow
    the one before, and whether its turn is another than that before. rows: as ``damaged`` gives them."""
    place = Window.partitionBy("conv_id", "alive").orderBy("turn", "r0", "t0", "copy")
    same = Window.partitionBy("conv_id", "alive", "role", "text").orderBy("pos")
    initial = F.substring("role", 1, 1)
    numbered = rows.withColumn("pos", F.row_number().over(place)).withColumn("prev", F.lag(initial).over(place)).withColumn("prev_turn", F.lag("turn").over(place))
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    fault = F.when(~F.col("text").rlike(BLANK), "blank").when(F.row_number().over(same) > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    out = numbered.withColumn("fault", fault)
    pair = F.concat("prev", initial)
    return out.select(
        "conv_id", "turn", "pos", "role", "text", "alive", "fault", symbol(F.col("role"), F.coalesce("fault", F.lit(""))).alias("sym"),
        (F.col("prev").isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("prev_turn"))).alias("new_turn"),
    )  # fmt: skip


def reports(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, word) of every conversation. rows: as ``diagnosed`` gives them."""
    alive = F.col("alive")
    count = lambda c: F.count_if(alive & c)  # noqa: E731
    turns = F.max(F.when(alive, F.col("turn"))) - F.min(F.when(alive, F.col("turn"))) + 1 - count(F.col("new_turn"))
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(alive, F.struct("pos", "sym")))), lambda x: x["sym"]), "")
    faults = [count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    return rows.groupBy("conv_id").agg(F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"), *faults, count(F.col("illegal")).alias("illegal"), word.alias("word"))


class Editor:
    """Goes along the rows of one conversation as its audit says: (edit, role, text) of what stays."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _put(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        self.state = STEPS[self.state][role[0]]
        return edit, role, text

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._put("I", WANTED[self.state], "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._put(edit, WANTED[self.state] if edit == "R" else role, text)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, n from 1, edit, role, text): the rows of every repaired conversation, those of one after another in their order.
    rows: as ``diagnosed`` gives them; found: (conv_id, audit).

    A conversation's rows pass through its task one by one; no text is kept.
    """
    bound_batches(rows)
    own = rows.where("alive").select("conv_id", "pos", "role", "text")
    met = own.alias("l").join(found.select("conv_id", "audit").alias("r"), F.col("l.conv_id").eqNullSafe(F.col("r.conv_id"))).select("l.conv_id", "pos", "role", "text", F.when(F.col("pos") == 1, F.col("audit")).alias("audit"))
    ordered = met.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    kind = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, n = Editor(""), None, 0
        done: list[tuple] = []

        def put(made: Iterable[tuple[str, str, str]]) -> None:
            nonlocal n
            for x in made:
                n += 1
                done.append((key, n, *x))

        def batch() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*done, strict=True), (kind, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "n", "edit", "role", "text"])

        for b in batches:
            for conv, pos, role, text, audit in zip(*(b.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text", "audit")), strict=True):
                if pos == 1:
                    put(now.inserts())
                    now, key, n = Editor(audit), conv, 0
                put(now.row(role, text))
            if done:
                yield batch()
        put(now.inserts())
        if done:
            yield batch()

    return ordered.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, n long, edit string, role string, text string")


def digests(texts: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): digest of the lines ``role:text`` of every conversation, rows as ``repaired`` gives them."""
    kind = to_arrow_type(texts.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([now.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

        for b in batches:
            for conv, n, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "n", "role", "text")), strict=True):
                if n == 1:
                    if now is not None:
                        yield made()
                    key, now = conv, hashlib.sha256()
                now.update(f"{'' if n == 1 else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        if now is not None:
            yield made()

    return texts.mapInArrow(run, f"conv_id {texts.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation, repaired rows (conv_id, n, edit, role, text)).

    rows: (conv_id, turn, role, text), or as ``damaged`` gives them.
    """
    told = diagnosed(rows if "alive" in rows.columns else as_given(rows))
    seen = cut(reports(told))
    planned = cut(seen.join(audits(seen), "word").drop("word"))
    return planned, repaired(told, planned)


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    planned, texts = repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    both = planned.alias("l").join(digests(texts).alias("r"), F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    return both.select("l.*", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _best_sql(state: int) -> str:
    """The cheapest way (c, a, t) past row s from a state, the states after it being n.b0 to n.b3; t: the lines written."""
    ways = []
    for cost, edits, at in _inserted(state):
        lines, q = "", state
        for _ in edits:
            lines, q = lines + rf"\n{WANTED[q]}:", _to(q)
        lines = "E'" + lines + "'"
        way = lambda c, e, to, more: f"{{'c': {c} + n.b{to}.c, 'a': '{edits}{e}' || n.b{to}.a, 't': {lines} || {more} || n.b{to}.t}}"  # noqa: E731, B023
        ways.append(way(cost + DELETE_COST, "D", at, "''"))
        keeps = f"CASE s.fault WHEN 'truncated' THEN {TRUNCATED_COST} WHEN 'blank' THEN 1000000 WHEN 'duplicate' THEN 1000000 ELSE 0 END + {cost}"
        ways.append(way(f"{keeps} + {REROLE_COST}", "R", _to(at), f"chr(10) || '{WANTED[at]}:' || s.text"))
        ways += [way(f"CASE left(s.role, 1) WHEN '{c}' THEN 0 ELSE 1000000 END + {keeps}", "K", to, "chr(10) || s.role || ':' || s.text") for c, to in STEPS[at].items()]
    return f"list_min([{', '.join(ways)}]) AS b{state}"


def _sql() -> str:
    def last(state: int) -> str:
        cost, edits, _ = LAST[state]
        lines, q = "", state
        for _ in edits:
            lines, q = lines + rf"\n{WANTED[q]}:", _to(q)
        return f"{{'c': {cost}, 'a': '{edits}', 't': E'{lines}'}} AS b{state}"

    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return rf"""WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0, {crc32_sql(key)} % 20 AS code FROM conversations),
d AS (SELECT conv_id, turn, r0, t0, copy, CASE code WHEN 4 THEN 'user' ELSE r0 END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t0, '[.!?]', '', 'g') ELSE t0 END AS text
 FROM base, (VALUES (0), (1)) AS c(copy) WHERE code <> 0 AND (copy = 0 OR code = 3)),
p AS (SELECT *, row_number() OVER w AS pos, lag(left(role, 1)) OVER w AS prev FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0, t0, copy)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
 WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' END AS fault FROM p),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
 count(*) FILTER (prev || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
walk AS (SELECT conv_id, n AS pos, {", ".join(last(q) for q in range(4))} FROM told
 UNION ALL SELECT n.conv_id, n.pos - 1, {", ".join(_best_sql(q) for q in range(4))} FROM walk AS n JOIN f AS s ON s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.pos = n.pos)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b0.c, 0) AS BIGINT) AS cost,
 coalesce(b0.a, '') AS audit, sha256(coalesce(substr(b0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN told AS t ON t.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN walk AS w ON w.conv_id IS NOT DISTINCT FROM a.conv_id AND w.pos = 0"""


OP13_SQL = _sql()
