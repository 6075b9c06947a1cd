"""Passages that an earlier document has too: fixed-block anchors, extended to maximal exact repeats.

A repeat is a run of ``WINDOW`` words or more. Wherever it stands, it holds one of the ``BLOCK``-word blocks that begin at multiples of
``BLOCK`` in a document, so the blocks are the index and every rolling window of ``BLOCK`` words a probe. A probe and a block that
meet are extended on both sides to the windows of ``WINDOW`` words around them, these are compared exactly, and windows that an
earlier document has too run together to maximal repeats.

Nothing is compared in pairs. Documents are dealt into chunks of some megabytes; a chunk asks about each different hash once,
so that a passage of any number of documents costs a question a chunk, and is answered with one bit, in the order of its questions:

1. hashes of blocks and rolling windows, 38 bits in a bucket, meet by bucket: is it a block somewhere, and in two documents?
2. windows around the hits, by a 128-bit hash of their words and the smallest id in the chunk: is there a smaller one elsewhere?

Hashes of the first round only choose candidates (a false hit costs work, none is missed); two windows count as equal where their XXH3
hashes of 128 bits are. Chunks are made anew for each round from the same shuffled documents; no text is sent twice.

Nulls: a null text has no words; a document without an id takes nothing from others and nothing is taken from it. Rows of one
id don't take from one another. Texts of any length are used whole, words of any length too. An empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcfacts.llm.base import bound_batches

WINDOW = 13
#: The longest block of which every window holds a whole one, wherever it begins.
BLOCK = (WINDOW + 1) // 2
#: Bytes of text in a chunk, which a task has in memory, and bytes of text whose hashes meet in one bucket.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 24 << 20
#: Bits of a hash that are compared in a bucket; with two marks they are five bytes.
BITS = 38
#: Words are hashed from running sums over so many bytes at once; longer words by themselves.
SPAN = 1 << 18

_SEPARATES = np.zeros(256, bool)
_SEPARATES[[32, *range(9, 14)]] = True
_STEP = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    if not _powers:
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            table = np.full(SPAN + 1, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the number."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of the texts of a chunk: their bytes with one space behind each word, and for each word its start there, its
    length, its document and its place in it."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        raw = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        gap = _SEPARATES[raw]
        first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        last = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
        doc = np.searchsorted(ends, first, side="right")
        kept = ~gap
        kept[last] = True
        data, size = raw[kept], last - first
        start = np.cumsum(size + 1) - (size + 1)
        data[start + size] = 32
        count = np.bincount(doc, minlength=len(texts))
        return cls(data, start, size, doc, np.arange(len(first)) - (np.cumsum(count) - count)[doc], count)

    def hashes(self) -> np.ndarray:
        """One number a word, equal for equal words."""
        up, down = powers()
        out = np.zeros(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.start, self.start[at] + SPAN, side="right")) - 1)
            low, high = int(self.start[at]), int(self.start[to - 1] + self.size[to - 1])
            if high - low > SPAN:  # one long word, or a long one behind short ones
                to = to if to == at + 1 else to - 1
                high = int(self.start[to - 1] + self.size[to - 1])
            if high - low > SPAN:
                out[at] = xxhash.xxh3_64_intdigest(self.data[low:high].tobytes())
            else:
                run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], dtype=np.uint64)])
                a = self.start[at:to] - low
                out[at:to] = (run[a + self.size[at:to]] - run[a]) * down[a]
            at = to
        return mixed(out + self.size.astype(np.uint64) * np.uint64(_STEP))

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """(place among the chunk's words, hash) of every window of BLOCK words inside a document."""
        h, n = self.hashes(), len(self.start) - BLOCK + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out, step = np.zeros(n, np.uint64), 1
        for k in range(BLOCK):
            out += h[k : k + n] * np.uint64(step)
            step = step * 0xD1342543DE82EF95 % (1 << 64)
        own = np.flatnonzero(self.place[:n] + BLOCK <= self.count[self.doc[:n]])
        return own, mixed(out[own])

    def digests(self, at: np.ndarray) -> np.ndarray:
        """XXH3 of 128 bits of the windows of WINDOW words, as two numbers each."""
        if not len(at):
            return np.zeros((0, 2), np.uint64)
        text = self.data.tobytes()
        low, high = self.start[at].tolist(), (self.start[at + WINDOW - 1] + self.size[at + WINDOW - 1]).tolist()
        return np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(low, high, strict=True)]), np.dtype(">u8")).astype(np.uint64).reshape(-1, 2)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """From the upper half of a hash, ascending with it."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def runs_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    changed = np.zeros(len(sorted_keys[0]), bool)
    changed[:1] = True
    for k in sorted_keys:
        changed[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(changed)


@dataclass
class Asked:
    """The different keys of a chunk, ascending: which bucket each belongs to, and of each occurrence which key it has."""

    bucket: np.ndarray
    of: np.ndarray

    def requests(self, chunk: int, cells: np.ndarray) -> pa.Table:
        """A row a bucket with the bytes of its keys."""
        begins = runs_of(self.bucket)
        ends = np.append(begins[1:], len(self.bucket))
        return pa.table({"bucket": pa.array(self.bucket[begins], pa.int64()), "chunk": pa.array([chunk] * len(begins), pa.int64()), "cells": pa.array([cells[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())})

    def answers(self, replies: dict[int, bytes]) -> np.ndarray:
        """Of each key whether its bucket said yes."""
        out = np.zeros(len(self.bucket), bool)
        begins = runs_of(self.bucket)
        for a, b in zip(begins, np.append(begins[1:], len(self.bucket)), strict=True):
            if (bits := replies.get(int(self.bucket[a]))) is not None:
                out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        return out


class Chunk:
    """Some documents, and what is known of them."""

    def __init__(self, rows: pa.Table, buckets: int):
        self.rows, self.buckets = rows, buckets
        ids = rows.column("id")
        self.known = ids.is_valid().to_numpy(zero_copy_only=False).astype(bool)
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        self.words = Words.of([t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()])
        self.at, h = self.words.blocks()
        mine = self.known[self.words.doc[self.at]]
        self.at, h = self.at[mine], h[mine]
        order = np.argsort(h)
        begins = runs_of(h[order])
        of = np.zeros(len(h), np.int64)
        of[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(h))))
        self.keys = h[order][begins]
        self.blocks = Asked(bucket_of(self.keys, buckets), of)
        self.order, self.begins = order, begins

    def block_cells(self) -> np.ndarray:
        """Five bytes a hash: its lower bits, whether it is a block of the index here, and whether two documents have it here."""
        if not len(self.begins):
            return np.zeros((0, 5), np.uint8)
        words, at = self.words, self.at[self.order]
        index = np.logical_or.reduceat(words.place[at] % BLOCK == 0, self.begins)
        ids = self.ids[words.doc[at]]
        several = np.minimum.reduceat(ids, self.begins) != np.maximum.reduceat(ids, self.begins)
        cell = (self.keys & np.uint64((1 << BITS) - 1)) << np.uint64(2) | index.astype(np.uint64) << np.uint64(1) | several.astype(np.uint64)
        return np.ascontiguousarray(cell.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])

    def extend(self, replies: dict[int, bytes]) -> None:
        """The windows around the hits, their digests, and the smallest id that each has here."""
        words = self.words
        hit = np.zeros(len(words.start) + 1, np.int64)
        hit[self.at[self.blocks.answers(replies)[self.blocks.of]] + 1] = 1
        before = np.cumsum(hit)
        n = max(0, len(words.start) - WINDOW + 1)
        ends = WINDOW - BLOCK + 1  # a window holds so many of BLOCK words
        near = before[ends : ends + n] > before[:n]
        self.windows = np.flatnonzero(near & (words.place[:n] + WINDOW <= words.count[words.doc[:n]]))
        d = words.digests(self.windows)
        order = np.lexsort((d[:, 1], d[:, 0]))
        begins = runs_of(d[order, 0], d[order, 1])
        of = np.zeros(len(order), np.int64)
        of[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
        self.digest = d[order][begins]
        ids = self.ids[words.doc[self.windows[order]]]
        self.least = np.minimum.reduceat(ids, begins) if len(begins) else ids
        self.extended = Asked(bucket_of(self.digest[:, 0], self.buckets), of)

    def window_cells(self) -> np.ndarray:
        return np.concatenate([self.digest, self.least.view(np.uint64)[:, None]], axis=1).astype("<u8").view(np.uint8).reshape(-1, 24)

    def repeats(self, replies: dict[int, bytes]) -> pa.Table:
        """Of each document its words, the maximal repeats in it (words from, to) and what stays without them."""
        words = self.words
        earlier = self.extended.answers(replies)[self.extended.of] | (self.ids[words.doc[self.windows]] > self.least[self.extended.of])
        taken = self.windows[earlier]
        edge = np.zeros(len(words.start) + 1, np.int64)
        edge[taken] += 1
        edge[taken + WINDOW] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        turn = gone & (np.concatenate([[False], ~gone[:-1]]) | (words.place == 0))
        stop = gone & (np.concatenate([~gone[1:], [True]]) | (words.place + 1 == words.count[words.doc]))
        begin, end = np.flatnonzero(turn), np.flatnonzero(stop)
        per_doc = np.bincount(words.doc[begin], minlength=len(self.ids))
        spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_doc)), pa.int32()), pa.StructArray.from_arrays([pa.array(words.place[begin], pa.int32()), pa.array(words.place[end] + 1, pa.int32())], names=["start", "end"]))
        size = words.size + 1
        kept = words.data[np.repeat(~gone, size)].tobytes()
        bytes_of = np.bincount(words.doc, weights=np.where(gone, 0, size), minlength=len(self.ids)).astype(np.int64)
        ends = np.cumsum(bytes_of)
        texts = [kept[a : max(a, b - 1)] for a, b in zip((ends - bytes_of).tolist(), ends.tolist(), strict=True)]
        return pa.table({"id": self.rows.column("id").combine_chunks().cast(pa.int64()), "n_words": pa.array(words.count, pa.int64()), "spans": spans, "kept": pa.array(texts, pa.binary()).view(pa.string())})


def _replied(rows: pa.Table, stage: int) -> dict[int, bytes]:
    return {b: bits for b, s, bits in zip(*(rows.column(c).to_pylist() for c in ("bucket", "stage", "bits")), strict=True) if s == stage}


def _replies(rows: pa.Table, stage: int, size: int, decide) -> pa.Table:
    """A bit for each cell of each request, as ``decide(cells)`` says; requests without a yes get no row."""
    blobs = rows.column("cells").to_pylist()
    said = decide(np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, size))
    ends = np.cumsum([len(b) // size for b in blobs])
    bits = [said[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    some = [i for i, x in enumerate(bits) if x.any()]
    return rows.select(["chunk", "bucket"]).take(some).append_column("stage", pa.array([stage] * len(some), pa.int32())).append_column("bits", pa.array([np.packbits(bits[i]).tobytes() for i in some], pa.binary()))


def shared_blocks(cells: np.ndarray) -> np.ndarray:
    """Hashes that are a block somewhere and stand in two documents."""
    wide = np.zeros((len(cells), 8), np.uint8)
    wide[:, :5] = cells
    cell = wide.view("<u8")[:, 0]
    order = np.argsort(cell >> np.uint64(2))
    key = (cell >> np.uint64(2))[order]
    begins = runs_of(key)
    marks = np.bitwise_or.reduceat(cell[order], begins)
    many = np.diff(np.append(begins, len(key)))
    yes = (marks & np.uint64(2) > 0) & ((many > 1) | (marks & np.uint64(1) > 0))
    out = np.zeros(len(cell), bool)
    out[order] = np.repeat(yes, many)
    return out


def earlier_elsewhere(cells: np.ndarray) -> np.ndarray:
    """Windows of which another chunk has a smaller id."""
    wide = np.ascontiguousarray(cells).view("<u8")
    ids = wide[:, 2].view(np.int64)
    order = np.lexsort((wide[:, 1], wide[:, 0]))
    begins = runs_of(wide[order, 0], wide[order, 1])
    least = np.repeat(np.minimum.reduceat(ids[order], begins), np.diff(np.append(begins, len(order))))
    out = np.zeros(len(ids), bool)
    out[order] = least < ids[order]
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, spans array<struct<start, end>> of words, kept): of every row the maximal repeats that a document with a smaller id
    has too, and the words outside of them, joined by one space. Ids are whole numbers."""
    bound_batches(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    chunks, buckets = max(parts, -(-total // CHUNK_BYTES)), max(2 * parts, -(-total // BUCKET_BYTES))
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), chunk.alias("chunk"))
    asks, says = "bucket long, chunk long, cells binary", "chunk long, bucket long, stage int, bits binary"

    def ask_blocks(key: tuple, rows: pa.Table) -> pa.Table:
        made = Chunk(rows, buckets)
        return made.blocks.requests(key[0].as_py(), made.block_cells())

    def answer_blocks(rows: pa.Table) -> pa.Table:
        return _replies(rows, 1, 5, shared_blocks)

    def ask_windows(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        made = Chunk(rows, buckets)
        made.extend(_replied(replies, 1))
        return made.extended.requests(key[0].as_py(), made.window_cells())

    def answer_windows(rows: pa.Table) -> pa.Table:
        return _replies(rows, 2, 24, earlier_elsewhere)

    def finish(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        made = Chunk(rows, buckets)
        made.extend(_replied(replies, 1))
        return made.repeats(_replied(replies, 2))

    by = lambda df: df.groupBy("chunk")
    hits = by(own).applyInArrow(ask_blocks, asks).groupBy("bucket").applyInArrow(answer_blocks, says)
    found = by(own).cogroup(by(hits)).applyInArrow(ask_windows, asks).groupBy("bucket").applyInArrow(answer_windows, says)
    return by(own).cogroup(by(hits.union(found))).applyInArrow(finish, "id long, n_words long, spans array<struct<start:int,end:int>>, kept string")


def op12_substrings(spark, sf_dir: str) -> DataFrame:
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
s AS (SELECT *, CASE WHEN count(*) OVER f = 13 THEN string_agg(word, ' ') OVER f END AS win FROM w WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT win, min(doc_id) AS least FROM s WHERE win IS NOT NULL GROUP BY win),
c AS (SELECT r, i, word, coalesce(max(CASE WHEN least < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone FROM s LEFT JOIN m USING (win))
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(g, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d
LEFT JOIN (SELECT r, count(*) AS n, sum(gone) AS g, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS t FROM c GROUP BY r) AS k USING (r)"""
