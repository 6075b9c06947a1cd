"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: lower-cased A-Z, words ``[^\\x20\\x09-\\x0D]+``, ``k``-word shingles with repeats (fewer words: the whole
sequence; none, or null text: fingerprint 0), XXH64 with seed 42; a bit is set if it is in over half of the hashes.

Links (at most ``tau`` differing bits) are found without comparing all pairs:

1. correlated bits are grouped into ``m`` parts, from the 64 x 64 bit correlations of all distinct fingerprints;
2. the count of every part value gives each fingerprint the candidates it would meet; a dynamic program per
   fingerprint deals the thresholds t_1..t_m, sum tau - m + 1 and -1 = part not probed, at the least estimated cost
   (any two within tau bits agree within t_i on some part i);
3. each fingerprint probes the part values within its thresholds and verifies what it meets on all 64 bits;
4. a part value that more than ``bucket`` distinct fingerprints share is not joined pair by pair: those fingerprints
   meet at their one-bit variants instead, which is exact too and linear (two are within 2 bits
   just when they share a variant of at most one flipped bit).

``far_pairs`` is the search for edited copies, whose fingerprints are many bits apart: fingerprints of several words, in which
groups of bits that agree whole give candidates (see there).

Equal fingerprints are one node throughout, so exact copies cost nothing. Extra columns are ignored; repeated rows
keep a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcfacts.llm.base import components, text_pass
from srcfacts.session import cut, stored

SEED = 42
BUCKET = 64
#: Of wide fingerprints: the share of bits in which sets of similarity 0.8 differ at most (4 of 5 elements; 0.152 for large sets), bits
#: of the two words checked that may differ, fingerprints that should share a group's value, and that meet in a task at most.
DIFFER, FAR, SHARED, BLOCK = 0.1875, 36, 16384, 32768


def shingle_hashes(text: str, k: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and just the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    hashed, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= k:
        return np.array([hashed(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-k].tolist()]
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], np.uint64)


def fingerprint(text: str, k: int = 3) -> int:
    """As a signed 64-bit integer."""
    h = shingle_hashes(text, k)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):  # bounded memory for long texts
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row."""
    return text_pass(docs, lambda texts: [[fingerprint(t, k) for t in texts]], [T.StructField("fp", T.LongType())], id_col, text_col)


def _co_occurrence(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many of them each pair of bits is set: 4096 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((64, 64))
        for b in batches:
            v = np.asarray(b.column("fp")).astype(np.int64)
            for at in range(0, len(v), 65536):
                bits = np.unpackbits(np.ascontiguousarray(v[at : at + 65536]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
            n += len(v)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    parts = nodes.select("fp").mapInArrow(run, "n long, sums array<double>")
    summed = parts.select("n", F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n")).collect()
    grid = np.zeros(4096)
    for r in summed:
        grid[r.pos] = r.s
    return (summed[0].n if summed else 0), grid.reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Parts of near-equal width; each takes, bit by bit, the free bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        rest = sorted(free)
        part = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        free.discard(part[0])
        while len(part) < width:
            best = max(sorted(free), key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def parts_for(n: int, tau: int) -> int:
    """Fewest parts whose values stay rare: wide parts cost probes, narrow ones candidates."""

    def cost(m: int) -> float:
        width, left = 64 // m, tau - m + 1
        t = [max(-1, min(tau, left))] if m == 1 else [0] * m if left <= 0 else [left] + [0] * (m - 1)
        return sum(sum(math.comb(width, j) for j in range(x + 1)) * (1 + n / 2**width) for x in t if x >= 0)

    return min(range(1, tau + 2), key=cost)


def allocate(counts: np.ndarray, widths: list[int], n: int, tau: int) -> np.ndarray:
    """Thresholds per row by dynamic programming; counts[row, part] = fingerprints with the row's part value.

    The cost of threshold t on a part: its probes, and the candidates estimated from the value's own count and,
    for flipped values, the mean count of a value.
    """
    rows, m = counts.shape
    options = list(range(-1, tau + 1))
    cost = np.zeros((rows, m, len(options)))
    for i, w in enumerate(widths):
        for j, t in enumerate(options[1:], 1):
            flips = sum(math.comb(w, d) for d in range(1, t + 1))
            cost[:, i, j] = 1 + flips + counts[:, i] + flips * n / 2.0**w
    low, high = -m, m * tau
    best = np.full((rows, high - low + 1), np.inf)
    best[:, -low] = 0
    picks = []
    for i in range(m):
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for j, t in enumerate(options):
            shifted = np.full_like(best, np.inf)
            if t >= 0:
                shifted[:, t:] = best[:, : best.shape[1] - t]
            else:
                shifted[:, :-1] = best[:, 1:]
            tried = shifted + cost[:, i, j, None]
            better = tried < new
            new[better], pick[better] = tried[better], t
        best = new
        picks.append(pick)
    at = np.full(rows, tau - m + 1 - low)
    out = np.zeros((rows, m), np.int8)
    for i in reversed(range(m)):
        out[:, i] = picks[i][np.arange(rows), at]
        at = at - out[:, i]
    return out


def _part_value(part: list[int]) -> F.Column:
    """The part's bits of ``fp``, in place."""
    mask = sum(1 << b for b in part)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def links(nodes: DataFrame, tau: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the ``rep``s of distinct fingerprints (fp, rep), enough to join all within tau bits.

    Part values shared by over ``bucket`` fingerprints go through one-bit variants, exact for tau <= 2.
    """
    if not 0 <= tau <= 2:
        raise ValueError("tau must be 0, 1 or 2")
    n, both = _co_occurrence(nodes)
    m = parts_for(n, tau)
    parts = group_bits(n, both, m)
    signed = lambda b: (1 << b) - (1 << 64) if b == 63 else 1 << b
    # A part's value is keyed by (part, value); the number of distinct fingerprints under it is its weight.
    keyed = nodes.select("fp", "rep", F.posexplode(F.array(*[_part_value(p) for p in parts])).alias("part", "value"))
    weights = stored(keyed.groupBy("part", "value").agg(F.count("*").alias("weight")))  # so that the join may split a crowded value
    index = cut(keyed.join(weights, ["part", "value"]))

    widths, flips = [len(p) for p in parts], [[0, *(signed(b) for b in p)] for p in parts]

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                b = whole.iloc[at : at + 4096]
                fp, rep = b.fp.to_numpy(np.int64), b.rep.to_numpy()
                counts = np.zeros((len(b), m))
                for row, pairs in enumerate(b.weights):
                    for x in pairs:
                        counts[row, x["part"]] = x["weight"]
                t = allocate(counts, widths, n, tau)
                for i, part in enumerate(parts):
                    mask = np.bitwise_or.reduce(np.array(flips[i], np.int64))
                    for far in range(tau + 1):
                        rows = np.nonzero(t[:, i] >= far)[0]
                        if not len(rows):
                            continue
                        for bits in combinations(part, far):
                            flip = np.bitwise_or.reduce(np.array([0, *(signed(x) for x in bits)], np.int64))
                            yield pd.DataFrame({"part": np.int32(i), "value": (fp[rows] & mask) ^ flip, "fp": fp[rows], "rep": rep[rows]})

    rep_type = nodes.schema["rep"].dataType.simpleString()
    asked = index.groupBy("fp", "rep").agg(F.collect_list(F.struct("part", "weight")).alias("weights"))
    probed = asked.mapInPandas(probes, f"part int, value long, fp long, rep {rep_type}")

    light = index.where(F.col("weight") <= bucket).select("part", "value", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    met = probed.join(light, ["part", "value"]).where((F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= tau) & (F.col("rep") != F.col("rep2")))
    pairs = met.select(F.col("rep").alias("a"), F.col("rep2").alias("b"))

    heavy = weights.where(F.col("weight") > bucket).select("part", "value")
    crowd = probed.join(heavy, ["part", "value"], "left_semi").select("fp", "rep").union(index.where(F.col("weight") > bucket).select("fp", "rep")).distinct()
    variants = crowd.select("rep", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(b))) for b in range(64)])).alias("v")) if tau == 2 else None
    if tau == 2:
        stars = variants.groupBy("v").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b <> most").select("v", "b")
        pairs = pairs.union(variants.join(stars, "v").where("rep <> b").select(F.col("rep").alias("a"), "b"))
    elif tau == 1:
        # Within one bit: a fingerprint meets the owner of each of its variants.
        flipped = crowd.select("rep", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(signed(b))) for b in range(64)])).alias("fp2"))
        pairs = pairs.union(flipped.join(nodes.select(F.col("fp").alias("fp2"), F.col("rep").alias("b")), "fp2").select(F.col("rep").alias("a"), "b"))
    return pairs


def wide_layout(n: int) -> tuple[int, int, int]:
    """(bits of a group, groups, words of a fingerprint) for ``n`` fingerprints.

    More fingerprints get wider groups, so that few share a value, and more of them: two that differ in ``DIFFER`` of their bits
    agree on no group with a probability of e^-10 (3e-7 for large sets at 0.8 and groups of 8 bits).
    """
    width = min(16, max(8, math.ceil(math.log2(max(n, 1) / SHARED))))
    groups = math.ceil(-10 / math.log1p(-((1 - DIFFER) ** width)))
    return width, groups, -(-groups // (64 // width))


def wide_fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """SimHash of ``words`` 64-bit words: the first by the hashes themselves, the others by a mix of each; a bit is set if it is in over half."""
    ones, odd = np.zeros(64 * words, np.int64), np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 255):  # sums of a chunk fit a byte
        x = h[at : at + 255, None] + odd
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        x ^= x >> np.uint64(31)
        x[:, 0] = h[at : at + 255]
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)


def _meet(n: np.ndarray, left: np.ndarray, right: np.ndarray, mine: np.ndarray, across: bool, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of one block, or across two, that are of near sizes and within ``FAR`` bits; rows ascend by ``n``.

    Over ``most`` pairs for each row that has any, it is paired with its first partner only, and all such rows are returned too.
    """
    left, right = left.view(np.uint64), right.view(np.uint64)  # of signed numbers the bits of the absolute value would be counted
    count, places, step = len(n), np.arange(len(n)), max(16, (1 << 20) // len(n))
    ends = np.searchsorted(4 * n, 5 * n, side="right")
    first, degree, pairs, total = np.full(count, count), np.zeros(count, np.int64), [], 0
    for at in range(0, count, step):
        i, to = places[at : at + step, None], ends[min(at + step, count) - 1]
        j = places[None, at:to]
        far = np.bitwise_count(left[i] ^ left[j]) + np.bitwise_count(right[i] ^ right[j])
        x, y = np.nonzero((far <= FAR) & (j > i) & (j < ends[i]) & ((mine[i] != mine[j]) == across))
        x, y = x + at, y + at
        np.minimum.at(first, y, x)
        degree += np.bincount(x, minlength=count) + np.bincount(y, minlength=count)
        total += len(x)
        if total <= most * count:
            pairs.append((x, y))
    if total <= most * np.count_nonzero(degree):
        return *(np.concatenate(z) for z in zip(*pairs)), places[:0]
    j = np.nonzero(first < count)[0]
    return first[j], j, np.nonzero(degree)[0]


def _meetings(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(bucket, a, b) of rows sorted by (bucket, low, high, n)."""

    def found(t: pa.Table, starts: np.ndarray, stops: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket, low, high, n, left, right, mine = (t.column(c).to_numpy() for c in ("bucket", "low", "high", "n", "left", "right", "mine"))
        node, made = t.column("node").combine_chunks(), []
        for p, q in zip(starts.tolist(), stops.tolist(), strict=True):
            if q - p > 1:
                i, j, opened = _meet(n[p:q], left[p:q], right[p:q], mine[p:q], low[p] != high[p], most)
                made.append((np.concatenate([i, opened]) + p, np.concatenate([j, np.full(len(opened), -1 - p)]) + p))
        if made:
            i, j = (np.concatenate(x) for x in zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[i]), node.take(pa.array(i)), node.take(pa.array(j, mask=j < 0))], names=["bucket", "a", "b"])

    held, rows, enough = [], 0, 1 << 14
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= enough:
            t = pa.Table.from_batches(held)
            starts = _starts(t)
            yield from found(t, starts[:-1], starts[1:])
            held = t.slice(starts[-1]).to_batches()  # the last block may go on
            rows -= int(starts[-1])
            enough = (1 << 14) + 2 * rows
    if rows:
        t = pa.Table.from_batches(held)
        starts = _starts(t)
        yield from found(t, starts, np.append(starts[1:], rows))


def _starts(t: pa.Table) -> np.ndarray:
    """Where the blocks of sorted rows begin."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in ("bucket", "low", "high"):
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.nonzero(new)[0]


def far_pairs(nodes: DataFrame, layout: tuple[int, int, int], most: int = 4, block: int = BLOCK) -> DataFrame:
    """(bucket, a, b) of distinct nodes (node, n, wide): pairs that agree whole on a group of bits (their bucket), are within ``FAR`` of the
    128 bits of the two words after the group's, and of sizes ``n`` with the smaller one 4/5 of the larger at least.

    By pigeonhole pairs of near sizes that differ in ``FAR`` bits in all are found for certain (there are more groups); pairs beyond
    that with the probability that ``wide_layout`` states. Where a bucket holds over ``most`` pairs for each node that has any, these are paired with one partner each and
    listed as (bucket, a, null): all pairs of a bucket's listed nodes are open, and for the caller to look through.
    """
    width, groups, words = layout
    per = 64 // width
    keyed = nodes.select("node", F.col("n").cast("int").alias("n"), "wide", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")).select(
        F.expr(f"(g * {1 << width}L) + (shiftrightunsigned(wide[g div {per}], cast(g % {per} as int) * {width}) & {(1 << width) - 1}L)").alias("bucket"),
        "node", "n", F.expr(f"wide[(g div {per} + 1) % {words}]").alias("left"), F.expr(f"wide[(g div {per} + 2) % {words}]").alias("right"),
    )
    crowds = stored(keyed.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"))
    dealt = keyed.join(crowds, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    kind = nodes.schema["node"].dataType.simpleString()
    blocks = spread.drop("other", "blocks").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "n")
    return blocks.mapInArrow(lambda batches: _meetings(batches, most), f"bucket long, a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, k: int = 3, tau: int = 2, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id, fp long, component): the smallest id reachable over links of at most ``tau`` bits, itself included.

    Rows with a null id are their own component (null), and are linked with nothing.
    """
    prints = cut(fingerprints(docs, k, id_col, text_col).withColumnRenamed(id_col, "__id"))
    nodes = cut(prints.where("__id is not null").groupBy("fp").agg(F.min("__id").alias("rep")))
    found = components(links(nodes, tau, bucket))
    of_fp = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    joined = prints.where("__id is not null").join(of_fp, "fp")
    alone = prints.where("__id is null").select("fp", "__id", F.col("__id").alias("component"))
    return joined.select("fp", "__id", "component").union(alone).select(F.col("__id").alias(id_col), "fp", "component")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
