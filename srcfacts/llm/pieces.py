"""SentencePiece encoding and decoding over a public piece table.

Text becomes "▁" + text with blanks as "▁"; a word is a run of "▁" and what follows up to the next. A word's lattice has
an edge for every substring that is a piece. The table at hand is of the merging kind (byte-pair scores), for which the
best path isn't the one of the largest sum but the one that merging takes: edges in the order of their scores, then
from the left; an edge is taken if just two symbols lie under it. ``encode_words`` builds the lattice relationally -
substrings exploded (those whose first characters begin a piece), joined to the piece table, grouped by word - and folds it with Spark's ``aggregate``: ``merge`` for
this kind, ``viterbi`` (largest sum) for unigram tables.

Whole corpora: documents are dealt into buckets of a bounded size, the only time that texts are shuffled. The distinct words of
a bucket, all of them, go through the relational lattice where they are - exploding, joining with broadcast tables and grouping keep
partitions and order - and meet their bucket's texts again as a cogroup, whose task puts each text's words one after another.
Words over ``LONGEST`` characters are exploded in overlapping chunks; their edges, and those of runs of blanks, come from the same
relation and are folded in that task, as their cuts don't fit into a long.

Characters without a piece become bytes. Decoding gives the text back exactly, but for "▁" itself, which reads as a
blank. Null and empty texts have no pieces; words of any length are encoded whole; extra columns are ignored and
repeated rows keep a row each.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from srcfacts.llm.base import ROWS_AT_ONCE, bound_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words that a task learns at once.
MOST_WORDS = 30_000
#: Characters of a bucket of documents, about, and at least where a small input is dealt over the session's cores.
BUCKET_CHARS = 72_000_000
LEAST_CHARS = 1_000_000
#: Groups whose rows come in order are gathered without hashing.
_SORTED = "spark.sql.execution.replaceHashWithSortAgg"
#: Words that a worker remembers, in each of two generations (about 200 bytes each), and parts of words.
MOST_CACHED = 400_000
MOST_PARTS = 150_000
#: Longest word that goes through the relational lattice: its cuts are bits of a long.
LONGEST = 60


class Pieces(NamedTuple):
    ids: dict[str, int]
    order: dict[str, int]  # of pieces of two characters or more: place by score, best first
    first_byte: int
    spelled: list[bytes]  # by id
    longest: int
    begun: dict[str, int]  # ``order``, and -1 for what a piece begins with
    bigrams: frozenset[str]
    tied: int  # place by score that several pieces share; -1 if none does


def load(path: str = MODEL) -> Pieces:
    """The piece table of a model file; ``path`` is the driver's."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = range(model.get_piece_size())
    names = [model.id_to_piece(i) for i in size]
    plain = [i for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    spelled = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].encode() for i in size]
    long = [i for i in plain if len(names[i]) > 1]
    rank = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in long}, reverse=True))}
    return Pieces(
        {names[i]: i for i in plain},
        {names[i]: rank[model.get_score(i)] for i in long},
        next(i for i in size if model.is_byte(i)),
        spelled,
        max(len(names[i]) for i in long),
        {names[i][:n]: -1 for i in long for n in range(2, len(names[i]))} | {names[i]: rank[model.get_score(i)] for i in long},
        frozenset(n[k : k + 2] for i in long for n in [names[i]] for k in range(len(n) - 1)),
        len(rank) - 1 if len(rank) < len(long) else -1,
    )


# --- the relational lattice ---------------------------------------------------------------------------------------


#: Characters of a substring that decide whether longer ones can be pieces.
HEAD = 3


def heads_at(spark: SparkSession) -> DataFrame:
    """(n, s, h): where the substrings of two to ``HEAD`` characters of a word of n <= ``LONGEST`` begin, and their length."""
    rows = [(n, s, h) for n in range(2, LONGEST + 1) for s in range(n - 1) for h in range(2, min(n - s, HEAD) + 1)]
    return spark.createDataFrame(rows, "n int, s int, h int")


def heads_of(pieces: DataFrame) -> DataFrame:
    """(head, size, own): pieces of fewer than ``HEAD`` characters, and the sizes of those that begin with a head of ``HEAD``; own is the
    place by score of a piece that is its head, null for the longer ones, which are looked up in full."""
    size = F.length("piece")
    sized = pieces.select(F.substring("piece", 1, HEAD).alias("head"), size.alias("size"), F.when(size <= HEAD, F.col("k")).alias("own"))
    return sized.groupBy("head", "size").agg(F.max("own").alias("own"))


def lattice(chunks: DataFrame, pieces: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """(group.., word, edges array<long>): all substrings of the words that are pieces of two characters or more, by score
    and then from the left; an edge is k * 2^36 + s * 64 + n: the piece's place by score, where it begins, its length.

    chunks: (group.., word, at, chunk), parts of at most ``LONGEST`` characters of a word, the next one beginning before any piece that
    the one before can't hold; pieces: (piece, k). Words without an edge have no row.
    Every substring of two or three characters is looked up first; longer ones follow in the sizes that pieces of such a beginning have.
    Exploding and joining with the broadcast tables keep partitions and order, so that grouping needs neither shuffle nor sort
    where the chunks come dealt by ``group``."""
    keys = [*group, "word"]
    # the joins keep this order; the filter, true for every row, keeps the sort itself, which is optimized away right under a join or a grouping
    ordered = chunks.select(*keys, "at", "chunk", F.length("chunk").alias("n")).where("n > 1").sortWithinPartitions(*keys, "at").where(F.spark_partition_id() >= 0)
    begun = ordered.join(F.broadcast(heads_at(chunks.sparkSession)), "n").withColumn("head", F.substring("chunk", F.col("s") + 1, F.col("h")))
    sized = begun.join(F.broadcast(heads_of(pieces)), "head").where(F.col("s") + F.col("size") <= F.col("n"))
    whole = F.when(F.col("own").isNull(), F.substring("chunk", F.col("s") + 1, F.col("size")))
    named = sized.select(*keys, "at", "s", "size", "own", whole.alias("piece")).join(F.broadcast(pieces), "piece", "left")
    found = named.select(*keys, "at", "s", "size", F.coalesce("own", "k").alias("k")).where("k is not null")
    edge = F.col("k").cast("long") * (1 << 36) + (F.col("at") + F.col("s")) * F.lit(64) + F.col("size")
    return found.select(*keys, edge.alias("edge")).groupBy(*keys).agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def _ones(low: Column, high: Column) -> Column:
    """Bits low..high-1."""
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, high.cast("int")) - F.call_function("shiftleft", one, low.cast("int"))


def merge(edges: Column, length: Column) -> Column:
    """Cuts of the word as bits, by merging: edges sorted by score; taken where exactly one cut lies inside."""

    def inside_of(edge: Column) -> Column:
        """The places between the edge's begin and its end."""
        one = F.lit(1).cast("long")
        size, s = edge.bitwiseAND(F.lit(63)).cast("int"), F.shiftright(edge, 6).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.call_function("shiftleft", one, size - 1) - one, s + 1)

    def step(cuts: Column, inside: Column) -> Column:
        under = cuts.bitwiseAND(inside)
        whole = inside.bitwiseOR(F.shiftleft(inside, 1)).bitwiseOR(F.shiftright(inside, 1))
        apply = (F.bit_count(under) == 1) & (F.bit_count(cuts.bitwiseAND(whole)) == 3)  # both ends are cuts, too
        return F.when(apply, cuts.bitwiseXOR(under)).otherwise(cuts)

    return F.aggregate(F.transform(edges, inside_of), _ones(F.lit(0), length + 1), step)


def viterbi(edges: Column, length: Column, unknown: float) -> Column:
    """Cuts of the word as bits, by the largest sum of scores; edges: struct<s, e, score>, characters without a piece cost ``unknown``.

    The fold takes edges by their ends; the state is the best (sum, cuts) up to every position.
    """
    singles = F.transform(F.sequence(F.lit(0), length - 1), lambda s: F.struct((s + 1).alias("e"), s.alias("s"), F.lit(float(unknown)).alias("score")))
    by_end = F.array_sort(F.concat(F.transform(edges, lambda x: F.struct(x["e"].alias("e"), x["s"].alias("s"), x["score"].cast("double").alias("score"))), singles))
    none = F.struct(F.lit(float("-inf")).alias("sum"), F.lit(0).cast("long").alias("cuts"))
    first = F.struct(F.lit(0.0).alias("sum"), F.lit(1).cast("long").alias("cuts"))
    start = F.concat(F.array(first), F.transform(F.sequence(F.lit(1), length), lambda _: none))

    def step(best: Column, x: Column) -> Column:
        before = F.element_at(best, x["s"] + 1)
        sums = before["sum"] + x["score"]
        better = sums > F.element_at(best, x["e"] + 1)["sum"]
        new = F.struct(sums.alias("sum"), before["cuts"].bitwiseOR(_ones(x["e"], x["e"] + 1)).alias("cuts"))
        return F.when(better, F.transform(best, lambda b, i: F.when(i == x["e"], new).otherwise(b))).otherwise(best)

    return F.element_at(F.aggregate(by_end, start, step), -1)["cuts"]


def _symbols(word: Column, cuts: Column) -> Column:
    """The word's parts between its cuts."""
    at = F.filter(F.sequence(F.lit(0), F.length(word)), lambda i: cuts.bitwiseAND(_ones(i, i + 1)) != 0)
    return F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.substring(word, a + 1, b - a))


def table_of(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, k) of the pieces of two characters or more: a vocabulary, of fixed size."""
    return spark.createDataFrame([(p, k) for p, k in pieces.order.items() if k != pieces.tied], "piece string, k int")


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, symbols array<string>) of distinct words, each by the relational lattice; symbols are null for words over
    ``LONGEST`` characters and for those with "▁" twice in a row, which ``segment`` folds."""
    whole = words.where(~F.col("word").contains(SPACE * 2) & (F.length("word") <= LONGEST)).select("word", F.lit(0).alias("at"), F.col("word").alias("chunk"))
    found = lattice(whole.repartition("word"), table_of(words.sparkSession, pieces))
    cuts = found.select("word", merge(F.col("edges"), F.length("word")).alias("cuts"))
    short = F.length("word").between(1, LONGEST) & ~F.col("word").contains(SPACE * 2)
    every = words.join(cuts, "word", "left").withColumn("cuts", F.coalesce("cuts", _ones(F.lit(0), F.length("word") + 1)))
    return every.select("word", F.when(short, _symbols(F.col("word"), F.col("cuts"))).alias("symbols"))


# --- the same lattice inside a task -------------------------------------------------------------------------------


def fold(word: str, edges: Iterable[tuple[int, int]], pieces: Pieces) -> list[str]:
    """The word's symbols from its edges (s, e) by score, then from the left; after[s] is where the symbol that begins at s ends."""
    order, n, last = pieces.begun.get, len(word), pieces.tied
    after = list(range(1, n + 1))
    for s, e in edges:
        m = after[s]
        if m and m < e and after[m] == e:
            after[s], after[m] = e, 0
    if last >= 0 and SPACE * 2 in word:  # pieces of one score, the lowest: always the leftmost pair that is one
        s = 0
        while s < n and after[s] < n:
            m = after[s]
            if m and order(word[s : after[m]]) == last:
                after[s], after[m], s = after[m], 0, 0
            else:
                s = m or s + 1
    return [word[s : after[s]] for s in range(n) if after[s]]


def segment(word: str, pieces: Pieces) -> list[str]:
    """The word's symbols, the lattice built here."""
    order, longest, n, last = pieces.begun.get, pieces.longest, len(word), pieces.tied
    edges = []
    for s in range(n - 1):
        for e in range(s + 2, min(n, s + longest) + 1):
            k = order(word[s:e])
            if k is None:  # no piece begins like this
                break
            if k >= 0 and k != last:
                edges.append((k, s, e))
    edges.sort()
    return fold(word, [(s, e) for _, s, e in edges], pieces)


def ids_of(symbols: list[str], pieces: Pieces) -> list[int]:
    out: list[int] = []
    for x in symbols:
        i = pieces.ids.get(x)
        if i is not None:
            out.append(i)
        else:
            out += [pieces.first_byte + b for b in x.encode("utf-8", "surrogatepass")]
    return out


WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Encoder:
    """Texts to ids (bytes of 32-bit numbers) with a bounded memory of words, kept without their leading "▁"."""

    def __init__(self, pieces: Pieces, known: dict[str, bytes]):
        self.pieces, self.known, self.cache, self.older, self.parts = pieces, known, dict(known), {}, {}
        self.edges: dict[str, list[int]] = {}
        self.inexact: set[str] = set()  # words that decoding doesn't give back

    def word(self, word: str) -> bytes:
        """Of "▁" + word."""
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= MOST_CACHED + len(self.known):  # the words since the last time stay within reach
                self.cache, self.older = dict(self.known), self.cache
            found = self.cache[word] = self.older.get(word) or self.apart(SPACE + word)
        return found

    def apart(self, word: str) -> bytes:
        """Cut first where no piece has the two characters side by side: no merge crosses there."""
        bigrams, parts, at = self.pieces.bigrams, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in bigrams:
                parts.append(word[at:i])
                at = i
        if not parts:
            return self.folded(word)
        parts.append(word[at:])
        return b"".join(map(self.part, parts))

    def folded(self, part: str) -> bytes:
        ids = ids_of(segment(part, self.pieces) if len(part) > 1 else [part], self.pieces)
        return struct.pack(f"<{len(ids)}i", *ids)

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= MOST_PARTS:
                self.parts.clear()
            found = self.parts[part] = self.folded(part)
        return found

    def learn(self, words: list[str], cuts: pa.Array, edges: pa.Array) -> None:
        """Words that the relational lattice has encoded: by their cuts, all at once, or by the edges where cuts don't fit into a long."""
        if cuts.null_count:
            for w, c, x in zip(words, cuts.is_null().to_pylist(), edges.to_pylist(), strict=True):
                if c:
                    self.edges[w] = x
            words, cuts = [w for w, c in zip(words, cuts.is_valid().to_pylist(), strict=True) if c], cuts.drop_null()
        text, ends = SPACE + SPACE.join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        cuts = np.ascontiguousarray(cuts, "<i8")
        row, at = np.nonzero(np.unpackbits(cuts.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        inside = row[1:] == row[:-1]  # from one cut of a word to its next
        at = at + np.concatenate([[0], ends])[row]
        spans = zip(at[:-1][inside].tolist(), at[1:][inside].tolist(), strict=True)
        of, ids = row[1:][inside], np.fromiter(map(self.pieces.ids.get, [text[a:b] for a, b in spans], repeat(-1)), "<i4")
        packed, to = ids.tobytes(), 4 * np.cumsum(np.bincount(of, minlength=len(words)))
        self.known.update(zip(words, [packed[a:b] for a, b in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)] if words else [], strict=True))
        for i in np.unique(of[ids < 0]).tolist():  # characters without a piece
            self.known[words[i]] = self.checked(words[i], ids_of(symbols_of_cuts(SPACE + words[i], int(cuts[i])), self.pieces))

    def of_words(self, words: list[str]) -> bytes:
        """Of words that were learnt; those without an edge are characters."""
        found = list(map(self.known.get, words))
        if None in found:
            found = [self.looked_up(w) if x is None else x for x, w in zip(found, words, strict=True)]
        return b"".join(found)

    def looked_up(self, word: str) -> bytes:
        edges = self.edges.get(key_of(word), ())
        spans = [((x >> 6) & 0x3FFFFFFF, x & 63) for x in edges]
        found = self.known[word] = self.checked(word, ids_of(fold(SPACE + word, [(s, s + n) for s, n in spans], self.pieces), self.pieces))
        return found

    def checked(self, word: str, ids: list[int]) -> bytes:
        if b"".join(map(self.pieces.spelled.__getitem__, ids)) != (SPACE + word).encode("utf-8", "surrogatepass"):
            self.inexact.add(word)
        return struct.pack(f"<{len(ids)}i", *ids)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        words = text.split(" ")
        if SPACE in text or "" in words:  # runs of blanks belong to the word behind them
            return b"".join(map(self.apart, WORDS.findall(SPACE + text.replace(" ", SPACE))))
        found = list(map(self.cache.get, words))
        if None in found:
            found = [x or self.word(w) for x, w in zip(found, words, strict=True)]
        return b"".join(found)


def decode(ids, pieces: Pieces) -> str:
    text = b"".join(map(pieces.spelled.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text[:1] == " " else text


# --- whole corpora ------------------------------------------------------------------------------------------------


def words_in(text: str) -> list[str]:
    """The text's words without their leading "▁"."""
    words = text.split(" ") if text else []
    if SPACE in text or "" in words:  # runs of blanks belong to the word behind them
        words = [w[1:] for w in WORDS.findall(SPACE + text.replace(" ", SPACE))]
    return words


def key_of(word: str) -> str:
    """The word itself, or what stands for a long one: no word of ``LONGEST`` characters or fewer reads like that."""
    return word if len(word) < LONGEST else hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()


def words_column(text: Column) -> Column:
    """``words_in``."""
    runs = F.contains(text, F.lit(SPACE)) | F.contains(text, F.lit("  ")) | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    spaced = F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))
    found = F.transform(F.regexp_extract_all(spaced, F.lit(f"({SPACE}+[^{SPACE}]*)")), lambda w: F.substring(w, 2, 1 << 30))
    return F.when(text != "", F.when(runs, found).otherwise(F.split(text, " ")))


def chunks_of(words: DataFrame, longest: int) -> DataFrame:
    """(bucket, word, at, chunk) for ``lattice`` from distinct (bucket, w); word is ``key_of``."""
    short, step = F.length("w") < LONGEST, LONGEST - longest + 1
    at = F.when(short, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("w") + 1 - longest), F.lit(step)))
    placed = words.select("bucket", "w", F.when(short, F.col("w")).otherwise(F.sha2("w", 256)).alias("word"), F.explode(at).alias("at"))
    return placed.select("bucket", "word", "at", F.substring(F.concat(F.lit(SPACE), "w"), F.col("at") + 1, F.lit(LONGEST)).alias("chunk"))


def symbols_of_cuts(word: str, cuts: int) -> list[str]:
    out, s, cuts = [], 0, cuts & (cuts - 1)
    while cuts:
        low = cuts & -cuts
        e = low.bit_length() - 1
        out.append(word[s:e])
        s, cuts = e, cuts ^ low
    return out


def dealt(docs: DataFrame, row: Column, text_col: str) -> DataFrame:
    """(bucket, row) of all rows, a partition each bucket: documents by the hash of the row, some ``BUCKET_CHARS`` characters a bucket."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(F.col(f"`{text_col}`")))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    n = max(1, -(-chars // BUCKET_CHARS), min(cores, chars // LEAST_CHARS))
    places = spark.range(30 * n + 100).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")).groupBy("at").agg(F.min("id").alias("id")).collect()
    names = F.array(*[F.lit(r.id) for r in places])  # numbers that fall into different partitions
    packed = docs.select(row.alias("row"))
    placed = packed.select(F.element_at(names, (F.pmod(F.xxhash64("row.c0", "row.text"), F.lit(len(places))) + 1).cast("int")).alias("bucket"), "row")
    return placed.select("bucket", F.when(F.col("bucket") >= 0, F.col("row")).alias("row")).repartition(n, "bucket")  # a row that may be null, see ``encoded``


def encoded(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_pieces, ids array<int>, exact boolean) of every row; exact: decoding gives the text back."""
    bound_batches(docs)
    spark, kept = docs.sparkSession, [id_col, *keep]
    spark.conf.set(_SORTED, "true")
    shared = spark.sparkContext.broadcast(pieces)
    texts = dealt(docs, F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text_col}`").alias("text")), text_col)

    # asking for the whole row keeps both readers' columns the same, so that texts are shuffled once
    text = F.when(F.col("row").isNotNull(), F.col("row.text"))
    words = texts.select("bucket", F.explode(words_column(text)).alias("w")).distinct()
    chunks = chunks_of(words, pieces.longest)
    found = lattice(chunks, table_of(spark, pieces), ("bucket",))
    bits = (F.length("word") < LONGEST) & ~F.concat(F.lit(SPACE), F.col("word")).contains(SPACE * 2)
    book = found.select(F.col("bucket").alias("place"), "word", F.when(bits, merge(F.col("edges"), F.length("word") + 1)).alias("cuts"), F.when(~bits, F.col("edges")).alias("edges"))

    fields = [T.StructField("n_pieces", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())]
    names = [*kept, *[f.name for f in fields]]
    schema = T.StructType([docs.schema[c] for c in kept] + fields)

    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        pieces = shared.value
        encoder = Encoder(pieces, {})
        for batch in words.to_batches(max_chunksize=MOST_WORDS):
            encoder.learn(batch.column("word").to_pylist(), batch.column("cuts"), batch.column("edges"))
        out = []
        for batch in rows.to_batches(max_chunksize=ROWS_AT_ONCE):
            row = batch.column("row")
            texts = [t or "" for t in row.field("text").to_pylist()]
            split = [words_in(t) for t in texts]
            made = [encoder.of_words(w) for w in split]
            sizes = [len(x) // 4 for x in made]
            exact = [SPACE not in t and (not encoder.inexact or encoder.inexact.isdisjoint(w)) for t, w in zip(texts, split, strict=True)]  # blanks become "▁", and "▁" a blank
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.frombuffer(b"".join(made), "<i4"), pa.int32()))
            out.append(pa.RecordBatch.from_arrays([*(row.field(f"c{i}") for i in range(len(kept))), pa.array(sizes, pa.int32()), ids, pa.array(exact)], names=names))
        return pa.Table.from_batches(out) if out else to_arrow_schema(schema).empty_table()

    return texts.groupBy("bucket").cogroup(book.groupBy("place")).applyInArrow(run, schema)


def decoded(rows: DataFrame, pieces: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids array<int>); null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        for b in batches:
            texts = [decode(x or [], shared.value) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], names=[id_col, "text"])

    picked = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return picked.mapInArrow(run, T.StructType([rows.schema[id_col], T.StructField("text", T.StringType())]))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), load())
