"""Language identification by interpolated Kneser-Ney character models.

For every language an order-4 model over letters and word breaks, kept as sorted arrays of n-gram keys per order with
their probabilities: only n-grams that the language has take room. A symbol has 16 bits, so that every letter of the
sample has one of its own. A batch's distinct n-grams are searched once a language. The language of the lowest
cross-entropy per character wins; a rejection limit per language comes from documents that the counts didn't use.

Learning uses at most about ``most_docs`` documents a language (a documented bound, picked by a hash of the id);
counts are summed on Spark. Scoring reads every text whole. ``und`` with score 0 for null texts and texts without a
letter; ties go to the first language by name. Rows with null language aren't learnt from; with nothing to learn from every
row is ``und``. Extra columns are ignored; repeated rows keep a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcfacts.llm.base import held_out, text_pass
from srcfacts.session import cut

ORDER = 4
BITS = 16
MOST_DOCS = 2500
#: Letters that get a symbol of their own; 0 is a word break, 1 any other letter.
MOST_LETTERS = (1 << BITS) - 2
REJECT_Z = 6.0


class Grams(NamedTuple):
    """One language: per order 1..ORDER its sorted n-grams and histories."""

    keys: list[np.ndarray]
    probs: list[np.ndarray]
    past: list[np.ndarray]
    back: list[np.ndarray]  # of a history, the weight of the next lower order


class Model(NamedTuple):
    langs: list[str]
    letters: str
    grams: list[Grams]  # per language
    limits: np.ndarray  # per language: largest accepted cross-entropy


_tables: dict[str, np.ndarray] = {}


def symbols(letters: str) -> np.ndarray:
    """Code point -> symbol."""
    if letters not in _tables:
        table = np.zeros(0x110000, np.uint16)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = 1
        for i, c in enumerate(letters):
            for x in {c, c.upper()}:
                if len(x) == 1:
                    table[ord(x)] = i + 2
        _tables.clear()
        _tables[letters] = table
    return _tables[letters]


def encode(texts: list[str], letters: str) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, where each text begins): each text after ``ORDER - 1`` breaks, runs of breaks as one."""
    glue = "\n" * (ORDER - 1)
    whole = symbols(letters)[np.frombuffer((glue + glue.join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.cumsum([ORDER - 1, *(len(t) + ORDER - 1 for t in texts[:-1])]) if texts else np.empty(0, np.int64)
    keep = np.ones(len(whole), bool)
    keep[1:] = (whole[1:] != 0) | (whole[:-1] != 0)
    keep[-1] = True  # a mark for an empty last text to begin at, cut off again below
    for k in range(1, ORDER):  # the padding before a text stays
        keep[starts - k] = True
    place = np.cumsum(keep) - 1
    # a text that begins with a break: it is part of the padding
    return whole[keep][:-1], np.where(keep[starts], place[starts], place[starts] + 1) if len(starts) else starts


def grams(code: np.ndarray, order: int) -> np.ndarray:
    """Key of the n-gram that ends at each position from ``order - 1`` on."""
    n = len(code) - order + 1
    key = np.zeros(max(n, 0), np.uint64)
    for i in range(order):
        key = key << np.uint64(BITS) | code[i : i + n].astype(np.uint64)
    return key


def _suffix(key: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols."""
    return key & np.uint64((1 << BITS * order) - 1)


def _positions(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions that belong to a text, not to the padding before the next."""
    mine = np.ones(len(code), bool)
    mine[: ORDER - 1] = False
    for k in range(1, ORDER):
        mine[starts[1:] - k] = False
    return mine


def _kneser_ney(keys: np.ndarray, counts: np.ndarray, symbols: int) -> Grams:
    """keys: sorted n-grams of order ``ORDER`` of a language; symbols: how many there are."""
    by_order = {ORDER: (keys, counts.astype(np.float64))}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before
        low, grown = np.unique(_suffix(by_order[n + 1][0], n), return_counts=True)
        by_order[n] = (low, grown.astype(np.float64))
    made = Grams([], [], [], [])
    for n in range(1, ORDER + 1):
        key, c = by_order[n]
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = np.clip(n1 / max(n1 + 2 * n2, 1), 0.1, 0.95)
        hist, at = np.unique(key >> np.uint64(BITS), return_inverse=True)
        total = np.bincount(at, c)
        weight = d * np.bincount(at) / total
        under = 1.0 / symbols if n == 1 else made.probs[-1][np.searchsorted(made.keys[-1], _suffix(key, n - 1))]
        made.probs.append(np.maximum(c - d, 0) / total[at] + weight[at] * under)
        made.keys.append(key)
        made.past.append(hist)
        made.back.append(weight)
    return made


def _probability(lang: Grams, key: np.ndarray, order: int, symbols: int) -> np.ndarray:
    """Of sorted or unsorted n-grams; those that the language doesn't have fall back on the lower order."""
    if order == 0:
        return np.full(len(key), 1.0 / symbols)
    keys = lang.keys[order - 1]
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    out = lang.probs[order - 1][at]
    missing = np.nonzero(keys[at] != key)[0]
    if len(missing):
        lost = key[missing]
        hist, before = lang.past[order - 1], lost >> np.uint64(BITS)
        h = np.minimum(np.searchsorted(hist, before), len(hist) - 1)
        weight = np.where(hist[h] == before, lang.back[order - 1][h], 1.0)
        out[missing] = weight * _probability(lang, _suffix(lost, order - 1), order - 1, symbols)
    return out


def cross_entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages, nats per symbol; letters per text)."""
    code, starts = encode(texts, model.letters)
    sums, n = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts))
    letters = np.add.reduceat((np.append(code, 0) != 0).astype(np.int64), starts) if len(texts) else n
    doc = np.repeat(np.arange(len(texts)), np.diff([0, *starts[1:], len(code)])) if len(texts) else starts
    mine = _positions(code, starts)[ORDER - 1 :]
    for at in range(0, max(len(code) - ORDER + 1, 0), 1 << 20):  # bounded memory for long texts
        part = slice(at, min(at + (1 << 20), len(code) - ORDER + 1))
        own = mine[part]
        key = grams(code[part.start : part.stop + ORDER - 1], ORDER)[own]
        owner = doc[ORDER - 1 :][part][own]
        distinct, place = np.unique(key, return_inverse=True)
        for k, lang in enumerate(model.grams):
            logs = np.log(_probability(lang, distinct, ORDER, len(model.letters) + 2))
            sums[:, k] -= np.bincount(owner, logs[place], len(texts))
        n += np.bincount(owner, minlength=len(texts))
    return sums / np.maximum(n, 1)[:, None], letters




def fit(docs: DataFrame, most_docs: int = MOST_DOCS) -> Model | None:
    """From (doc_id, text, lang) outside the held-out part; None where there is nothing to learn from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return None
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(min(1.0, most_docs / n) * (1 << 20))))])
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) < share[F.col("lang")]).select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(8)) == 0).alias("apart"))
    sample = cut(sample)  # bounded: most_docs documents a language

    def alphabet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                total += np.bincount(np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32), minlength=0x110000) if t else 0
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"c": pa.array(seen, pa.int32()), "n": pa.array(total[seen], pa.int64())})

    counted = sample.select("text").mapInArrow(alphabet, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    letters = "".join(sorted(chr(r.c) for r in sorted((r for r in counted if chr(r.c).isalpha()), key=lambda r: (-r.n, r.c))[:MOST_LETTERS]))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lang, texts in whole.groupby("lang")["text"]:
                code, starts = encode(list(texts), letters)
                keys, n = np.unique(grams(code, ORDER)[_positions(code, starts)[ORDER - 1 :]], return_counts=True)
                yield pd.DataFrame({"lang": lang, "key": keys.view(np.int64), "n": n})

    table = sample.where(~F.col("apart")).select("lang", "text").mapInPandas(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    if not len(table):
        return None
    langs = sorted(set(table.lang))  # a language whose sample is all set apart for calibration has no model
    place = {x: i for i, x in enumerate(langs)}
    models = []
    for lang in langs:
        own = table[table.lang == lang]
        keys = own.key.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        models.append(_kneser_ney(keys[order], own.n.to_numpy()[order], len(letters) + 2))
    model = Model(langs, letters, models, np.full(len(langs), np.inf))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def calibrate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b.lang.isin(langs)]
            h, n = cross_entropies(shared.value, list(b.text))
            own = h[np.arange(len(b)), b.lang.map(place).to_numpy()]
            yield pd.DataFrame({"lang": b.lang.to_numpy(), "h": own})[np.asarray(n) >= 200]

    limits = sample.where("apart").select("lang", "text").mapInPandas(calibrate, "lang string, h double").groupBy("lang").agg(F.avg("h").alias("m"), F.coalesce(F.stddev_pop("h"), F.lit(0.0)).alias("s")).collect()
    for r in limits:
        model.limits[place[r.lang]] = r.m + REJECT_Z * max(r.s, 0.02)
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cross_entropy, accepted) of every row."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was learnt from

    def run(texts: list[str]) -> list:
        m = shared.value
        if m is None or not texts:
            return [["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [False] * len(texts)]
        h, n = cross_entropies(m, texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(texts)), best]
        sure = 1 / np.exp(-(h - low[:, None]) * np.minimum(n, 200)[:, None]).sum(axis=1)
        some = n > 0
        return [
            [m.langs[b] if x else "und" for b, x in zip(best, some, strict=True)],
            np.where(some, sure, 0.0).tolist(),
            [v if x else None for v, x in zip(low.tolist(), some, strict=True)],
            (some & (low <= m.limits[best])).tolist(),
        ]

    return text_pass(docs, run, fields, id_col, text_col)


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
