"""Toxicity by multiple-instance learning: sentences are instances, documents carry the labels.

A sentence's score is logistic in the words and word beginnings it holds; a document's is the noisy-or of its sentences,
1 - prod(1 - p). Only document labels are known; the gradient of their likelihood trains the sentence scores, which
then say which sentences offend.

Learning uses at most about ``most_docs`` labelled documents outside the held-out part (a documented bound, picked by
a hash of the id, so that both the sample and the model stay the same size at any input). Word counts that choose the
vocabulary are summed on Spark; the fit itself runs in one task over the sample's few vocabulary words. Scoring reads
every text whole.

Null and empty texts score as documents without sentences, 0. Rows without a label, or with a null one, aren't
learnt from; labels repeated for a document count once (the larger). With no labelled rows, or none of one class,
every score is 0. Extra columns are ignored; repeated rows keep a row each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcfacts.llm.base import held_out, text_pass
from srcfacts.session import cut

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
ENDS = bytes.maketrans(b"!?\n", b"...")
MOST_DOCS = 20_000
MOST_WORDS = 2048
LEAST_Z = 5.0
#: A document with this score or more is toxic.
THRESHOLD = 0.3


#: Lengths of the word beginnings that are features beside the words: compounds and inflections share them.
BEGINNINGS = (3, 4, 5, 6, 7, 8)


def features(words: set[str]) -> set[str]:
    """The words, and their beginnings marked by a star."""
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k}


def _sentences(text: str) -> int:
    return sum(1 for x in text.encode("utf-8", "surrogatepass").translate(ENDS).split(b".") if x and not x.isspace())


def labelled_sample(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """(doc_id, text, toxic) outside the held-out part, about ``most_docs`` rows at most."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = cut(known)
    share = min(1.0, most_docs / max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # the sample's bound is that of the broadcast


def _vocabulary(sample: DataFrame, most_words: int) -> dict[str, float]:
    """Features whose share of toxic documents differs most, by a two-proportion z of ``LEAST_Z`` or more, with half
    their log odds: where the fit starts. (Half, as a word brings its beginnings along.)"""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                total[int(toxic > 0)].update(features(set(WORD.findall((text or "").lower()))) | {""})
        words = list({**total[0], **total[1]})
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "clean": pa.array([total[0][w] for w in words], pa.int64()), "toxic": pa.array([total[1][w] for w in words], pa.int64())})

    counted = sample.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = cut(counted.where("clean + toxic >= 5"))
    whole = counted.where("word = ''").first()
    if whole is None or not whole.clean or not whole.toxic:
        return {}
    share = (F.col("clean") + F.col("toxic")) / (whole.clean + whole.toxic)
    z = (F.col("toxic") / whole.toxic - F.col("clean") / whole.clean) / F.sqrt(share * (1 - share) * (1 / whole.toxic + 1 / whole.clean))
    chosen = counted.where("word <> ''").withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(most_words)
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * (whole.clean / whole.toxic)) / 2
    return dict(sorted((r.word, r.odds) for r in chosen.select("word", odds.alias("odds")).collect()))


def _bags(text: str, number: dict[str, int]) -> list[list[int]]:
    """Vocabulary words of each sentence; sentences without a word are left out of the count too."""
    return [sorted(number[w] for w in features(set(WORD.findall(m[0].lower()))) if w in number) for m in SENTENCE.finditer(text) if not m[0].isspace()]


def _train(y: np.ndarray, plain: np.ndarray, doc: np.ndarray, starts: np.ndarray, words: np.ndarray, first: np.ndarray, rounds: int = 300, l2: float = 1e-5) -> np.ndarray:
    """Weights and, last, the bias. plain: sentences without vocabulary words per document; doc: document of each other
    sentence; words[starts[i]:]: its words. Adam on the mean log-likelihood of the noisy-or, from ``first`` on and held
    near it."""
    size, w = len(first), np.append(first, -8.0)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(words)]))
    for t in range(1, rounds + 1):
        u = w[-1] + (np.add.reduceat(w[words], starts) if len(starts) else np.empty(0))
        p, p0 = 1 / (1 + np.exp(-np.clip(u, -30, 30))), 1 / (1 + math.exp(-max(-30.0, min(30.0, w[-1]))))
        none = plain * math.log1p(-p0) + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))  # log prod (1 - p)
        q = np.clip(-np.expm1(none), 1e-12, 1)
        pull = (1 - y) - y * (1 - q) / q  # minus d loglik / d none
        gu = pull[doc] * p / len(y)
        g = np.append(np.bincount(words, gu[of], size) if len(words) else np.zeros(size), gu.sum() + (pull * plain).sum() * p0 / len(y))
        g[:-1] += l2 * (w[:-1] - first)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS, most_words: int = MOST_WORDS) -> tuple[dict[str, float], float]:
    """(word -> weight, bias); no words and -inf where nothing can be learnt."""
    sample = labelled_sample(docs, labels, most_docs)
    vocabulary = _vocabulary(sample, most_words)
    if not vocabulary:
        return {}, -math.inf
    number = {w: i for i, w in enumerate(vocabulary)}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = [int(t > 0) for t in b.column("toxic").to_pylist()]
            bags = [_bags(t or "", number) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": pa.array(toxic, pa.int32()), "plain": pa.array([sum(not s for s in d) for d in bags], pa.int32()), "bags": pa.array([[s for s in d if s] for d in bags], pa.list_(pa.list_(pa.int32())))})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"toxic": [], "plain": [], "bags": []})])
        y, plain, doc, starts, words = rows.toxic.to_numpy(float), rows["plain"].to_numpy(float), [], [], []
        for i, d in enumerate(rows.bags):
            for s in d:
                doc.append(i)
                starts.append(len(words))
                words += list(s)
        w = _train(y, plain, np.array(doc, int), np.array(starts, int), np.array(words, int), np.array(list(vocabulary.values())))
        yield pd.DataFrame({"k": np.arange(len(w)), "w": w})

    fitted = sample.mapInArrow(reduce, "toxic int, plain int, bags array<array<int>>").repartition(1).mapInPandas(learn, "k int, w double").collect()
    weights = {r.k: r.w for r in fitted}
    return {w: weights[i] for w, i in number.items()}, weights[len(vocabulary)]


def _logistic(u: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, u))))


HEAD = min(BEGINNINGS)


def heads_of(weights: dict[str, float]) -> frozenset[str]:
    """How words begin that have a feature with a weight: all others need no further look."""
    return frozenset(w[:HEAD] for w in weights)


def score(text: str, weights: dict[str, float], bias: float, heads: frozenset[str]) -> tuple[float, list[tuple[int, int, float]]]:
    """(document score, sentences that score ``THRESHOLD`` or more as (start, end, score)); heads: ``heads_of(weights)``."""
    if bias == -math.inf:
        return 0.0, []
    plain = math.log1p(-_logistic(bias))
    near = {w for w in set(WORD.findall(text.lower())) if w[:HEAD] in heads}
    if weights.keys().isdisjoint(features(near)):
        return -math.expm1(_sentences(text) * plain), []
    none, found = 0.0, []
    for m in SENTENCE.finditer(text):
        if m[0].isspace():
            continue
        held = features({w for w in WORD.findall(m[0].lower()) if w[:HEAD] in heads}) & weights.keys()
        if held:
            p = _logistic(bias + sum(weights[w] for w in sorted(held)))
            none += math.log1p(-min(p, 1 - 1e-12))
            if p >= THRESHOLD:
                found.append((*m.span(), p))
        else:
            none += plain
    return -math.expm1(none), found


FOUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def scored(docs: DataFrame, model: tuple[dict[str, float], float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score double, sentences array<struct<start,end,score>>) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((*model, heads_of(model[0])))  # at most MOST_WORDS words

    def run(texts: list[str]) -> list:
        found = [score(t, *shared.value) for t in texts]
        return [[s for s, _ in found], [[{"start": a, "end": b, "score": p} for a, b, p in x] for _, x in found]]

    return text_pass(docs, run, [T.StructField("score", T.DoubleType()), T.StructField("sentences", FOUND)], id_col, text_col, keep)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = scored(docs, fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.col("sentences.start").alias("offending_starts"))
