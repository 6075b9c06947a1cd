import math
import random

import numpy as np

from pyspark.sql import functions as F

from srcfacts.llm import toxicity as X


def test_score_is_the_noisy_or_of_sentences():
    weights, bias = {"bad": 6.0, "awf*": 5.0}, -6.0
    text = "Fine here. Bad one! This is awful.\n \nend"
    p = [1 / (1 + math.exp(-u)) for u in (-6, 0, -1, -6)]
    got, found = X.score(text, weights, bias, X.heads_of(weights))
    assert abs(got - (1 - math.prod(1 - x for x in p))) < 1e-12
    assert [text[a:b] for a, b, _ in found] == [" Bad one"]
    assert X.score("", weights, bias, X.heads_of(weights)) == (0.0, [])
    assert X.score("x", {}, -math.inf, frozenset())[0] == 0.0


def _corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        parts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(6)) for _ in range(rng.randint(1, 8))]
        if toxic:
            parts.insert(rng.randrange(len(parts) + 1), "you " + rng.choice(["zork", "zorkish", "quux"]) + " " + parts[0][:5])
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learns_from_document_labels_and_finds_sentences(spark):
    rows, labels = _corpus(1500, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = X.fit(docs, known)
    truth = {i: t for i, _, t in labels}
    held = {r.doc_id for r in docs.where(X.held_out()).select("doc_id").collect()}
    got = X.scored(docs, model).collect()
    wrong = sum((r.score >= X.THRESHOLD) != bool(truth[r.doc_id]) for r in got if r.doc_id in held)
    assert len(held) > 300 and wrong <= 0.02 * len(held)
    texts = dict(rows)
    for r in got:
        for s in r.sentences:
            assert "zork" in texts[r.doc_id][s.start : s.end] or "quux" in texts[r.doc_id][s.start : s.end]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a", 1.0), (1, None, 2.0), (None, "", None)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in X.scored(docs, X.fit(docs, none)).collect()] == [0.0] * 3
    assert X.scored(docs.limit(0), X.fit(docs.limit(0), none)).count() == 0


def plain_train(docs, first, rounds, l2):
    """docs: (label, sentences of word lists); loops over documents, sentences and words: Adam on the noisy-or likelihood."""
    w, size = [*first, -8.0], len(first)
    m, v = [0.0] * (size + 1), [0.0] * (size + 1)
    for t in range(1, rounds + 1):
        g = [0.0] * (size + 1)
        for y, sentences in docs:
            p = [1 / (1 + math.exp(-(w[-1] + sum(w[k] for k in s)))) for s in sentences]
            q = 1 - math.prod(1 - x for x in p)
            for x, s in zip(p, sentences, strict=True):
                # d loglik / d score, with q' = (1 - q) x: label 1 gives q'/q, label 0 gives -x
                slope = (1 - q) / q * x if y else -x
                for k in [*s, size]:
                    g[k] -= slope / len(docs)
        for k in range(size):
            g[k] += l2 * (w[k] - first[k])
        for k in range(size + 1):
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            w[k] -= 0.05 * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
    return w


def test_fit_against_plain_loops():
    rng = random.Random(3)
    first = [rng.uniform(-1, 3) for _ in range(6)]
    docs = [(rng.randint(0, 1), [sorted(rng.sample(range(6), rng.randint(0, 3))) for _ in range(rng.randint(1, 5))]) for _ in range(40)]
    y, plain, doc, starts, words = [], [], [], [], []
    for i, (label, sentences) in enumerate(docs):
        y.append(label)
        plain.append(sum(not s for s in sentences))
        for s in filter(None, sentences):
            doc.append(i)
            starts.append(len(words))
            words += s
    got = X._train(np.array(y, float), np.array(plain, float), np.array(doc), np.array(starts), np.array(words), np.array(first), rounds=30, l2=1e-3)
    assert np.allclose(got, plain_train(docs, first, 30, 1e-3), atol=1e-6)


def test_very_long_and_odd_texts(spark):
    long = "fine words here. " * 60_000 + "you zork. " + "x" * 300_000
    docs = spark.createDataFrame([(1, long), (2, None), (3, ""), (None, "zork"), (1, long)], "doc_id long, text string").withColumn("sentences", F.lit(1))
    got = X.scored(docs, ({"zork": 9.0}, -6.0)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert [len(r.sentences) for r in got if r.doc_id == 1] == [1, 1] and {r.score for r in got if r.doc_id in (2, 3)} == {0.0}
