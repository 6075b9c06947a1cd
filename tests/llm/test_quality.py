import math
import random
import re
from collections import Counter

import numpy as np

from srcfacts.llm import quality as Q
from srcfacts.llm.quality_stats import counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice(["a ", "b ", "é ", "c\n", "#", " ", "\n", "x\x1cy ", " ", "日\t", "<b> "]) for _ in range(rng.randint(0, 60)))
        assert counts(t)[:5] == brute(t), t
    many = " ".join(str(i) for i in range(9000)) + " 5 6 7 8 9 10"
    assert counts(many)[4] == brute(many)[4]


def test_outliers_per_group(spark):
    rng = random.Random(3)

    def text(lang, junk):
        size = 4 if lang == "xx" else 7
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(size - 2, size + 2))) for _ in range(rng.randint(60, 400))]
        return "\n".join(" ".join((w + "%%%" if junk else w) for w in words[i : i + 20]) for i in range(0, len(words), 20))

    rows = [(i, text("xx" if i % 2 else "yy", i % 10 == 0), "xx" if i % 2 else "yy", f"s{i % 3}") for i in range(900)]
    rows += [(900, None, None, None), (901, "", "xx", "s0"), (902, "one two", "zz", "rare")]
    got = {r.doc_id: r for r in Q.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == 903 and not any(got[i].kept for i in range(0, 900, 10)) and not any(got[i].kept for i in (900, 901, 902))
    assert sum(not got[i].kept for i in range(900) if i % 10) <= 3


def vectors(row):
    n, chars, symbols, _, _, distinct, lines = row
    return [math.asinh(100 * symbols / max(chars, 1)), math.log((chars + 250) / (n + 50)), math.log(distinct + 50) / math.log(n + 50), math.log((n + 40) / (lines + 1))]


def plain_distances(keys, x, h=0.75, prior=Q.ROWS_PER_STATISTIC * Q.P):
    """The whole method in numpy: keys (language, source), x the transformed statistics."""
    groups = {k: np.array([i for i, q in enumerate(keys) if q == k]) for k in set(keys)}
    langs = {k[0] for k in groups}
    floor = np.diag(np.square(Q.FLOOR))

    def moments(rows):
        return x[rows].sum(axis=0), x[rows].T @ x[rows], len(rows)

    def estimates(parts):
        sums = {g: moments(rows) for g, rows in parts.items()}
        add = lambda gs: tuple(sum(sums[g][i] for g in gs) for i in range(3))
        top = add(sums)
        top = top[0] / top[2], top[1] / top[2]
        out = {}
        for lang in langs:
            s = add([g for g in sums if g[0] == lang])
            mid = (s[0] + prior * top[0]) / (s[2] + prior), (s[1] + prior * top[1]) / (s[2] + prior)
            for g in sums:
                if g[0] == lang:
                    a, b, n = sums[g]
                    mean = (a + prior * mid[0]) / (n + prior)
                    out[g] = mean, (b + prior * mid[1]) / (n + prior) - np.outer(mean, mean) + floor
        return out

    def bins(g, est):
        d = x[groups[g]] - est[0]
        d2 = np.einsum("ij,jk,ik->i", d, np.linalg.inv(est[1]), d)
        return d2, np.floor(Q.BINS_PER_DOUBLING * np.log2(np.maximum(d2, 1e-9))).astype(int)

    def edge(counts):
        run = 0.0
        for b in sorted(counts):
            run += counts[b]
            if run >= h * sum(counts.values()) * (1 - 1e-12):
                return b

    starts = [{}, estimates(groups)]
    for lang in langs:
        rows = np.concatenate([r for g, r in groups.items() if g[0] == lang])
        low, mid, high = (np.array([np.sort(x[rows, c])[max(0, math.ceil(p * len(rows)) - 1)] for c in range(Q.P)]) for p in (0.25, 0.5, 0.75))
        for g in groups:
            if g[0] == lang:
                starts[0][g] = mid, np.diag(np.square(np.maximum((high - low) / 1.349, Q.FLOOR)))
    for s in (0, 1):
        for _ in range(Q.STEPS):
            parts = {}
            for g, rows in groups.items():
                b = bins(g, starts[s][g])[1]
                parts[g] = rows[b <= edge(Counter(b.tolist()))]
            starts[s] = estimates(parts)
    best = {g: min((starts[s][g] for s in (0, 1)), key=lambda e: np.linalg.slogdet(e[1])[1]) for g in groups}
    own = {g: Counter(bins(g, best[g])[1].tolist()) for g in groups}
    every = sum(own.values(), Counter())
    share = lambda c: {b: v / sum(c.values()) for b, v in c.items()}
    plus = lambda c, more: {b: c.get(b, 0) + prior * more.get(b, 0) for b in {*c, *more}}
    out = np.zeros(len(x))
    for g, rows in groups.items():
        lang = share(plus(sum((own[k] for k in groups if k[0] == g[0]), Counter()), share(every)))
        scale = Q.chi2_quantile(h) / 2 ** ((edge(plus(own[g], lang)) + 1) / Q.BINS_PER_DOUBLING)
        out[rows] = bins(g, best[g])[0] * scale
    return out


def test_whole_verdict_against_plain(spark):
    """Groups of 5 to 200 rows, each with an estimate of its own."""
    rng = random.Random(6)
    rows = []
    for lang, source, n in [("aa", "s0", 200), ("aa", "s1", 60), ("aa", "s2", 5), ("bb", "s0", 90), ("bb", None, 12), (None, "s0", 7)]:
        for _ in range(n):
            size = rng.randint(3, 6) + (2 if source == "s1" else 0)
            words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(size - 2, size + 2))) for _ in range(rng.randint(12, 120))]
            words = [w + "#$%" if rng.random() < (0.5 if rng.random() < 0.1 else 0.01) else w for w in words]
            rows.append((len(rows), "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)), lang, source))
    got = {r.doc_id: r for r in Q.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    x = np.array([vectors(counts(r[1])) for r in rows])
    wanted = plain_distances([(r[2] or "\0", r[3] or "\0") for r in rows], x)
    cut = Q.chi2_quantile(1 - 1e-9)
    assert np.allclose([got[i].d2 for i in range(len(rows))], wanted, rtol=1e-6)
    for i, r in enumerate(rows):
        n, _, _, _, repeated = brute(r[1])
        failed = n < 10 or 100 * repeated > 20 * n
        assert got[i].base_failed == failed and got[i].kept == (not failed and wanted[i] <= cut)
        assert abs(got[i].own_share - sum(q[2:] == r[2:] for q in rows) / (sum(q[2:] == r[2:] for q in rows) + 48)) < 1e-9


def test_empty(spark):
    assert Q.verdicts(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
