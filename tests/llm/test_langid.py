import math
import random

import numpy as np

from srcfacts.llm import langid


def plain_symbols(text, letters):
    out = [0] * (langid.ORDER - 1)
    body = []
    for c in text:
        low = c if c in letters else next((x for x in letters if x.upper() == c), None)
        s = letters.index(low) + 2 if low else int(c.isalpha())
        if s or (body and body[-1]):
            body.append(s)
    return out + body


def brute_model(texts_by_lang, letters):
    """Plain dictionaries: interpolated Kneser-Ney, as in the textbooks."""
    models = {}
    for lang, texts in texts_by_lang.items():
        top = {}
        for t in texts:
            s = plain_symbols(t, letters)
            for i in range(langid.ORDER, len(s) + 1):
                g = tuple(s[i - langid.ORDER : i])
                top[g] = top.get(g, 0) + 1
        levels = {langid.ORDER: top}
        for n in range(langid.ORDER - 1, 0, -1):
            low = {}
            for g in levels[n + 1]:
                low[g[1:]] = low.get(g[1:], 0) + 1
            levels[n] = low
        models[lang] = levels

    def prob(levels, g):
        if not g:
            return 1 / 7
        c = levels[len(g)]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.95)
        same = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
        under = prob(levels, g[1:])
        if not same:
            return under
        total = sum(same.values())
        return max(c.get(g, 0) - d, 0) / total + d * len(same) / total * under

    return models, prob


def test_matches_plain_kneser_ney():
    rng = random.Random(5)
    texts = {"aa": ["".join(rng.choice("abé .") for _ in range(40)) for _ in range(6)], "bb": ["".join(rng.choice("bcd1\n") for _ in range(40)) for _ in range(6)]}
    letters = "abcdé"
    langs = sorted(texts)
    grams = []
    for lang in langs:
        code, starts = langid.encode(texts[lang], letters)
        keys, n = np.unique(langid.grams(code, langid.ORDER)[langid._positions(code, starts)[langid.ORDER - 1 :]], return_counts=True)
        grams.append(langid._kneser_ney(keys, n, len(letters) + 2))
    model = langid.Model(langs, letters, grams, np.full(2, np.inf))
    models, prob = brute_model(texts, letters)
    asked = ["Abé bad", "", "123", "  dcb zß", "a", "cab\n\ndab. ", "ÉÉ"]
    got, n = langid.cross_entropies(model, asked)
    for row, text in enumerate(asked):
        s = plain_symbols(text, letters)
        assert n[row] == sum(c.isalpha() for c in text)
        for k, lang in enumerate(langs):
            logs = [-math.log(prob(models[lang], tuple(s[i - langid.ORDER : i]))) for i in range(langid.ORDER, len(s) + 1)]
            if logs:
                assert abs(got[row, k] - sum(logs) / len(logs)) < 1e-9, text


def test_batch_has_no_effect():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abz .\n9") for _ in range(rng.randint(0, 30))) for _ in range(50)]
    code, starts = langid.encode(texts, "ab")
    for i, t in enumerate(texts):
        end = starts[i + 1] - 3 if i + 1 < len(texts) else len(code)
        alone, s = langid.encode([t], "ab")
        assert list(code[starts[i] : end]) == list(alone[s[0] :]), (i, t)


def test_every_letter_keeps_its_identity(spark):
    """Languages in scripts of hundreds of letters, beside Latin, Greek and Cyrillic ones."""
    rng = random.Random(9)
    scripts = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "en": "abcdefghijklmnopqrstuvwxyz", "h1": "".join(chr(0x4E00 + 2 * i) for i in range(300)), "h2": "".join(chr(0x4E01 + 2 * i) for i in range(300)), "g1": "".join(chr(0x20000 + i) for i in range(200))}
    rows = [(i, "".join(rng.choice(scripts[x]) + " " * (rng.random() < 0.2) for _ in range(60)), x) for i in range(360) for x in [sorted(scripts)[i % 6]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.letters) == sum(len(s) for s in scripts.values())
    assert [r.lang_pred for r in langid.predict(df, model).orderBy("doc_id").collect()] == [x for _, _, x in rows]
