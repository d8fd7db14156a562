"""Quality, language and licenses against brute force, and their hard rows."""

import random
import re
import unicodedata  # noqa: F401

import numpy as np

from codestrata.llm import langid, licenses, quality

HARD = [(None, "a text without an id"), (None, None), (1, None), (2, ""), (3, " \n\t"), (4, "same words"), (4, "same words"), (4, "other words of the id"), (5, "z" * 2_000_000), (6, "word " * 400_000), (7, "12 -"), (8, "\x00é中🙂")]
DOC = "doc_id bigint, text string, score string, lang string, x int"


def hard(spark):
    return spark.createDataFrame([(d, t, "s", "aa", 1) for d, t in HARD], DOC)


def reference_scores(x, y, new):
    """Class densities by the textbook: full covariances, shrunk towards their mean variance, solved anew for each row."""
    n, d = x.shape
    scale = x.std(0)
    scale[scale < 1e-4] = 1e-4
    density = []
    for k in (0, 1):
        own = x[y == k] / scale
        mean, s = own.mean(0), np.cov(own.T, bias=True)
        mu = np.trace(s) / d
        a, b = (1 - 2 / d) * (s**2).sum() + np.trace(s) ** 2, (len(own) + 1 - 2 / d) * ((s**2).sum() - np.trace(s) ** 2 / d)
        rho = min(1.0, a / b) if b > 0 else 1.0
        c = (1 - rho) * s + (rho * mu + 1e-3) * np.eye(d)
        z = new / scale - mean
        density.append(np.log(len(own) / n) - 0.5 * (np.linalg.slogdet(c)[1] + np.einsum("ij,ji->i", z, np.linalg.solve(c, z.T))))
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30)))


def test_quality_equals_a_plain_quadratic_discriminant(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score(docs.repartition(7), labels).collect()}
    x = {r.doc_id: quality.statistics(r.text) for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in got and not got[r.doc_id].held_out}
    ids = sorted(x)
    want = reference_scores(np.array([x[i] for i in y]), np.array(list(y.values())), np.array([x[i] for i in ids]))
    assert np.allclose([got[i].score for i in ids], want, atol=2e-3)
    again = {r.doc_id: r.score for r in quality.score(docs.repartition(3), labels).collect()}
    assert all(again[i] == got[i].score for i in ids)  # whatever the order of tasks


def test_quality_of_hard_rows(spark, sf):
    labels = spark.createDataFrame([(4, 1), (4, 0), (2, 0), (3, 0), (6, None), (99, 1)], "doc_id bigint, quality int")
    got = quality.score(hard(spark), labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in HARD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    same = [r.score for r in got if r.doc_id == 4]
    assert len(same) == 3 and len(set(same)) <= 2
    assert quality.score(hard(spark).limit(0), labels).count() == 0


def grams_of(text):
    """n-grams over lower-cased letters and single gaps."""
    low = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    low = re.sub(" +", " ", low)
    return [low[i : i + langid.N] for i in range(len(low) - langid.N + 1)]


def test_language_equals_exact_sets(spark):
    """The filters against the very sets of n-grams that they hold."""
    r = random.Random(4)
    sound = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ver", "to"], "cc": ["eau", "é", "tion", "ra"], "dd": ["ка", "то", "ми"]}
    rows = []
    for i in range(400):
        lang = sorted(sound)[i % 4]
        rows.append((i, " ".join("".join(r.choice(sound[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 60))), lang))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(langid.train_rows(docs), docs_per_lang=10**9, grams_per_lang=150)
    folds = {x.doc_id for x in langid.train_rows(docs).collect()}
    sets = {}
    for lang in sound:
        counts = {}
        for i, t, own in rows:
            if own == lang and i in folds:
                for g in grams_of(t):
                    counts[g] = counts.get(g, 0) + 1
        least = sorted(counts.values(), reverse=True)[:150][-1]
        sets[lang] = ({g for g, n in counts.items() if n > least}, {g for g, n in counts.items() if n >= least})  # ties at the bound go by hash
    got = {x.doc_id: x for x in langid.predict(docs, model).collect()}
    agree = 0
    for i, t, _ in rows:
        g = grams_of(t)
        low, high = ([sum(x in sets[lang][k] for x in g) for lang in model.langs] for k in (0, 1))
        best = max(range(4), key=lambda k: (high[k], -k))
        clear = all(k == best or low[best] - high[k] > 2 for k in range(4))
        agree += got[i].lang_pred == model.langs[best] or not clear
        if clear:
            assert low[best] / max(1, sum(high)) - 0.05 <= got[i].score <= high[best] / max(1, sum(low)) + 0.05
    assert agree == len(rows)


def test_language_of_hard_rows(spark):
    docs = hard(spark)
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in HARD)
    of = {r.doc_id: r.lang_pred for r in got if r.doc_id is not None}
    assert [of[k] for k in (1, 2, 3, 7)] == ["und"] * 4 and [of[k] for k in (4, 5, 6, 8)] == ["aa"] * 4
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == 7
    assert langid.predict(docs.limit(0), model).count() == langid.keep_known(docs.limit(0), model).count() == 0


def test_many_languages_do_not_stop_a_fit(spark):
    rows = [(i, chr(0x4E00 + 7 * (i % 70)) * 3 + " " + chr(0x4E00 + 7 * (i % 70) + 1) * 5, f"l{i % 70:02}") for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert all(r.lang_pred == f"l{r.doc_id % 70:02}" for r in got)


def places_of(text, least=licenses.LEAST):
    """(license, part, first word, share) at every alignment of every template, by sets of word shingles."""
    w = licenses.words(text)
    s = list(zip(*(w[k:] for k in range(licenses.K))))
    out = []
    for name, texts in licenses.TEMPLATES.items():
        for part, t in enumerate(texts):
            own = licenses.words(t)
            m = len(own) - licenses.K + 1
            wanted = set(zip(*(own[k:] for k in range(licenses.K))))
            for a in range(max(1, len(s) - m + 1)):
                share = len(wanted & set(s[a : a + m])) / len(wanted)
                if share >= least:
                    out.append((name, part, a, share))
    return out


def test_licenses_equal_brute_force(spark):
    r = random.Random(30)
    filler = lambda n: [f"f{r.randrange(900)}" for _ in range(n)]
    every = [t for texts in licenses.TEMPLATES.values() for t in texts]
    rows = []
    for i in range(150):
        w = r.choice(every).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3]) * max(1, len(w) // 60)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], ["changed"], [w[k], "added"]])
        rows.append((i, " ".join([*filler(r.randint(0, 90)), *w, *filler(r.choice([0, 0, 3, 40]))])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {}
    for x in licenses.scan(docs).collect():
        got.setdefault(x.doc_id, []).append(x)
    found = total = 0
    for i, t in rows:
        want = places_of(t)
        for x in got.get(i, []):
            assert any((n, p, a) == (x.license, x.part, x.start) and abs(s - x.share) < 1e-9 for n, p, a, s in want)
        if want:  # the place with the largest share of the longest template overlaps a place found
            total += 1
            n, p, a, s = max(want, key=lambda y: y[3])
            found += any(abs(x.start - a) <= len(t.split()) and x.start <= a + len(licenses.words(licenses.TEMPLATES[n][p])) and x.end >= a for x in got.get(i, []))
    assert total > 80 and found >= 0.99 * total


def test_licenses_of_hard_rows(spark):
    notice = licenses.TEMPLATES["Apache-2.0"][3]
    rows = [(None, notice), (4, notice), (4, notice), (9, "word " * 100_000 + notice + " word" * 100_000)]
    docs = hard(spark).select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = licenses.scan(docs).collect()
    assert sorted((str(x.doc_id), x.license) for x in got) == [("4", "Apache-2.0"), ("4", "Apache-2.0"), ("9", "Apache-2.0"), ("None", "Apache-2.0")]
    assert licenses.scan(docs.limit(0)).count() == 0
