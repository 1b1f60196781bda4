import random
from collections import Counter

import numpy as np
from latticeframe.llm.lang_id import fit_profiles, grams, identify, kept_languages, language_profiles, learnable, top_grams
from pyspark.sql import functions as F

SYLLABLES = {"aa": ["ko", "ta", "ri", "mu"], "bb": ["sch", "ei", "über", "n"], "cc": ["ción", "el", "ro", "que"]}


def texts(seed, n):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        yield i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))), lang


def slow_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return Counter()
    line = " " + " ".join(words) + " "
    out = Counter()
    for i in range(len(line)):
        if line[i] != " ":
            out[line[i]] += 1
    for i in range(len(line) - 1):
        out[line[i : i + 2]] += 1
    for i in range(len(line) - 2):
        if line[i + 1] != " ":
            out[line[i : i + 3]] += 1
    return out


def test_grams_equal_brute_force():
    for text in ["", "12 !", "a", "Ab, c!", "éü  ß\n\nx", " lead and trail ", "1a2b3"]:
        got = Counter(grams(text).tolist())
        code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (2 - k) for k, c in enumerate(g))
        assert got == Counter({code(g): n for g, n in slow_grams(text).items()}), text


def test_top_grams_break_ties_by_code():
    codes = np.sort(np.array([5] * 3 + [7] * 3 + [1] * 2 + list(range(100, 900)), np.uint64))
    assert top_grams(codes, 4).tolist() == [5, 7, 1, 100]


def test_profiles_and_held_out_accuracy(spark):
    rows = list(texts(1, 400))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    profiles = {(r.lang, r.gram): r.place for r in language_profiles(docs, 50).collect()}
    for lang in SYLLABLES:
        total = Counter()
        for _, t, other in rows:
            if other == lang:
                total.update(grams(t).tolist())
        want = sorted(total, key=lambda g: (-total[g], g))[:50]
        assert [g for _, g in sorted((p, g) for (x, g), p in profiles.items() if x == lang)] == want
    found = identify(docs, fit_profiles(learnable(docs))).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.filter(F.col("lang_pred") == F.col("lang")).count() > 390
    assert found.filter(~F.col("score").between(0, 1)).count() == 0


def test_nulls_and_empty_tables(spark):
    rows = [(1, None, "aa", "x"), (2, "", "aa", "x"), (3, "12 !", None, "x"), (None, "ko ta ri", "aa", "x"), (5, "ko ta mu ri", "aa", "x"), (6, "ko " * 200_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, fit_profiles(docs)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[None][0] == got[5][0] == got[6][0] == "aa"
    nothing = fit_profiles(docs.limit(0))
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}
    assert identify(docs.limit(0), nothing).count() == 0
    kept = kept_languages(docs, fit_profiles(docs))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 5, 6}


def test_without_a_learned_language_texts_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !", None), (3, "", None), (4, None, None), (5, "é", None)], "doc_id long, text string, lang string")
    rows = kept_languages(docs, fit_profiles(docs)).collect()
    assert sorted(r.doc_id for r in rows) == [1, 5]


def test_predictions_equal_brute_force(spark):
    rows = list(texts(3, 60)) + [(60, "ko", "aa"), (61, "zzz qqq", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = 40
    lists = {}
    for r in language_profiles(docs, size).collect():
        lists.setdefault(r.lang, {})[r.gram] = r.place
    for r in identify(docs, fit_profiles(docs, size)).collect():
        count = Counter(grams(rows[r.doc_id][1]).tolist())
        own = sorted(count, key=lambda g: (-count[g], g))[:size]
        distance = {lang: sum(abs(known[g] - i) if g in known else size for i, g in enumerate(own)) for lang, known in lists.items()}
        best = min(distance, key=lambda lang: (distance[lang], lang))
        assert r.lang_pred == best and abs(r.score - (1 - distance[best] / size / len(own))) < 1e-12


def test_kept_rows_keep_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "ko ta ri", "aa", 1, "r", 2.0), (2, "12", "aa", 2, "s", None), (None, "ko ta ri", "aa", 3, None, None)], "doc_id long, text string, lang string, `_row` int, `row` string, `a.b` double")
    kept = kept_languages(docs, fit_profiles(docs))
    assert kept.columns == docs.columns
    assert sorted(tuple(r)[3:] for r in kept.collect()) == [(1, "r", 2.0), (3, None, None)]
