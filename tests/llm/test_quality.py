import math
import random

import pytest
from latticeframe.llm.quality import STRENGTH, document_evidence, fit_classifier, judge, kept_documents, site_posteriors, surface
from pyspark.sql import functions as F


def documents(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(2000)]
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        kind = rng.choices(["good", "junk", "toxic"], [0.8, 0.1, 0.1])[0]
        if kind == "junk":
            body = [w + rng.choice(["###", "$$$", "%%%"]) for w in body]
        if kind == "toxic":
            body[rng.randrange(len(body))] = rng.choice(["nastyword", "nastiness", "vilethings"])
        host = "big" if rng.random() < 0.4 else f"h{rng.randrange(30)}"
        yield i, " ".join(body), host, rng.choice("xy"), int(kind != "junk"), int(kind == "toxic")


@pytest.fixture(scope="module")
def tables(spark):
    rows = list(documents(3, 1500))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[4], r[5]) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = judge(docs, labels.filter("doc_id % 4 <> 2")).join(labels, "doc_id").filter("doc_id % 4 = 2")
    wrong = got.filter(F.col("keep") != ((F.col("quality") == 1) & (F.col("toxic") == 0))).count()
    assert wrong <= 0.02 * got.count()
    assert kept_documents(docs, labels).columns == docs.columns


def test_fit_on_a_bounded_part(tables):
    docs, labels = tables
    model = fit_classifier(docs, labels, fit_rows=500)
    assert model.lexicon and model.evidence("vilethings here") > model.evidence("other words here") and model.evidence(None) == 0.0


def test_sparse_sites_shrink_to_their_host(spark):
    rows = [("good", "a", -4.0)] * 200 + [("bad", "a", 4.0)] * 200 + [("bad", "b", 0.0), ("new", "a", 0.0)]
    table = spark.createDataFrame(rows, "host string, path string, evidence double")
    got = site_posteriors(table.select(F.struct("host", "path", "evidence").alias("site")), 0.3).select("site.*")
    rate = {(r.host, r.path): r.path_rate for r in got.collect()}
    assert rate["good", "a"] < 0.1 < 0.9 < rate["bad", "a"]
    assert rate["bad", "b"] > 0.7  # one document of a bad host
    assert 0.2 < rate["new", "a"] < 0.8  # a host of its own: near the global rate


def test_nulls_and_empty_tables(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(None, None, None, None), (1, "", "big", None), (1, "", "big", None), (2, "###" * 100_000, None, "x")], docs.schema)
    assert judge(odd, labels).count() == 4
    assert judge(odd.limit(0), labels).count() == 0
    assert judge(odd, labels.limit(0)).filter("keep").count() == 4
    nothing = spark.createDataFrame([(None, None, None), (1, None, None)], labels.schema)
    assert judge(odd, nothing).filter("keep").count() == 4
    assert len(surface("")) == len(surface("A b! c|d 1.\n\nA b"))


def posteriors(rows, share):
    """The site model in plain Python, over (host, path, evidence)."""
    own = [1 / (1 + math.exp(-(e + math.log(share / (1 - share))))) for _, _, e in rows]
    hosts, paths = {}, {}
    for (h, p, _), x in zip(rows, own, strict=True):
        for table, key in ((hosts, h), (paths, (h, p))):
            n, bad = table.get(key, (0, 0.0))
            table[key] = n + 1, bad + x
    overall = (sum(own) + share) / (len(own) + 1)

    def strength(groups):  # (n, rate, center)
        spread = sum(n * (r - c) ** 2 for n, r, c in groups)
        between = (spread - sum(c * (1 - c) for _, _, c in groups)) / len(rows)
        whole = sum(n * c * (1 - c) for n, _, c in groups)
        return STRENGTH[1] if between <= 0 else min(max(whole / len(rows) / between - 1, STRENGTH[0]), STRENGTH[1])

    k_host = strength([(n, b / n, overall) for n, b in hosts.values()])
    shrunk = {h: (k_host * overall + b) / (k_host + n) for h, (n, b) in hosts.items()}
    k_path = strength([(n, b / n, shrunk[h]) for (h, _), (n, b) in paths.items()])
    out = []
    for (h, p, e), x in zip(rows, own, strict=True):
        host = (k_host * overall + hosts[h][1] - x) / (k_host + hosts[h][0] - 1)
        rate = (k_path * host + paths[h, p][1] - x) / (k_path + paths[h, p][0] - 1)
        rate = min(max(rate, 1e-4), 1 - 1e-4)
        out.append((rate, 1 / (1 + math.exp(-(e + math.log(rate / (1 - rate)))))))
    return out


def test_posteriors_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", "c", f"h{rng.randrange(40)}"]), rng.choice("xyz"), rng.gauss(-1, 3)) for _ in range(600)] + [("alone", "", 0.5)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, host string, path string, evidence double").repartition(5)
    for share in (0.05, 0.4):
        got = {r.id: (r.path_rate, r.bad) for r in site_posteriors(table.select("id", F.struct("host", "path", "evidence").alias("site")), share).select("id", "site.*").collect()}
        for i, want in enumerate(posteriors(rows, share)):
            assert got[i] == pytest.approx(want, rel=1e-9)


def test_judgement_equals_brute_force(spark, tables):
    docs, labels = tables
    model = fit_classifier(docs, labels)
    rows = docs.collect()
    want = posteriors([(r.source, r.lang, model.evidence(r.text)) for r in rows], model.share)
    got = {r.doc_id: r for r in judge(docs, labels).collect()}
    for r, (rate, bad) in zip(rows, want, strict=True):
        assert (got[r.doc_id].path_rate, got[r.doc_id].bad) == pytest.approx((rate, bad), rel=1e-9)
        assert got[r.doc_id].keep == (bad < 0.5)
    assert {r.doc_id for r in kept_documents(docs, labels).collect()} == {i for i, r in got.items() if r.keep}


def test_kept_rows_keep_names_that_clash(spark, tables):
    docs, labels = tables
    more = docs.selectExpr("*", "doc_id AS _row", "'r' AS row", "1 AS site", "2 AS host", "3 AS path", "4 AS _host", "5 AS `a.b`")
    kept = kept_documents(more, labels)
    assert kept.columns == more.columns and kept.count() == kept_documents(docs, labels).count()
    assert kept.filter("_row <> doc_id OR row <> 'r' OR _host <> 4").count() == 0
    assert document_evidence(more, fit_classifier(docs, labels)).count() == more.count()
