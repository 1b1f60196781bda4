"""The pipeline on the smallest tables, stage by stage, against plain Python."""

import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from latticeframe.llm.shared import written
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_copies", "secrets", "packing"]
    for df in outputs[1:-1]:
        assert df.dtypes == outputs[0].dtypes


def test_quality_drops_labelled_bad_documents_and_keeps_good_ones(spark, outputs):
    kept, labels = rows(outputs[1]), {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {i for i, r in labels.items() if r.quality == 1 and not r.toxic}
    bad = labels.keys() - good
    assert len(good - kept.keys()) <= 0.02 * len(good)
    assert len(bad & kept.keys()) <= 0.15 * len(bad)


def test_language_keeps_texts_with_words(outputs):
    before, after = rows(outputs[1]), rows(outputs[2])
    assert len(after) >= 0.98 * len(before)
    assert all(any(c.isalpha() for c in r.text) for r in after.values())


def test_one_of_each_group_of_near_copies(outputs):
    before, after = rows(outputs[2]), rows(outputs[3])
    sets = {i: shingles(r.text) for i, r in before.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(after) == {i for i in ids if find(i) == i}


def test_secrets_are_masked(outputs):
    before, after = rows(outputs[3]), rows(outputs[4])
    assert set(before) == set(after)
    assign = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, r in after.items():
        assert not any(len(m[1]) >= 8 for m in assign.finditer(r.text)) and not re.search("[0-9a-f]{32}|AKIA[A-Z0-9]{12}", r.text)
        assert r.n_chars == len(r.text)
        if "[SECRET]" not in r.text:
            assert r.text == before[i].text


def test_every_token_is_packed_once(outputs):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.no_truncation()
    pieces: dict = {}
    for r in outputs[5].collect():
        pieces.setdefault(r.doc_id, []).append(r)
    texts = rows(outputs[4])
    assert set(pieces) == set(texts)
    for i, found in pieces.items():
        ids = [*own.encode(texts[i].text, add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(found, key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_empty_documents(spark, outputs):
    docs = outputs[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "empty")
    assert docs.count() == 0


def test_odd_rows_and_names_that_clash(spark, outputs):
    """Nulls in any column, empty and very long texts, repeated rows, and columns named like helpers."""
    some = outputs[0].limit(40).selectExpr("*", "'a' AS row", "2 AS spans", "3 AS site", "4 AS _row", "5 AS `a.b`")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (900, "", "en", "web", 0), (901, " \n", None, None, None), (902, "word and more text of no kind " * 20_000, None, "web", 1), (903, None, "en", None, 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).selectExpr("*", "'a' AS row", "2 AS spans", "3 AS site", "4 AS _row", "5 AS `a.b`")
    docs = written(some.union(some.limit(3)).union(odd), "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), written(stage(spark, docs, SF), name)
        assert docs.columns == odd.columns and docs.count() <= before
        assert docs.filter("row <> 'a' OR spans <> 2 OR site <> 3 OR _row <> 4 OR `a.b` <> 5").count() == 0
    assert docs.filter("doc_id = 902").count() == 1
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_quality_and_language_equal_brute_force(spark, outputs):
    """The stages' decisions, made again from the fitted models in plain Python."""
    from latticeframe.llm.lang_id import LEAST_SCORE, fit_profiles, learnable
    from latticeframe.llm.quality import fit_classifier

    from test_quality import posteriors

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_classifier(outputs[0], labels)
    docs = outputs[0].collect()
    found = posteriors([(r.source or "", r.lang or "", model.evidence(r.text)) for r in docs], model.share)
    want = sorted(r.doc_id for r, (_, bad) in zip(docs, found, strict=True) if bad < 0.5)
    assert sorted(rows(outputs[1])) == want
    profiles = fit_profiles(learnable(outputs[1]))
    kept = [i for i, r in rows(outputs[1]).items() if profiles.predict(r.text)[0] != "und" and profiles.predict(r.text)[1] >= LEAST_SCORE]
    assert sorted(rows(outputs[2])) == sorted(kept)
