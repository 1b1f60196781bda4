import itertools
import random
import re

import pytest
from latticeframe.llm.ngram_join import CountTree, count_vector, counts_of, fold, ngram_components, ngram_links, without_near_copies


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_force(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


def make(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n\t", "one two", "ONE  two", "a b c d e", "A B\nC D E"]
    passage = [rng.choice(words) for _ in range(60)]
    for _ in range(60):
        body = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        if rng.random() < 0.4:  # a passage that many share
            body = passage + body
        texts.append(" ".join(body))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(body)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    base = [rng.choice(words) for _ in range(80)]
    for _ in range(60):  # a chain, each a little further from the first
        texts.append(" ".join(base))
        base[rng.randrange(80)] = rng.choice(words)
    texts += [texts[20]] * 30 + [" ".join(passage)] * 5
    texts.append(" ".join(rng.choice(words) for _ in range(20_000)))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    texts = make(seed)
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_shingles int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_force(texts)


def test_chunks_of_large_blocks_lose_no_link(spark, monkeypatch):
    from latticeframe.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", 6)
    texts = make(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_force(texts)


def test_bound_never_loses_a_link():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(5, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[: int(len(a) * 0.9)], rng.integers(0, 2**63, max(1, n // 20)).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        u, v = (counts_of(count_vector(x)) for x in (a, b))
        lost = [len(a) - int(u.sum(dtype=int)), len(b) - int(v.sum(dtype=int))]
        g = min(len(u), len(v))
        assert np.minimum(fold(u, g), fold(v, g)).sum(dtype=int) + sum(lost) >= both
        if 100 * both >= 75 * (len(a) + len(b) - both):
            tree = CountTree(fold(u, g)[None].astype(np.int32), np.array([len(a)]))
            assert tree.search(fold(v, g), len(b), 75, sum(lost)).tolist() == [0]


def test_one_document_of_each_group_stays(spark):
    texts = make(4)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b c d e", "y")], "doc_id long, text string, component_id string")
    left = without_near_copies(docs)
    assert left.columns == docs.columns
    want = {i for i, (_, c) in enumerate(brute_force(texts)) if i == c} | {None}
    assert {r.doc_id for r in left.collect()} == want


def test_small_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words that are not alike"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (1, 2, 1), (3, 2, 1), (None, 2, None), (None, 0, None)], key=str)
    assert ngram_components(docs.limit(0)).count() == 0
    members, links = ngram_links(docs.limit(0))
    assert members.count() == links.count() == 0


def test_an_id_repeated_with_other_texts_is_one_node(spark):
    x = [f"x{i}" for i in range(40)]
    y, z = [f"y{i}" for i in range(40)], [f"z{i}" for i in range(40)]
    near = lambda words: " ".join([*words[:38], "other", "end"])
    rows = [(7, " ".join(x)), (7, " ".join(y)), (3, " ".join(y)), (9, near(x)), (8, " ".join(x)), (7, " ".join(z)), (11, near(z)), (20, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_components(docs).collect()}
    assert got == {7: 3, 3: 3, 9: 3, 8: 3, 11: 3, 20: 20}
