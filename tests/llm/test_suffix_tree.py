import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from latticeframe.llm import suffix_tree
from latticeframe.llm.suffix_tree import DEPTH, SYMBOLS, SuffixTree, _stream, byte_scores, corpus_counts, fit_tree, score_texts
from latticeframe.llm.shingles import mix, word_hashes
from pyspark.sql import functions as F


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})), None]


def make(seed, n):
    rng = random.Random(seed)
    parts = [["tion", "ing", "the", "er", "ou"], ["é", "ñ", "st", "ue", "lla"]]
    often = [["of", "the", "and"], ["de", "la", "que"]]
    out = []
    for _ in range(n):
        k = rng.randrange(2)
        word = lambda k=k: rng.choice(often[k]) if rng.random() < 0.5 else "".join(rng.choices(parts[k], k=rng.randrange(1, 4)))
        out.append(" ".join(word() for _ in range(rng.randrange(0, 80))))
    return out


@pytest.fixture(scope="module")
def texts():
    return [None, "", " \n", "The THE\tthe\x0bx", "<|x|>\x00\x01", "a" * 100_000, *make(1, 400)]


def test_base_scores_equal_brute_force_and_the_model_beats_them(spark, texts):
    docs = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(4)
    train = docs.filter("doc_id % 10 <> 6")
    count = Counter(w for i, t in enumerate(texts) if i % 10 != 6 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    rows = score_texts(docs, train).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        own = tokens(texts[r.doc_id])
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    held = [r for r in rows if r.doc_id % 10 == 6 and r.doc_id > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_force(train, texts, spelled):
    """Scores of whole texts by dictionaries; ``spelled`` gives log10 of each token's spelling."""
    count = Counter(w for t in train for w in tokens(t))
    n, v = sum(count.values()), len(count)
    group = {w: int(word_hashes([w.encode()])[0][0]) >> 58 if w else 0 for w in count}
    discount = lambda counts: min(max((sum(c == 1 for c in counts) + 0.5) / (sum(c == 1 for c in counts) + 2 * sum(c == 2 for c in counts) + 1), 0.02), 0.98)
    follows = [None, {}, {}, {}]
    for t in train:
        own = tokens(t)
        for i in range(len(own)):
            for k in range(1, min(i, 3) + 1):
                follows[k].setdefault(tuple(own[i - k : i]), Counter())[own[i]] += 1
    root = np.full(64, 0.5)
    for w, c in count.items():
        root[group[w]] += c

    def groups(events):
        out = Counter()
        for w, c in events.items():
            out[group[w]] += c
        return out

    states = set()
    for k in (1, 2, 3):
        for context, events in follows[k].items():
            total, own = sum(events.values()), groups(events)
            if total < 2:
                continue
            upper = dict(enumerate(root)) if k == 1 else groups(follows[k - 1][context[1:]])
            whole = sum(upper.values())
            if sum(m * math.log(m / total / (upper[g] / whole)) for g, m in own.items()) > 8 + len(own):
                states |= {context[i:] for i in range(k)}
    base = discount(count.values())
    off = [None] + [discount([c for events in follows[k].values() for c in events.values()]) for k in (1, 2, 3)]
    out = []
    for t in texts:
        own, total = tokens(t), 0.0
        for i, (w, s) in enumerate(zip(own, spelled(t), strict=True)):
            p = (max(count[w] - base, 0) + base * v * 10.0**s) / n
            for k in range(1, min(i, 3) + 1):
                context = tuple(own[i - k : i])
                if context in states:
                    events = follows[k][context]
                    p = (max(events[w] - off[k], 0) + off[k] * len(events) * p) / sum(events.values())
            total += math.log10(p)
        out.append(total)
    return out, states


def test_scores_equal_brute_force(spark):
    texts = [*make(5, 150), "", "one word", "seldom found phrase that occurs twice here", "seldom found phrase that occurs twice here too", "of the seldom found phrase"]
    texts += ["first dull grey morning", "last dull grey evening"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = docs.filter("doc_id % 10 <> 6")
    tree = fit_tree(corpus_counts(train.select("text")).filter("window").select("key", "n"))
    want, states = brute_force([t for i, t in enumerate(texts) if i % 10 != 6], texts, lambda t: tree.token_scores([t.encode()]))
    assert len({len(x) for x in states}) == 3
    got = {r.doc_id: r.score for r in score_texts(docs, train).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-5)


def test_states_are_longest_suffixes(spark):
    texts = [t.encode() for t in make(2, 60)]
    rows = corpus_counts(spark.createDataFrame([(t.decode(),) for t in texts], "text string"))
    tree = fit_tree(rows.filter("window").select("key", "n"), 1e-3)
    longer = tree.longer.reshape(-1, SYMBOLS)
    paths = {0: ()}
    for state in range(tree.states):
        for s in range(SYMBOLS):
            if longer[state, s] < tree.states:
                paths[int(longer[state, s])] = (s, *paths[state])
    known = {p: state for state, p in paths.items()}
    assert len(known) == tree.states and tree.states > 20
    logs = tree.logs.reshape(-1, SYMBOLS)
    for t in texts[:5]:
        stream, _ = _stream([t])
        symbols = [int(x) for x in tree.symbol[stream]]
        want = 0.0
        for i in range(DEPTH, len(symbols)):
            best = max((k for k in range(DEPTH + 1) if tuple(symbols[i - k : i]) in known))
            want += float(logs[known[tuple(symbols[i - best : i])], symbols[i]])
        assert tree.token_scores([t]).sum() == pytest.approx(want, rel=1e-6)


def test_distributions_sum_to_one_and_suffixes_are_kept(spark):
    rows = corpus_counts(spark.createDataFrame([(t,) for t in make(3, 60)], "text string"))
    tree = fit_tree(rows.filter("window").select("key", "n"), 1e-3)
    p = 10.0 ** tree.logs.reshape(-1, SYMBOLS)[: tree.states].astype(float)
    p[:, 63] *= int((tree.symbol == 63).sum())
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_window_counts_equal_brute_force(spark, texts):
    rows = corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).filter("window").collect()
    want = Counter()
    for t in texts:
        words = b" ".join((t or "").encode().lower().split())
        line = b"\n" * DEPTH + words + (b" \n" if words else b"\n")
        want.update(int.from_bytes(line[i - DEPTH : i + 1], "big") for i in range(DEPTH, len(line)))
    assert {r.key: r.n for r in rows} == want


def test_the_fifth_symbol_back_decides(spark):
    rows = corpus_counts(spark.createDataFrame([("amnopx bmnopy",)] * 200, "text string"))
    tree = fit_tree(rows.filter("window").select("key", "n"))
    right, wrong = tree.token_scores([b"amnopx bmnopy"])[:2].sum(), tree.token_scores([b"amnopy bmnopx"])[:2].sum()
    assert right > wrong + 2


def test_rare_words_two_back_decide(spark):
    filler = [" ".join(f"w{i}v{j}" for j in range(200)) for i in range(600)]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(filler + ["left mid east", "right mid west"] * 40)], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "left mid east"), (2, "left mid west"), (3, "right mid west"), (4, "right mid east")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in score_texts(docs, train).collect()}
    assert score[1] > score[2] + 1 and score[3] > score[4] + 1


def test_parts_of_the_tree_score_like_the_whole(spark, texts):
    counts = corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string")).filter("window").select("key", "n")
    asked = corpus_counts(spark.createDataFrame([(t,) for t in make(9, 50)], "text string")).filter("window").select("key")
    keys = np.array([r.key for r in asked.collect()], np.int64).view(np.uint64)
    got = {r.word: r.logp for r in byte_scores(counts, asked).collect()}
    assert [got[int(x)] for x in mix(keys).view(np.int64)] == pytest.approx(fit_tree(counts).window_scores(keys).tolist(), abs=1e-5)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    rows = score_texts(docs, docs.limit(0)).collect()
    assert len(rows) == 2 and all(r.n_known == r.train_tokens == 0 and r.score < 0 and r.base_score == 0 - 0.0 or r.n_tokens for r in rows)
    assert score_texts(docs.limit(0), docs).count() == 0
    assert isinstance(SuffixTree(np.zeros(256, np.uint8), {}).states, int)


def test_one_pass_lists_and_counts_windows(spark, texts):
    rows = [(i, t, i % 10 != 6 if i % 7 else None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ours boolean").repartition(3)
    got = {(r.window, r.key): r.n for r in corpus_counts(docs.select("text", "ours")).collect()}
    counted = {(r.window, r.key): r.n for r in corpus_counts(docs.filter("ours").select("text")).collect()}
    listed = {(r.window, r.key): 0 for r in corpus_counts(docs.select("text")).filter("window").collect()}
    assert got == listed | counted and 0 in got.values()
    apart = sorted(tuple(r) for r in score_texts(docs, docs.filter("ours")).collect())
    once = sorted(tuple(r) for r in score_texts(docs, docs.filter("ours"), F.coalesce("ours", F.lit(False))).collect())
    assert len(apart) == len(texts) and [r[:4] for r in apart] == [r[:4] for r in once]
    assert [r[5] for r in apart] == pytest.approx([r[5] for r in once], rel=1e-6)


def test_tables_of_hardly_repeated_grams_stay_near_the_size_of_the_texts(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(400)) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr("latticeframe.llm.shared.shared_folder", lambda spark: f"file://{tmp_path}")
    assert score_texts(docs, docs).count() == len(texts)
    # in a table of grams, three hashes for each of three a word took over ten times the texts' size
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert size < 5 * sum(map(len, texts))


def test_numbers_are_found_in_a_list():
    """Those whose slot of the table another one has, too, and with few or many numbers listed."""
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 20_000):
        listed = np.unique(rng.integers(0, 2**48, n).astype(np.uint64))
        rng.shuffle(listed)
        x = rng.choice(listed, 5 * n) if n else listed
        np.testing.assert_array_equal(listed[suffix_tree._finder(listed)(x)], x)
    few = rng.choice(listed[:50], 3000)
    for a, b in zip(suffix_tree._distinct(few)[::2], suffix_tree._distinct_few(few)[::2], strict=True):
        np.testing.assert_array_equal(a, b)
    assert (few[suffix_tree._distinct_few(few)[1]] == np.unique(few)).all()
