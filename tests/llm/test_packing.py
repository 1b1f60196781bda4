import zlib

import numpy as np
import public_tokenizers
import pytest
from latticeframe.llm.packing import Bins, FastEncoder, pack_documents
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "ΩΩ", "x\ny", "<|endoftext|>"]
    out = [None, "", "word " * 5000, "z" * 9000]
    out += [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 600, 300)]
    return out + [out[7]] * 20


def test_every_token_is_placed_once(spark, texts):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece long").repartition(3)
    rows = pack_documents(docs, PATH).collect()
    own = Tokenizer.from_file(PATH)
    own.no_truncation()
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 1024)))
        at = 0
        for r in mine:
            assert r.start == at and (r.piece == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
    rooms: list = []  # first fit, longest pieces first
    for length in sorted((r.length for r in rows), reverse=True):
        at = next((k for k, room in enumerate(rooms) if room >= length), None)
        if at is None:
            rooms.append(1024 - length)
        else:
            rooms[at] -= length
    assert -(-total // 1024) <= len(places) <= len(rooms)


def test_search_raises_squared_fill_and_keeps_items():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 60, 80)
        bins = Bins(sizes, 100)
        before = sum(f * f for f in bins.fill)
        bins.search(exact=False)
        assert sum(f * f for f in bins.fill) >= before
        assert sorted(i for b in bins.bins for i in b) == list(range(80))
        assert all(sum(int(sizes[i]) for i in b) == f <= 100 for b, f in zip(bins.bins, bins.fill, strict=True))


def test_small_cases(spark):
    docs = spark.createDataFrame([(None, None), (None, None), (4, "a")], "doc_id long, text string")
    rows = pack_documents(docs, PATH).collect()
    assert sorted(r.length for r in rows) == [1, 1, 2] and len({r.sequence_id for r in rows}) == 1
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_each_of_many_distinct_words_is_encoded_once():
    code, own = FastEncoder(PATH), Tokenizer.from_file(PATH)
    plain, calls = code.own, []

    class Counting:
        def encode_ordinary(self, unit):
            calls.append(unit)
            return plain.encode_ordinary(unit)

    code.own = Counting()
    text = " ".join(f"w{i}" for i in range(300_000))
    ids = code.encode(text)
    assert code.encode(text) == ids and len(calls) == 300_000
    own.no_truncation()
    assert np.frombuffer(ids, "<u4").tolist() == own.encode(text, add_special_tokens=False).ids
