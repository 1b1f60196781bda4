"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer.

The file's path is a parameter. Two layouts are read: byte-level pieces, and lower-cased words with
a word-end suffix. Results equal those of the ``tokenizers`` library for the same file with
``add_special_tokens=False`` and ``decode(ids, skip_special_tokens=False)``.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, values

#: The split patterns of the two layouts.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept by a Python worker, and the longest of them; when full, the cache is emptied.
CACHE_WORDS = 200_000
KEPT_LENGTH = 64
WHITE_SPACE = [chr(c) for c in range(0x3001) if regex.match(r"\s", chr(c))]
#: Longer words are merged with a heap, which gives the same parts in less time.
SHORT_WORD = 256
NO_RANK = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Encoder(dict):
    """Maps a stretch of text to its ids as little-endian 32-bit bytes; misses are computed and kept."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.pieces: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.merges: dict[int, int] = {}  # left id, right id -> rank << 32 | id of both
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[self.vocab[a] << 32 | self.vocab[b]] = rank << 32 | self.vocab[a + b]
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        self.lower = bool(self.suffix)
        self.pattern = regex.compile(WORD_PATTERN if self.suffix else BYTE_PATTERN)
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None
        self.bytes_of = {c: b for b, c in enumerate(letters)}

    def merged(self, word: bytes) -> list[int]:
        """Ids of a word. Adjacent ranks lie in one array beside the parts; the smallest goes first."""
        ids = [self.inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        if len(ids) > SHORT_WORD:
            return self._merged_long(ids)
        get = self.merges.get
        ranks = [get(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            ids[i] = least & 0xFFFFFFFF
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], NO_RANK)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1], NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << 32 | ids[j], NO_RANK) != rank:
                continue
            ids[i], ids[j] = rank & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (r := get(ids[a] << 32 | ids[after[a]], NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]

    def __missing__(self, unit: str) -> bytes:
        """Ids of a stretch of text that no piece crosses, kept for the next time."""
        out = b"".join([self._piece(p) for p in self._pieces(unit)])
        if len(unit) <= KEPT_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[unit] = out
        return out

    def _piece(self, piece: str) -> bytes:
        out = self.pieces.get(piece)
        if out is None:
            out = np.array(self.merged(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
            if len(piece) <= KEPT_LENGTH:
                if len(self.pieces) >= CACHE_WORDS:
                    self.pieces.clear()
                self.pieces[piece] = out
        return out

    def _pieces(self, text: str) -> list[str]:
        if self.lower:
            text = unicodedata.normalize("NFC", text)
            # letter by letter: a capital sigma has one small form wherever it stands
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return self.pattern.findall(text)

    def _plain(self, text: str) -> bytes:
        """Ids of text without special tokens: unit by unit between spaces, where no piece crosses these."""
        if self.lower:  # the pattern drops white space
            return b"".join(map(self.__getitem__, text.split(" ")))
        if any(c + " " in text for c in WHITE_SPACE):  # a run of white space may be one piece
            return b"".join([self._piece(p) for p in self.pattern.findall(text)])
        first, *rest = text.split(" ")
        return self[first] + b"".join(map(self.__getitem__, [" " + x for x in rest]))

    def encode(self, text: str) -> bytes:
        """All ids as little-endian unsigned 32-bit integers."""
        if not self.special_pattern or "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """Text of ids. Without a decoder in the file (the word layout) names are joined with spaces."""
        names = map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if self.suffix:
            return " ".join(names)
        out = bytearray()
        for c in "".join(names):
            out += bytes([self.bytes_of[c]]) if c in self.bytes_of else c.encode()
        return out.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)


def encode_decode(docs: DataFrame, tokenizer: str, keep: bool = True) -> DataFrame:
    """Encodes every text of ``docs`` and decodes the ids again.

    Takes ``doc_id`` and ``text`` (null: empty) and ignores other columns, whatever their names.
    ``tokenizer`` is the path of a vocabulary file on every executor. Returns, for each row, doc_id,
    n_tokens long, ids_sha256, decoded_sha256 string (lowercase hex) and, with ``keep``, ids binary
    (little-endian unsigned 32-bit) and decoded string. Texts are whole, of any length; repeated
    rows and null ids are returned as they come; an empty table gives an empty table.
    """
    kept = ", ids binary, decoded string" if keep else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text in values(batch.column(1)):
                ids = code.encode(text or "")
                decoded = code.decode(ids)
                row = len(ids) // 4, sha256(ids).hexdigest(), sha256(decoded.encode()).hexdigest(), ids, decoded
                for c, x in zip(columns, row, strict=True):
                    c.append(x if keep or c is not columns[3] and c is not columns[4] else None)
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()), strict=True))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            n = 6 if keep else 4
            yield pa.RecordBatch.from_arrays(arrays[:n], names[:n])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        bounded(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + kept
    )
