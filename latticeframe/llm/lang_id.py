"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams (1 to 3 letters, words padded with a blank). A
document's own list is compared with each profile by the out-of-place distance: for each of the
document's n-grams the difference of its two ranks, or the profile's length where it is missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import bounded, row_digest, values, without, written

U64 = np.uint64
#: Code of what stands between words; an n-gram's unused places are 0.
BLANK = U64(1)
#: Longest list of n-grams, of a language and of a document.
PROFILE = 400
#: Least score of a text that counts as being in its predicted language.
LEAST_SCORE = 0.15
#: More distinct language values than this are refused, as profiles are sent to every task.
MAX_LANGUAGES = 5000
#: Letters of text whose n-grams a task holds at a time while it counts; a longer text is held alone.
HELD_LETTERS = 1 << 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    codes = np.arange(0x110000, dtype=np.uint32)
    kept = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(kept, codes, 0).astype(np.uint32)


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text's lower-cased words, sorted; none if it has no letter."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not codes.any():
        return np.zeros(0, U64)
    c = np.full(len(codes) + 3, BLANK, U64)  # blanks around, and one more for the last windows
    c[1:-2] = np.where(codes == 0, BLANK, codes)
    keep = np.ones(len(c), bool)
    keep[1:-1] = (c[1:-1] != BLANK) | (c[:-2] != BLANK)  # a run of other characters is one blank
    c = c[keep]
    a, b, d = c[:-2], c[1:-1], c[2:]
    la, lb = a != BLANK, b != BLANK
    out = np.concatenate(((a << U64(42))[la], (a << U64(42) | b << U64(21))[la | lb], (a << U64(42) | b << U64(21) | d)[lb]))
    out.sort()
    return out


def counted(sorted_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    if not len(sorted_codes):
        return sorted_codes, np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate(([True], sorted_codes[1:] != sorted_codes[:-1])))
    return sorted_codes[edge], np.diff(edge, append=len(sorted_codes))


def top_grams(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; ties go to the smaller code."""
    kinds, counts = counted(codes)
    if len(kinds) > 4 * size:  # ties at the limit stay for the sort
        kept = counts >= np.partition(counts, len(counts) - size)[len(counts) - size]
        kinds, counts = kinds[kept], counts[kept]
    return kinds[np.argsort(-counts, kind="stable")[:size]]


def language_profiles(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, place): the ``size`` most frequent n-grams of each language over all rows of (lang, text).

    Rows without text or lang are left out. Tasks add up counts before the shuffle; the ranking has
    a first step within hashed parts, so no task sees all n-grams of a frequent language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                kinds, counts = counted(np.sort(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(kinds), pa.string()), pa.array(kinds.view(np.int64)), pa.array(counts)],
                    ["lang", "gram", "n"],
                )

        held: dict[str, list[np.ndarray]] = {}
        size_now = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(grams(text))
                size_now += len(text)
                if size_now >= HELD_LETTERS:
                    yield from emit(held)
                    held, size_now = {}, 0
        yield from emit(held)

    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    counts = rows.mapInArrow(bounded(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    part = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    first = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64))).withColumn("p", part).filter(F.col("p") <= size)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1
    return first.select("lang", "gram", place.alias("place"), "n").filter(F.col("place") < size).select("lang", "gram", "place")


class Profiles:
    """The ranks of all profiles' n-grams, by n-gram; languages are in alphabetical order."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        column = {lang: k for k, lang in enumerate(self.langs)}
        codes = np.array([r[1] for r in rows], np.int64).view(U64)
        order = np.argsort(codes, kind="stable")
        self.grams, counts = counted(codes[order])
        self.starts = np.concatenate(([0], np.cumsum(counts)))
        self.lang = np.array([column[r[0]] for r in rows], np.int64)[order]
        self.place = np.array([r[2] for r in rows], np.int64)[order]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language at the least distance (ties: the first by name), and 1 less the distance's share of the largest possible."""
        own = top_grams(grams(text), self.size) if text else ()
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        places = np.flatnonzero(self.grams[at] == own)
        first = self.starts[at[places]]
        n = self.starts[at[places] + 1] - first
        rows = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        # a missing n-gram is the profile's length away, so what counts is how much nearer the others are
        nearer = np.bincount(self.lang[rows], self.size - np.abs(self.place[rows] - np.repeat(places, n)), len(self.langs))
        best = int(nearer.argmax())
        return self.langs[best], float(nearer[best]) / (self.size * len(own))


def fit_profiles(labelled: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of all languages of (lang, text), at most ``MAX_LANGUAGES`` of them."""
    table = written(language_profiles(labelled, size), "profiles")
    if (n := table.select("lang").distinct().count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; at most {MAX_LANGUAGES} can be learned")
    return Profiles([tuple(r) for r in table.collect()], size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text); other columns are ignored.

    ``lang_pred`` is ``und`` with score 0 if text is null or has no letter, or if no language was
    learned. Whole texts count, of any length. Repeated rows and null ids are returned as they
    come; an empty table gives an empty table. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(bounded(run), "doc_id long, lang_pred string, score double")


def kept_languages(docs: DataFrame, profiles: Profiles, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text is in a learned language: not ``und``, and with a score of ``least`` or more.

    If no language was learned, those whose text has a letter.

    Texts go to Python but not back: a row is known by 128 bits of its id and text, and only those
    of rejected rows return, for an anti-join. Null and empty texts go; very long ones are judged
    whole; repeated rows are judged alike, each kept or not; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if profiles.langs:
                found = [profiles.predict(t) for t in values(batch.column(1))]
                gone = pa.array([lang == "und" or score < least for lang, score in found], pa.bool_())
            else:
                gone = pa.array([not (t and len(grams(t))) for t in values(batch.column(1))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(gone)], ["row"])

    own = row_digest(F.col("doc_id"), F.col("text"))
    rejected = written(docs.select(own.alias("row"), "text").mapInArrow(bounded(run), "row string").distinct(), "rejected")
    return without(docs, own, rejected)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows to learn from: those with crc32(doc_id as text) mod 4 other than 2."""
    return docs.filter(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4 != 2)
