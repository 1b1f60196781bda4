"""Quality by hierarchical empirical Bayes: evidence of each document, combined with its site's.

1. *Document evidence.* A logistic classifier over binned surface measures and a learned lexicon
   gives the log-likelihood ratio for "bad" (low quality or toxic) from the text alone.
2. *Sites.* Grouped sums of the documents' own posteriors give the rate of each host and each
   path below it. A beta prior, its strength estimated by the method of moments, shrinks sparse
   hosts toward the global rate and sparse paths toward their host.
3. *Both together.* A document's logit is its evidence plus that of its path's rate, taken
   without the document itself.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import bounded, row_digest, values, without, written

#: Labelled rows the classifier is fitted on, at most (about; chosen by a hash of their ids).
FIT_ROWS = 20_000
#: A unit of the lexicon stands in this share of the toxic documents at least, and in 3.
LEXICON_SHARE = 0.02
LEXICON_UNITS = 4096
LEXICON_EDGES = np.arange(1.0, 9.0)
BINS = 16
#: Limits of a beta prior's strength, in documents.
STRENGTH = (2.0, 10_000.0)
WORDS = regex.compile(r"\p{L}+")
OTHER, SYMBOL, BANG, UPPER, LETTER, PIPE, DIGIT, STOP, SPACE = range(9)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            out[c] = UPPER if x.isupper() else LETTER
        elif x.isdigit():
            out[c] = DIGIT
        elif x.isspace():
            out[c] = SPACE
    for x in "#$%&*@~^<>{}[]+=_\\/":
        out[ord(x)] = SYMBOL
    out[ord("!")], out[ord("|")], out[ord(".")] = BANG, PIPE, STOP
    return out


def surface(text: str) -> list[float]:
    """Measures of a text: shares of kinds of characters, repeated lines and words, lengths."""
    kinds = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=9).tolist()
    n, letters = max(1, len(text)), max(1, kinds[UPPER] + kinds[LETTER])
    lines = [x for x in text.split("\n") if x]
    words = text.split()
    w = max(1, len(words))
    return [
        kinds[SYMBOL] / n,
        kinds[BANG] / n,
        kinds[UPPER] / letters,
        kinds[PIPE] / n,
        kinds[DIGIT] / n,
        kinds[STOP] / w,
        1 - len(set(lines)) / max(1, len(lines)),
        float(max(Counter(lines).values(), default=0)),
        sum(map(operator.eq, words, words[1:])) / w,
        len(set(words)) / w**0.9,
        (n - kinds[SPACE]) / w,
        math.log(w),
    ]


def units(text: str) -> set[str]:
    """What the lexicon knows of a text: its words with an end mark, and their first 4, 5 and 6 letters."""
    words = set(WORDS.findall(text.lower()))
    return {x for w in words for x in (w + "$", w[:4], w[:5], w[:6])}


class Classifier:
    """Logistic regression over one-hot bins, fitted by Newton steps with a ridge."""

    def __init__(self, lexicon: dict[str, float], rows: np.ndarray, bad: np.ndarray, ridge: float = 1.0) -> None:
        self.lexicon = lexicon
        columns = rows.shape[1] - 1
        cuts = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(rows[:, j], cuts)) if len(rows) else np.zeros(0) for j in range(columns)] + [LEXICON_EDGES]
        self.starts = np.cumsum([0] + [len(e) + 1 for e in self.edges])
        hot = np.zeros((len(rows), self.starts[-1] + 1))
        hot[:, -1] = 1
        places = np.stack([np.digitize(rows[:, j], e, right=True) + self.starts[j] for j, e in enumerate(self.edges)], axis=1)
        hot[np.arange(len(rows))[:, None], places] = 1
        self.weights = np.zeros(hot.shape[1])
        share = min(max(bad.mean(), 1e-4), 1 - 1e-4) if len(bad) else 0.01  # without labels nothing is suspect
        self.base = math.log(share / (1 - share)) if len(bad) else 0.0
        self.share = float(share)
        for _ in range(25 if len(rows) else 0):
            p = 1 / (1 + np.exp(-np.clip(hot @ self.weights, -30, 30)))
            step = hot.T @ (p - bad) + ridge * self.weights
            curve = (hot * (p * (1 - p) + 1e-6)[:, None]).T @ hot + ridge * np.eye(hot.shape[1])
            self.weights -= np.linalg.solve(curve, step)

    def evidence(self, text: str | None) -> float:
        """Log-likelihood ratio of bad against good; 0 without words."""
        if not text or not text.strip():
            return 0.0
        return self.of_row([*surface(text), lexical(text, self.lexicon)])

    def of_row(self, row: list[float]) -> float:
        places = [int(np.searchsorted(e, x, "left")) + int(s) for e, s, x in zip(self.edges, self.starts, row, strict=False)]
        return float(self.weights[places].sum() + self.weights[-1] - self.base)


def lexical(text: str, lexicon: dict[str, float]) -> float:
    """The largest log-odds of a text's units."""
    if not lexicon:
        return 0.0
    get = lexicon.get
    return max((get(x, 0.0) for w in set(WORDS.findall(text.lower())) for x in (w + "$", w[:4], w[:5], w[:6])), default=0.0)


def fit_classifier(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier:
    """Fits on labelled documents: labels (doc_id, quality, toxic), bad where quality is 0 or toxic is 1.

    Several labels of a document count as their worst; labels with neither value are left out. Of
    more than ``fit_rows`` labels a part is taken by a hash of the ids. That part is what is
    broadcast and what the driver gets measures of.
    """
    known = (
        labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
        .groupBy("doc_id")
        .agg(F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"), F.coalesce(F.min("quality"), F.lit(1)).alias("quality"))
        .select("doc_id", (F.col("toxic") > 0).alias("toxic"), ((F.col("quality") < 1) | (F.col("toxic") > 0)).alias("bad"))
    )
    n = known.count()
    if n > fit_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * fit_rows / n)))
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(known), "doc_id").select("text", "toxic", "bad")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic: Counter = Counter()
            fine: Counter = Counter()
            for text, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if bad else fine).update(units(text))
            names = list(toxic.keys() | fine.keys())
            columns = [pa.array(names, pa.string())] + [pa.array([c[x] for x in names], pa.int64()) for c in (toxic, fine)]
            yield pa.RecordBatch.from_arrays(columns, ["unit", "a", "b"])

    totals = texts.agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b")).first()
    support = max(3.0, LEXICON_SHARE * totals.a)
    counts = texts.select("text", "toxic").mapInArrow(bounded(count), "unit string, a long, b long").groupBy("unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (totals.a + 1)) - F.log((F.col("b") + 0.5) / (totals.b + 1))
    kept = counts.filter(F.col("a") >= support).select("unit", odds.alias("odds")).filter("odds >= 1").orderBy(F.desc("odds"), "unit").limit(LEXICON_UNITS)
    lexicon = {r.unit: r.odds for r in kept.collect()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[*surface(t), lexical(t, lexicon)] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(2)], ["x", "bad"])

    got = texts.filter("trim(text) <> ''").mapInArrow(bounded(measure), "x array<double>, bad boolean").toPandas()
    rows = np.array(got["x"].tolist(), float).reshape(len(got), 13)
    order = np.lexsort(rows.T)  # the same fit whatever the order of rows
    return Classifier(lexicon, rows[order], got["bad"].to_numpy(bool)[order].astype(float))


def document_evidence(docs: DataFrame, model: Classifier, host: Column | None = None, path: Column | None = None, kept: list[str] | None = None) -> DataFrame:
    """The ``kept`` columns of each row (default doc_id) and a struct ``site`` of host, path and evidence.

    A null host or path counts as the empty name.
    """
    kept = ["doc_id"] if kept is None else kept
    named = docs.select(
        *(F.col(c) for c in kept),
        F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit("")).alias("_host"),
        F.coalesce((F.col("lang") if path is None else path).cast("string"), F.lit("")).alias("_path"),
        F.col("text").alias("_text"),
    )
    n = len(kept)
    schema = StructType([*named.schema.fields[: n + 2], StructField("_evidence", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.evidence(t) for t in values(batch.column(n + 2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 2], pa.array(found, pa.float64())], [f.name for f in schema.fields])

    site = F.struct(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_evidence").alias("evidence")).alias("site")
    return named.mapInArrow(bounded(run), schema).select(*(F.col(c) for c in kept), site)


def _strength(groups: DataFrame, n: str, rate: Column, center: Column) -> float:
    """The beta prior's strength by moments: how far rates of groups spread beyond what counting explains."""
    row = groups.agg(
        F.sum(F.col(n) * (rate - center) * (rate - center)).alias("spread"),
        F.sum(center * (1 - center)).alias("noise"),
        F.sum(F.col(n) * center * (1 - center)).alias("whole"),
        F.sum(n).alias("n"),
    ).first()
    if not row.n or not row.whole:
        return STRENGTH[1]
    between = (row.spread - row.noise) / row.n
    return STRENGTH[1] if between <= 0 else min(max(row.whole / row.n / between - 1, STRENGTH[0]), STRENGTH[1])


def site_posteriors(rows: DataFrame, share: float) -> DataFrame:
    """Adds ``path_rate`` and ``bad`` to a table's struct ``site``: the path's rate without the document, and the posterior.

    ``share`` is the classifier's share of bad documents. Tasks add up their rows before each
    shuffle, so a frequent host costs no more than others; the tables of hosts and paths join back
    by their names.
    """
    own = 1 / (1 + F.exp(-(F.col("site.evidence") + math.log(share / (1 - share)))))
    named = rows.select(F.col("site.host").alias("host"), F.col("site.path").alias("path"), own.alias("own"))
    paths = written(named.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("own").alias("path_bad")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_bad").alias("host_bad")), "hosts")
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_bad").alias("bad")).first()
    overall = (total.bad + share) / (total.n + 1) if total.n else share
    k_host = _strength(hosts, "host_n", F.col("host_bad") / F.col("host_n"), F.lit(overall))
    shrunk = (F.lit(k_host * overall) + F.col("host_bad")) / (k_host + F.col("host_n"))
    sites = paths.join(hosts, "host")
    k_path = _strength(sites, "path_n", F.col("path_bad") / F.col("path_n"), shrunk)
    sites = written(sites.select(F.struct("host", "path").alias("at"), F.struct("host_n", "host_bad", "path_n", "path_bad").alias("sums")), "sites")
    host_rate = (F.lit(k_host * overall) + F.col("sums.host_bad") - own) / (k_host + F.col("sums.host_n") - 1)
    path_rate = (k_path * host_rate + F.col("sums.path_bad") - own) / (k_path + F.col("sums.path_n") - 1)
    path_rate = F.least(F.greatest(path_rate, F.lit(1e-4)), F.lit(1 - 1e-4))
    joined = rows.join(sites, (F.col("site.host") == F.col("at.host")) & (F.col("site.path") == F.col("at.path")))
    bad = lambda rate: 1 / (1 + F.exp(-(F.col("site.evidence") + F.log(rate / (1 - rate)))))
    with_rate = joined.withColumn("site", F.col("site").withField("path_rate", path_rate)).drop("at", "sums")
    return with_rate.withColumn("site", F.col("site").withField("bad", bad(F.col("site.path_rate"))))


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, host, path, evidence, path_rate, bad, keep) for each row of ``docs``.

    ``host`` and ``path`` are columns of ``docs``; by default the source is the host and the
    language its section, as in the addresses of pages. ``bad`` is the posterior that a document is
    of low quality or toxic, ``keep`` is ``bad < 0.5``. A null, empty or blank text has no evidence
    of its own and is judged by its site. Repeated rows and null ids are judged like any other;
    without labels nothing is known and every row stays; an empty table gives an empty table.
    Other columns, whatever their names, are ignored.
    """
    model = fit_classifier(docs, labels, fit_rows)
    rows = written(document_evidence(docs, model, host, path), "evidence")
    return site_posteriors(rows, model.share).select(F.col("doc_id").cast("long").alias("doc_id"), "site.*", (F.col("site.bad") < 0.5).alias("keep"))


def kept_documents(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, whatever their names.

    Texts go to Python but not back: a row is known by 128 bits of its id, host, path and text, and
    rows that were rejected are taken out by an anti-join on these. Rows that are equal in all four
    are judged alike. Null, empty and very long texts, ties, repeated rows and empty tables: see ``judge``.
    """
    model = fit_classifier(docs, labels, fit_rows)
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    own = row_digest(F.col("doc_id"), host, path, F.col("text"))
    keyed = docs.select(own.alias("row"), F.col("text"), host.alias("host"), path.alias("path"))
    rows = written(document_evidence(keyed, model, F.col("host"), F.col("path"), ["row"]), "evidence")
    rejected = written(site_posteriors(rows, model.share).filter("site.bad >= 0.5").select("row").distinct(), "rejected")
    return without(docs, own, rejected)
