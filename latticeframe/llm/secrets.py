"""Secrets in texts: fixed patterns, and random strings found by two character Markov models.

Everything here is DataFrame expressions. Java's regular expressions give no positions, but a
split by a pattern and all its matches do: a match starts after the parts and matches before it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name, written

#: Kinds in the order in which spans with one start are listed.
KINDS = ["assign", "access", "hex", "markov"]
#: Fixed patterns. Of ``assign`` the last group is the value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
# greedy and maximal, so that the least lengths (16 and 32) may stand in the patterns
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Letters of the strings that the Markov models know, and the least length of one they judge.
STRING = "[A-Za-z0-9+/_=-]"
STRING_LENGTH = 16
#: Least length of the ordinary strings to learn from.
ORDINARY_LENGTH = 10
#: Random strings of each sort to learn from.
RANDOM_STRINGS = 4096
#: Least log-likelihood ratio of a secret, in natural logarithms.
LEAST_RATIO = 12.0
SMOOTHING = 0.1
#: Weight of a character's share regardless of the one before, in observations.
BACK_OFF = 3.0
_LETTERS = 67
_CODES = 128
SPAN = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _before(sizes: Column, sums: Column, step: Column, i: Column) -> Column:
    """Sum of the first ``i`` sizes, with the help of sums over runs of ``step``."""
    add = lambda a, x: a + x
    runs = F.floor(i / step).cast("int")
    return F.aggregate(F.slice(sums, F.lit(1), runs), F.lit(0), add) + F.aggregate(F.slice(sizes, runs * step + 1, i - runs * step), F.lit(0), add)


def match_starts(text: Column, pattern: str) -> Column:
    """array<struct<start, text>> of the leftmost non-overlapping matches, in code points from 0."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)

    def place(matches: Column) -> Column:
        def sized(t: Column) -> Column:  # lengths of the parts before matches, and those with their matches
            own = F.transform(F.slice(t, F.lit(1), F.size(matches)), lambda p: F.length(p))
            return let(own, lambda a: F.struct(a.alias("part"), F.zip_with(a, matches, lambda x, m: x + F.length(m)).alias("both")))

        def summed(s: Column) -> Column:
            step = F.ceil(F.sqrt(F.size(matches))).cast("int")

            def runs(k: Column) -> Column:
                sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / k).cast("int")), lambda r: F.aggregate(F.slice(s["both"], r * k + 1, k), F.lit(0), lambda a, x: a + x))
                return let(sums, lambda u: F.transform(matches, lambda m, i: F.struct((_before(s["both"], u, k, i) + F.get(s["part"], i)).alias("start"), m.alias("text"))))

            return let(step, runs)

        return F.when(F.size(matches) > 0, let(sized_once(sized), summed)).otherwise(F.lit(None))

    def sized_once(sized: Callable[[Column], Column]) -> Column:
        return let(parts, sized)

    return F.coalesce(let(found, place), F.array().cast("array<struct<start:int,text:string>>"))


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["text"])).alias("end")))


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns, by start and kind."""
    none = F.array().cast(SPAN)
    value = lambda m: F.regexp_extract(m["text"], ASSIGN, 1)
    assign = F.filter(match_starts(text, ASSIGN), lambda m: F.length(value(m)) >= ASSIGN_VALUE)
    found = [
        F.when(text.rlike(ASSIGN), _spans(assign, 0)).otherwise(none),
        F.when(text.contains("AKIA"), _spans(match_starts(text, ACCESS), 1)).otherwise(none),
        F.when(text.rlike(HEX), _spans(match_starts(text, HEX), 2)).otherwise(none),
    ]
    return F.array_sort(F.concat(*found))


def random_samples(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """(text, random, weight): strings without order, from digests of numbers, in the usual spellings."""
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    plain = F.base64(F.unhex(digest))
    sorts = [plain, F.regexp_replace(plain, "[^A-Za-z0-9]", ""), F.substring(digest, 1, 40), F.upper(F.regexp_replace(plain, "[^A-Za-z0-9]", ""))]
    return spark.range(n).select(F.explode(F.array(*sorts)).alias("text"), F.lit(True).alias("random"), F.lit(1).cast("long").alias("weight"))


def ordinary_samples(docs: DataFrame) -> DataFrame:
    """(text, random, weight): the strings of all documents that are in no span of a fixed pattern, with the number of documents that hold each."""
    taken = f"{ASSIGN[:-2]}{{{ASSIGN_VALUE},}})|{ACCESS}|{HEX}"
    words = F.regexp_extract_all(F.regexp_replace("text", taken, " "), F.lit(f"{STRING}{{{ORDINARY_LENGTH},}}"), F.lit(0))
    strings = docs.select(F.explode(F.array_distinct(words)).alias("text"))
    return strings.groupBy("text").agg(F.count("*").alias("weight")).select("text", F.lit(False).alias("random"), "weight")


def fit_models(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of random against ordinary for each pair of characters, from (text, random, weight).

    The table is indexed by 128 * code of the first + code of the second; code 0 stands before a
    string. What is gathered are counts of pairs, one row for each pair and label at most.
    """
    chars = F.split("text", "")
    pairs = F.zip_with(F.concat(F.array(F.lit("")), F.slice(chars, F.lit(1), F.size(chars) - 1)), chars, lambda a, b: F.ascii(a) * _CODES + F.ascii(b))
    rows = samples.filter(F.col("text") != "").select("random", "weight", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.sum("weight").alias("n")).collect()
    pair_n: Counter = Counter()
    first_n: Counter = Counter()
    second_n: Counter = Counter()
    all_n: Counter = Counter()
    for r in rows:
        for counts, key in ((pair_n, r.pair), (first_n, r.pair // _CODES), (second_n, r.pair % _CODES), (all_n, 0)):
            counts[r.random, key] += r.n

    def share(random: bool, pair: int) -> float:
        alone = (second_n[random, pair % _CODES] + SMOOTHING) / (all_n[random, 0] + SMOOTHING * _LETTERS)
        return (pair_n[random, pair] + BACK_OFF * alone) / (first_n[random, pair // _CODES] + BACK_OFF)

    return [math.log(share(True, p) / share(False, p)) for p in range(_CODES * _CODES)]


def train(docs: DataFrame, least: float = LEAST_RATIO) -> list[float]:
    """The models of a corpus, see ``fit_models``, in two steps.

    A string that two or more documents hold is labelled ordinary. The first step learns those; the second
    adds the strings of one document, but for those that the first takes for random: so the many
    distinct secrets of a large corpus aren't learned as ordinary, however many they are. Each string counts once. Null
    and empty texts and empty tables give no strings; then only the random strings are learned.
    """
    ordinary = written(ordinary_samples(docs), "strings")
    random = random_samples(docs.sparkSession)
    several = F.col("weight") > 1
    learn = lambda kept: fit_models(kept.withColumn("weight", F.lit(1).cast("long")).unionByName(random))
    first = learn(ordinary.filter(several))
    return learn(ordinary.filter(several | ~F.coalesce(_likely(F.col("text"), first, least), F.lit(False))))


def markov_ratio(string: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string of known letters, random against ordinary."""
    ratios = F.expr(f"cast(split('{','.join(f'{x:.5f}' for x in table)}', ',') as array<double>)")
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.struct(F.ascii(c).alias("last"), (a["sum"] + F.get(ratios, a["last"] * _CODES + F.ascii(c))).alias("sum"))
    return F.aggregate(F.split(string, ""), start, step)["sum"]


def _likely(string: Column, table: list[float], least: float) -> Column:
    """Whether a string is long enough to judge, not all digits, and likelier random."""
    return (F.length(string) >= STRING_LENGTH) & string.rlike("[A-Za-z]") & (markov_ratio(string, table) >= least)


def _apart(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that overlap none of ``base``, which are looked through in runs."""

    def kept(step: Column) -> Column:
        def run(r: Column) -> Column:
            part = F.slice(base, r * step + 1, step)
            ends = F.transform(part, lambda b: b["end"])
            return F.struct(part.alias("part"), F.get(part, F.lit(0))["start"].alias("low"), F.array_max(ends).alias("high"))

        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(base) - 1) / step).cast("int")), run)
        meets = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])
        near = lambda s, r: (r["low"] < s["end"]) & (s["start"] < r["high"])
        return let(runs, lambda found: F.filter(spans, lambda s: ~F.exists(found, lambda r: near(s, r) & F.exists(r["part"], lambda b: meets(s, b)))))

    return F.when(F.size(base) == 0, spans).otherwise(let(F.ceil(F.sqrt(F.size(base))).cast("int"), kept))


def find_secrets(docs: DataFrame, table: list[float], least: float = LEAST_RATIO, into: str = "spans") -> DataFrame:
    """``docs`` with a column ``into``: array of (start, kind, end) by start and kind, kinds as places in ``KINDS``.

    Offsets are code points, ends exclusive. Whole texts of any length are searched; a null or empty text has no
    spans. Besides the fixed patterns, strings of at least ``STRING_LENGTH`` characters, not all digits,
    count whose log-likelihood ratio is ``least`` or more and which touch no other span. Rows are handled alone,
    without a shuffle, so repeated rows, null ids and empty tables come back as they are. Columns
    besides ``text`` are kept; one named like ``into`` is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    pattern = f"{STRING}{{{STRING_LENGTH},}}"

    def whole(base: Column) -> Column:
        likely = _spans(F.filter(match_starts(text, pattern), lambda m: _likely(m["text"], table, least)), 3)
        return F.when(text.rlike(pattern), F.array_sort(F.concat(base, _apart(likely, base)))).otherwise(base)

    return docs.withColumn(into, let(base_spans(text), whole))


def without_secrets(docs: DataFrame, table: list[float], least: float = LEAST_RATIO) -> DataFrame:
    """``docs`` with the spans of ``find_secrets`` masked in ``text`` and, where there is one, ``n_chars`` counted anew.

    All columns stay, whatever their names; a null text stays null. For other cases see ``find_secrets``.
    """
    into = free_name(docs.columns, "spans")
    text = F.when(F.col("text").isNotNull(), masked(F.col("text"), F.col(into)))
    found = find_secrets(docs, table, least, into).withColumn("text", text).drop(into)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover, touching ones together, replaced by ``mark``. Spans are sorted."""
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))

    def step(a: Column, s: Column) -> Column:
        apart = s["start"] > a["end"]
        done = F.when(apart & (a["start"] >= 0), F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))).otherwise(a["done"])
        return F.struct(done.alias("done"), F.when(apart, s["start"]).otherwise(a["start"]).alias("start"), F.greatest(a["end"], s["end"]).alias("end"))

    merged = F.aggregate(spans, start, step, lambda a: F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))))

    def pieces(m: Column) -> Column:
        k = F.size(m)
        first = F.transform(m, lambda s, i: F.substring(text, F.when(i == 0, 0).otherwise(F.get(m, i - 1)["end"]) + 1, s["start"] - F.when(i == 0, 0).otherwise(F.get(m, i - 1)["end"])))
        return F.array_join(F.concat(first, F.array(F.substring(text, F.get(m, k - 1)["end"] + 1, F.length(text)))), mark)

    return F.when(F.size(spans) > 0, let(merged, pieces)).otherwise(text)


def secret_report(docs: DataFrame, table: list[float]) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row, see ``find_secrets``."""
    found = find_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), table)
    base = F.filter("spans", lambda s: s["kind"] < 3)
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
