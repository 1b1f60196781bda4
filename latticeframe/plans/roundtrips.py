"""Queries of conversions, files, buffers, strings of one form or another, and streams, with the same in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import creation, shape, sorting, strings
from ..sources import files
from ..streaming import signals
from ..tensor import Tensor
from . import views
from .queries import ORACLES, QUERIES, add, r, shown, shown_complex
from .views import with_views


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or a local one where Spark is a single process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{folder}/arrays-{uuid.uuid4().hex}"


# what is known of an array: a row each


def _fact(f, sql: str):
    return lambda s, d: s.range(1).select(F.lit(f(s, d)).alias("v")), sql


_rows = "(SELECT max(i0) + 1 FROM emb)"
FACTS = {
    "dims": _fact(lambda s, d: creation.dims(views.embeddings(s, d)), "SELECT 2 AS v"),
    "size": _fact(lambda s, d: creation.size(views.embeddings(s, d)), with_views("SELECT count(*) AS v FROM emb", "emb")),
    "shape": _fact(lambda s, d: ",".join(map(str, creation.shape(views.embeddings(s, d)))), with_views(f"SELECT {_rows} || ',64' AS v", "emb")),
    "type": _fact(lambda s, d: ",".join(str(creation.type_(t)) for t in (views.events(s, d), views.complex_embeddings(s, d), views.part_names(s, d))), "SELECT '0,1,2' AS v"),
    "isempty": _fact(lambda s, d: creation.isempty(views.events(s, d)), "SELECT CAST(count(*) = 0 AS DOUBLE) AS v FROM events"),
    "empty": _fact(lambda s, d: creation.isempty(creation.empty(s, (3, 4))), "SELECT CAST(1 AS DOUBLE) AS v"),
    "print": _fact(lambda s, d: creation.text(views.embeddings(s, d)).split("\n")[0], with_views(f"SELECT 'shape (' || {_rows} || ', 64), real' AS v", "emb")),
}
for _name, (_query, _sql) in FACTS.items():
    add(_name, _query, _sql)


def _seeded(s: SparkSession, d: str) -> DataFrame:
    """Cells that differ between arrays of one seed, and of two."""
    creation.seed(7)
    a = creation.rand(s, (1000,))
    creation.seed(8)
    b = creation.rand(s, (1000,))
    creation.seed(7)
    c = creation.rand(s, (1000,))
    creation.seed(creation.DEFAULT_SEED)
    apart = lambda x: a.df.join(x.df.withColumnRenamed("v", "w"), "i0").filter("v <> w").count()
    return s.createDataFrame([(apart(c), apart(b) > 990)], "same long, other boolean")


add("seed", _seeded, "SELECT CAST(0 AS BIGINT) AS same, true AS other")


def _spread(s: SparkSession, d: str, f, low: float, high: float) -> DataFrame:
    """A uniform array's count, mean and deviation, and what of it is outside the limits."""
    v = F.col("v")
    found = f(s).df.agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("sd"), F.count_if((v < low) | (v >= high)).alias("outside"), F.count_distinct("v").alias("kinds"))
    width = high - low
    near = lambda x, y: F.abs(x - y) < 0.02 * width
    return found.select("n", "outside", near(F.col("m"), F.lit((low + high) / 2)).alias("centred"), near(F.col("sd"), F.lit(width / 12**0.5)).alias("even"), (F.col("kinds") > 99_000).alias("distinct"))


add("rand", lambda s, d: _spread(s, d, lambda x: creation.rand(x, (100_000,), 2, 5), 2, 5), "SELECT CAST(100000 AS BIGINT) AS n, CAST(0 AS BIGINT) AS outside, true AS centred, true AS even, true AS distinct")


def _whole_numbers(s: SparkSession, d: str) -> DataFrame:
    found = creation.randint(s, (100_000,), 0, 4).df.groupBy("v").count()
    return found.select("v", (F.abs(F.col("count") - 25_000) < 700).alias("even"))


add("randint", _whole_numbers, "SELECT CAST(k AS DOUBLE) AS v, true AS even FROM range(4) g(k)")
add("fromarray", lambda s, d: shown(creation.fromarray(s, [[1.0, 2.5], [-3.0, 4.0]])), "SELECT CAST(k // 2 AS BIGINT) AS i0, CAST(k % 2 AS BIGINT) AS i1, CAST([1, 2.5, -3, 4][k + 1] AS DOUBLE) AS v FROM range(4) g(k)")
add("toarray", lambda s, d: shown(creation.fromarray(s, creation.toarray(views.sizes(s, d)))), with_views("SELECT i0, v FROM sizes", "sizes"))


def _table(s: SparkSession, d: str) -> Tensor:
    name = f"t_{uuid.uuid4().hex}"
    creation.totable(views.events(s, d), name)
    return creation.fromtable(s, name)


for _name in ("toftable", "fromftable"):
    add(_name, lambda s, d: shown(_table(s, d)), f"SELECT event_id AS i0, {r('value')} AS v FROM events")
add("array_get", lambda s, d: shown(views.embeddings(s, d)[3, 5]), with_views(f"SELECT {r('v')} AS v FROM emb WHERE i0 = 3 AND i1 = 5", "emb"))
add("array_set", lambda s, d: shown(views.embeddings(s, d).put((3, 5), -1.0)), with_views(f"SELECT i0, i1, {r('CASE WHEN i0 = 3 AND i1 = 5 THEN -1 ELSE v END')} AS v FROM emb", "emb"))
add("array_init", lambda s, d: shown(Tensor.of(s, [1.0, 2.0, 4.0])), "SELECT CAST(k AS BIGINT) AS i0, pow(2.0::DOUBLE, k) AS v FROM range(3) g(k)")


def _in_place(name: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        t = views.events(s, d)
        if name == "addin":
            t += 2.5
        elif name == "subin":
            t -= 2.5
        elif name == "mulin":
            t *= 3
        else:
            t /= 7
        return shown(t)

    return query


for _name, _sql in {"addin": "value + 2.5", "subin": "value - 2.5", "mulin": "value * 3", "divin": "value / 7"}.items():
    add(_name, _in_place(_name), f"SELECT event_id AS i0, {r(_sql)} AS v FROM events")

# files


def _saved(s: SparkSession, d: str) -> Tensor:
    path = scratch(s)
    files.save(views.embeddings(s, d), path)
    return files.load(s, path)


for _name in ("save", "load"):
    add(_name, lambda s, d: shown(_saved(s, d)), with_views(f"SELECT i0, i1, {r('v')} AS v FROM emb", "emb"))


def _through(make, name: str):
    """An array written as one file by many tasks, and read back by ranges of its bytes."""

    def query(s: SparkSession, d: str) -> Tensor:
        path = f"{scratch(s)}/{name}"
        files.save(make(s, d), path)
        return files.load(s, path)

    return query


def _audio(s: SparkSession, d: str) -> DataFrame:
    """Two channels of 32-bit floats."""
    path, t = scratch(s), views.sizes(s, d) / 64
    files.save_audio(shape.stack(t, t * -0.5), f"{path}/sizes.wav", 8000)
    sound, rates = files.load_audio(s, path)
    return shown(sound).join(rates, "path").drop("path")


def _audio_ranges(s: SparkSession, d: str) -> DataFrame:
    """The matrix as sound, a channel for each dimension."""
    path = f"{scratch(s)}/emb.wav"
    files.save_audio(shape.transpose(views.embeddings(s, d)), path, 8000)
    return shown(files.load_arrays(s, path)).drop("path")


def _flac(s: SparkSession, d: str) -> DataFrame:
    """Values of events as the two channels of a sound of 24 bits."""
    t = views.events(s, d, "value / 512")
    path = f"{scratch(s)}/events.flac"
    files.save_flac(shape.stack(t, t * -0.5), path, 8000, 24)
    return shown(files.load_arrays(s, path)).drop("path")


_whole = "round(greatest(-8388608, least(8388607, v * [1, -0.5][c + 1] * 16384))) / 8388608"
add("flac", _flac, f"SELECT CAST(c AS BIGINT) AS i0, event_id AS i1, {r(_whole)} AS v FROM (SELECT event_id, value AS v FROM events), range(2) g(c)")
_names = with_views("SELECT i0, coalesce(v, '') AS v FROM (SELECT CAST(unnest(range(n)) AS BIGINT) AS i0 FROM (SELECT max(i0) + 1 AS n FROM names)) LEFT JOIN names USING (i0)", "names")
add("npy", lambda s, d: shown(_through(views.embeddings, "emb.npy")(s, d)), with_views(f"SELECT i0, i1, {r('v')} AS v FROM emb", "emb"))
add("npy_names", lambda s, d: _through(views.part_names, "names.npy")(s, d).df, _names)
add("csn", lambda s, d: shown(_through(views.embeddings, "emb.csn")(s, d)), with_views(f"SELECT i0, i1, {r('v')} AS v FROM emb", "emb"))
add("csn_names", lambda s, d: _through(views.part_names, "names.csn")(s, d).df, _names)
add("csn_complex", lambda s, d: shown_complex(_through(views.complex_embeddings, "emb.csn")(s, d)), with_views(f"SELECT i0, i1, {r('re')} AS re, {r('im')} AS im FROM cplx", "emb", "cplx"))
add("audio_ranges", _audio_ranges, with_views(f"SELECT i1 AS i0, i0 AS i1, {r('v')} AS v FROM emb", "emb"))
for _name in ("saveaudiofile", "loadaudiofile"):
    add(_name, _audio, with_views(f"SELECT CAST(c AS BIGINT) AS i0, i0 AS i1, {r('v / 64 * CASE c WHEN 0 THEN 1 ELSE -0.5 END')} AS v, CAST(8000 AS BIGINT) AS rate FROM sizes, range(2) g(c)", "sizes"))

# strings

_letters = "SELECT i0, CAST(k AS BIGINT) AS i1, v[k + 1] AS v FROM names, LATERAL (SELECT unnest(range(length(v))) AS k)"


def _joined(spread: str, back) -> DataFrame:
    def query(s: SparkSession, d: str) -> DataFrame:
        t = strings.spread(spread, views.part_names(s, d))
        rows = t.df.groupBy("i0").agg(F.transform(F.array_sort(F.collect_list(F.struct("i1", "v"))), lambda c: c["v"]).alias("data"))
        return rows.select("i0", back(F.col("data")).alias("v"))

    return query


for _name, _forward, _back in (("strfromascii", "strtoascii", strings.fromcodes), ("strdecode", "strencode", strings.decode), ("strfromcodepoints", "strtocodepoints", strings.fromcodepoints)):
    add(_name, _joined(_forward, _back), with_views("SELECT i0, v FROM names", "names"))
add("strord", lambda s, d: strings.apply("strord", strings.spread("straslist", views.part_names(s, d))).df, with_views(f"SELECT i0, i1, CAST(ascii(v) AS DOUBLE) AS v FROM ({_letters})", "names"))
add("strchr", lambda s, d: strings.apply("strchr", views.sizes(s, d) + 40).df, with_views("SELECT i0, chr(CAST(v + 40 AS INTEGER)) AS v FROM sizes", "sizes"))
add("listasstr", lambda s, d: views.sizes(s, d).df.select("i0", strings.listasstr(F.array("v", F.col("v") / 4), ";").alias("v")), with_views("SELECT i0, CAST(v AS VARCHAR) || ';' || CAST(v / 4 AS VARCHAR) AS v FROM sizes", "sizes"))
add("binstrtoarr", lambda s, d: strings.spread("binstrtoarr", strings.apply("tobinary", views.sizes(s, d), 8)).df, with_views("SELECT i0, CAST(k AS BIGINT) AS i1, CAST(lpad(bin(CAST(v AS BIGINT)), 8, '0')[k + 1] AS DOUBLE) AS v FROM sizes, range(8) g(k)", "sizes"))
add("hexstrtoarr", lambda s, d: strings.spread("hexstrtoarr", strings.apply("tohex", views.sizes(s, d), 4)).df, with_views("SELECT i0, CAST(k AS BIGINT) AS i1, lpad(hex(CAST(v AS BIGINT)), 4, '0')[k + 1] AS v FROM sizes, range(4) g(k)", "sizes"))
_words = "list_transform(string_split(v, ' '), lambda w: upper(w[1]) || lower(w[2:]))"
add("strtitle", QUERIES["strtitle"], with_views(f"SELECT i0, array_to_string({_words}, ' ') AS v FROM names", "names"))
_m = "greatest(21 - length(v), 0)"
_l = f"({_m} // 2 + {_m} % 2)"
add("strcenter", QUERIES["strcenter"], with_views(f"SELECT i0, repeat('*', {_l}) || v || repeat('*', {_m} - {_l}) AS v FROM names", "names"))
_first, _final = "strpos(v, 'a')", "(length(v) - strpos(reverse(v), 'a') + 1)"
_three = lambda at, none: f"SELECT i0, CAST(k AS BIGINT) AS i1, CASE WHEN strpos(v, 'a') = 0 THEN {none}[k + 1] ELSE [v[:{at} - 1], 'a', v[{at} + 1:]][k + 1] END AS v FROM names, range(3) g(k)"
add("strpartition", QUERIES["strpartition"], with_views(_three(_first, "[v, '', '']"), "names"))
add("strrpartition", QUERIES["strrpartition"], with_views(_three(_final, "['', '', v]"), "names"))
add("strrsplit", QUERIES["strrsplit"], with_views(f"SELECT i0, CAST(k AS BIGINT) AS i1, CASE WHEN strpos(v, 'a') = 0 THEN v ELSE [v[:{_final} - 1], v[{_final} + 1:]][k + 1] END AS v FROM names, range(2) g(k) WHERE k = 0 OR strpos(v, 'a') > 0", "names"))

# buffers: values of a lane as bytes of a NumPy type

_hex = "string_agg(printf('%02X%02X', CAST(floor(v) AS INTEGER) % 256, CAST(floor(v) AS INTEGER) // 256), '' ORDER BY i0)"
add("tobuffer", QUERIES["tobuffer"], with_views(f"SELECT user_id, {_hex} AS v FROM lanes GROUP BY user_id", "lanes"))


def _read_back(s: SparkSession, d: str) -> DataFrame:
    packed = creation.packed(views.lanes(s, d).map(F.floor)).select("user_id", strings.frombuffer(strings.tobuffer(F.col("data"), ">i4"), ">i4").alias("data"))
    return packed.select("user_id", F.posexplode("data").alias("i0", "v")).select("user_id", F.col("i0").cast("long").alias("i0"), "v")


add("frombuffer", _read_back, with_views("SELECT user_id, i0, floor(v) AS v FROM lanes", "lanes"))

# order



def _moved(s: SparkSession, d: str) -> DataFrame:
    """A shuffled array: how many values it has of each kind, and whether it is in another order."""
    t = views.sizes(s, d)
    mixed = sorting.shuffle(t, 5).df.withColumnRenamed("v", "w").join(t.df, "i0")
    kinds = mixed.groupBy(F.col("w").alias("v")).agg(F.count("*").alias("n"))
    stayed = mixed.agg((F.count_if(F.col("v") == F.col("w")) < 0.2 * F.count("*")).alias("moved"))
    return kinds.crossJoin(F.broadcast(stayed))


add("shuffle", _moved, with_views("SELECT v, count(*) AS n, true AS moved FROM sizes GROUP BY v", "sizes"))
_every = "SELECT a.a AS a, b.b AS b, c.c AS c, d.d AS d FROM range(1, 5) a(a), range(1, 5) b(b), range(1, 5) c(c), range(1, 5) d(d) WHERE len(list_distinct([a, b, c, d])) = 4"
add("perm", lambda s, d: _as_rows(sorting.perm(creation.arange(s, 1, 5))), f"SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d FROM ({_every})")


def _as_rows(t: Tensor) -> DataFrame:
    """Each permutation once, without its number: the order of Heap's algorithm is tested against literals."""
    return t.df.groupBy("i0").agg(*(F.max(F.when(F.col("i1") == k, F.col("v"))).alias(c) for k, c in enumerate("abcd"))).drop("i0")


add("ifftshift", lambda s, d: shown(_odd(s, d, "ifftshift")), with_views(f"SELECT i0, (i1 + 32) % 63 AS i1, {r('v')} AS v FROM emb WHERE i1 < 63", "emb"))
add("fftshift", lambda s, d: shown(_odd(s, d, "fftshift")), with_views(f"SELECT i0, (i1 + 31) % 63 AS i1, {r('v')} AS v FROM emb WHERE i1 < 63", "emb"))


def _odd(s: SparkSession, d: str, name: str) -> Tensor:
    """Of rows of an odd length, where the two shifts differ."""
    from ..operators import fourier

    return getattr(fourier, name)(shape.truncate(views.embeddings(s, d), 63, 1))


# streams: events as ten signals, whose state is kept from batch to batch


def _streamed(s: SparkSession, d: str, f) -> DataFrame:
    """``f`` of the stream of (key, i, v), run until all input is read, its output as a table."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    source = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    samples = source.select(F.pmod("event_id", F.lit(10)).cast("string").alias("key"), F.floor(F.col("event_id") / 10).alias("i"), F.col("value").alias("v"))
    path = scratch(s)
    run = f(samples).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    return s.read.parquet(f"{path}/out")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.round("v", 4) + 0.0)


_signals = "sg AS MATERIALIZED (SELECT CAST(event_id % 10 AS VARCHAR) AS key, event_id // 10 AS i, value AS v FROM events)"
_cells = lambda c: lambda x: x.select("key", c, F.posexplode("data").alias("at", "v"))


def _stream(name: str, f, sql: str, after=lambda x: x) -> None:
    add(name, lambda s, d: _rounded(after(_streamed(s, d, f))), f"WITH RECURSIVE {_signals} {sql}")


_frame = "SELECT key, CAST(f AS BIGINT) AS {0}, CAST(j AS INTEGER) AS \"at\", " + r("v", 4) + " AS v FROM sg, range(16) h(j), LATERAL (SELECT (i - j) // {1} AS f) WHERE i >= j AND (i - j) % {1} = 0 AND (i - j) + 15 <= (SELECT max(i) FROM sg o WHERE o.key = sg.key)"
_stream("next", signals.next_, f"SELECT key, i, {r('v', 4)} AS v FROM sg")
_stream("snap", lambda x: signals.snap(x, 16, 8), _frame.format("frame", 8), _cells("frame"))
_stream("fromaudio", lambda x: signals.blocks(x, 16), _frame.format("block", 16), _cells("block"))
_whole_blocks = "SELECT key, i, {} AS v FROM sg WHERE i < ((SELECT max(i) + 1 FROM sg o WHERE o.key = sg.key) // 16) * 16"
_stream("toaudio", lambda x: signals.unblock(signals.blocks(x, 16), 16), _whole_blocks.format(r("v", 4)))
_stream("stream", lambda x: signals.snap(x, 16, 8), "SELECT 1", lambda x: signals.overlap_add(x, 8))
ORACLES["stream"] = f"WITH {_signals}, fr AS (SELECT key, (max(i) - 15) // 8 AS last FROM sg GROUP BY key) SELECT key, i, {r('v * n', 4)} AS v FROM (SELECT key, i, v, (SELECT count(*) FROM range(last + 1) g(f) WHERE i - 8 * f BETWEEN 0 AND 15) AS n FROM sg JOIN fr USING (key)) WHERE n > 0"
_ended = "SELECT key, (max(i) - 15) // 8 AS last FROM sg GROUP BY key"
_stream("overlapped", lambda x: signals.overlapped(x, 16, 8, lambda frame: frame * 0.5), "SELECT 1")
ORACLES["overlapped"] = f"WITH {_signals}, fr AS ({_ended}) SELECT key, i, {r('v * 0.5 * n', 4)} AS v FROM (SELECT key, i, v, last, (SELECT count(*) FROM range(last + 1) g(f) WHERE i - 8 * f BETWEEN 0 AND 15) AS n FROM sg JOIN fr USING (key)) WHERE i < 8 * (last + 1)"


def _lossy(s: SparkSession, d: str) -> DataFrame:
    """Running sums of the ten signals, of which every 37th event is lost; what waits for it is given up by the event's number as time."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    source = s.readStream.schema(schema).parquet(f"{d}/events.parquet*").filter("event_id % 37 <> 5")
    at = F.timestamp_seconds(F.col("event_id") + 1)
    samples = source.select(F.pmod("event_id", F.lit(10)).cast("string").alias("key"), F.floor(F.col("event_id") / 10).alias("i"), F.col("value").alias("v"), at.alias("ts"))
    path = scratch(s)
    summed = signals.accumulate(signals.patient(samples, "ts", "0 seconds", 0))
    summed.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return _rounded(s.read.parquet(f"{path}/out"))


add("stream_loss", _lossy, f"WITH {_signals} SELECT key, i, {r('sum(CASE WHEN (i * 10 + CAST(key AS BIGINT)) % 37 = 5 THEN 0 ELSE v END) OVER (PARTITION BY key ORDER BY i)', 4)} AS v FROM sg WHERE i <= (SELECT max(o.i) FROM sg o WHERE o.key = sg.key AND (o.i * 10 + CAST(o.key AS BIGINT)) % 37 <> 5)")
_stream("accumulate", signals.accumulate, f"SELECT key, i, {r('sum(v) OVER (PARTITION BY key ORDER BY i)', 4)} AS v FROM sg")
for _name, _args, _eps in (("butter", (), "1"), ("cheby1", (1.0,), "sqrt(pow(10, 0.1) - 1)"), ("cheby2", (40.0,), "sqrt(pow(10, 4.0) - 1)"), ("ellip", (1.0, 40.0), "sqrt(pow(10, 0.1) - 1)")):
    _c = f"(2 * tan(pi() * 0.2) / {_eps})"
    _stream(
        f"rt{_name}",
        lambda x, n=_name, a=_args: signals.rt(n, x, 1, "lowpass", 0.2, *a, rate=1.0),
        f", f AS (SELECT key, i, v AS x, {_c} / (2 + {_c}) * v AS y FROM sg WHERE i = 0 UNION ALL SELECT l.key, l.i, l.v, {_c} / (2 + {_c}) * (l.v + f.x) - ({_c} - 2) / (2 + {_c}) * f.y FROM f JOIN sg l ON l.key = f.key AND l.i = f.i + 1) SELECT key, i, {r('y', 4)} AS v FROM f",
    )


def _channels(s: SparkSession, d: str) -> DataFrame:
    return views.table(s, d, "events").select(F.col("event_id").alias("i"), F.col("value").alias("left"), (F.col("value") * -2).alias("right"))


add("pack", lambda s, d: _rounded(signals.pack(_channels(s, d), ["left", "right"])), f"SELECT event_id AS i, CAST(c AS INTEGER) AS channel, {r('value * [1, -2][c + 1]', 4)} AS v FROM events, range(2) g(c)")
add("unpack", lambda s, d: _rounded(signals.unpack(signals.pack(_channels(s, d), ["left", "right"]), 2)[1]), f"SELECT event_id AS i, {r('value * -2', 4)} AS v FROM events")


def _published(s: SparkSession, d: str, trigger) -> DataFrame:
    """A table that batches of a stream are published to while a trigger holds, as it is after the last one."""
    name, path = f"p_{uuid.uuid4().hex}", scratch(s)
    source = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")

    def publish(batch: DataFrame, k: int) -> None:
        batch.select("event_id", "value").write.parquet(f"{path}/{k}")
        batch.sparkSession.read.parquet(f"{path}/{k}").createOrReplaceGlobalTempView(name)

    signals.triggered(source, publish, trigger).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return signals.frozen(s, f"global_temp.{name}").groupBy().agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))


for _name in ("k", "i"):
    add(_name, lambda s, d: _published(s, d, lambda batch: not batch.isEmpty()), "SELECT count(*) AS n, round(sum(value), 2) AS v FROM events")
