"""Queries over the sample tables, one for each operator or form of it, with the same in SQL.

A query reads whole tables. Values are rounded, as sums of doubles depend on their order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reals
from ..operators import convolution, creation, elementwise, fourier, indexing, lanes, linalg, reductions, shape, sorting, strings, windows
from ..tensor import Tensor
from . import views
from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def shown(t: Tensor, digits: int = DIGITS) -> DataFrame:
    """Places and rounded values."""
    return t.df.select(*t.places, (F.round("v", digits) + 0.0).alias("v"))


def shown_complex(t: Tensor, digits: int = DIGITS) -> DataFrame:
    return t.df.select(*t.places, (F.round("v.re", digits) + 0.0).alias("re"), (F.round("v.im", digits) + 0.0).alias("im"))


def r(sql: str, digits: int = DIGITS) -> str:
    return f"round({sql}, {digits}) + 0.0"


# elementwise: x over events

NAN_SOME = "CASE WHEN event_id % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 7 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END"
SIGNED, SMALL, ABOVE = "value / 100 - 1", "value / 400 - 0.3", "value / 100 + 1"
UNARY = {
    "abs": (SIGNED, "abs(x)"),
    "sign": ("floor(value / 100) - 1", "CAST(sign(x) AS DOUBLE)"),
    "floor": (SIGNED, "floor(x)"),
    "ceil": (SIGNED, "ceil(x)"),
    "round": ("floor(value) / 2", "round_even(x, 0)"),
    "exp": (SMALL, "exp(x)"),
    "sqrt": ("value", "sqrt(x)"),
    "cbrt": (SIGNED, "cbrt(x)"),
    "sin": (SIGNED, "sin(x)"),
    "cos": (SIGNED, "cos(x)"),
    "tan": (SMALL, "tan(x)"),
    "asin": (SMALL, "asin(x)"),
    "acos": (SMALL, "acos(x)"),
    "atan": (SIGNED, "atan(x)"),
    "sinh": (SMALL, "sinh(x)"),
    "cosh": (SMALL, "cosh(x)"),
    "tanh": (SMALL, "tanh(x)"),
    "asinh": (SIGNED, "asinh(x)"),
    "acosh": (ABOVE, "acosh(x)"),
    "atanh": (SMALL, "atanh(x)"),
    "degtorad": (SIGNED, "radians(x)"),
    "radtodeg": (SIGNED, "degrees(x)"),
    "isnan": (NAN_SOME, "CAST(isnan(x) AS DOUBLE)"),
    "isinf": (NAN_SOME, "CAST(isinf(x) AS DOUBLE)"),
    "isfin": (NAN_SOME, "CAST(isfinite(x) AS DOUBLE)"),
    "logicnot": ("floor(value / 20)", "CAST(x = 0 AS DOUBLE)"),
}
for _name, (_x, _sql) in UNARY.items():
    add(_name, lambda s, d, n=_name, x=_x: shown(elementwise.unary(n, views.events(s, d, x))), f"SELECT i0, {r(_sql)} AS v FROM (SELECT event_id AS i0, CAST({_x} AS DOUBLE) AS x FROM events)")

Y = "event_id % 7 - 3"
POSITIVE = "event_id % 7 + 1.5"
BINARY = {
    "add": (SIGNED, Y, "x + y"),
    "subtract": (SIGNED, Y, "x - y"),
    "mul": (SIGNED, Y, "x * y"),
    "div": (SIGNED, POSITIVE, "x / y"),
    "pow": ("value / 100", POSITIVE, "pow(x, y)"),
    "log": ("value + 0.1", POSITIVE, "ln(x) / ln(y)"),
    "hypot": (SIGNED, Y, "sqrt(x * x + y * y)"),
    "minimum": (SIGNED, Y, "least(x, y)"),
    "maximum": (SIGNED, Y, "greatest(x, y)"),
    "atan2": (SIGNED, POSITIVE, "atan2(x, y)"),
    "gt": (NAN_SOME, "100", "CAST(x > y AND NOT isnan(x) AS DOUBLE)"),
    "lt": (NAN_SOME, "100", "CAST(x < y AND NOT isnan(x) AS DOUBLE)"),
    "ge": (NAN_SOME, "100", "CAST(x >= y AND NOT isnan(x) AS DOUBLE)"),
    "le": (NAN_SOME, "100", "CAST(x <= y AND NOT isnan(x) AS DOUBLE)"),
    "eq": ("floor(value / 50)", Y, "CAST(x = y AS DOUBLE)"),
    "ne": ("floor(value / 50)", Y, "CAST(x <> y AS DOUBLE)"),
    "logicand": ("floor(value / 20)", Y, "CAST(x <> 0 AND y <> 0 AS DOUBLE)"),
    "logicor": ("floor(value / 20)", Y, "CAST(x <> 0 OR y <> 0 AS DOUBLE)"),
}
for _name, (_x, _y, _sql) in BINARY.items():
    _from = f"(SELECT event_id AS i0, CAST({_x} AS DOUBLE) AS x, CAST({_y} AS DOUBLE) AS y FROM events)"
    add(_name, lambda s, d, n=_name, x=_x, y=_y: shown(elementwise.binary(n, views.events(s, d, x), views.events(s, d, y))), f"SELECT i0, {r(_sql)} AS v FROM {_from}")

_ev = lambda sql, x="value": f"SELECT i0, {r(sql)} AS v FROM (SELECT event_id AS i0, CAST({x} AS DOUBLE) AS x FROM events)"
add("add_scalar", lambda s, d: shown(views.events(s, d) + 2.5), _ev("x + 2.5"))
add("subtract_scalar", lambda s, d: shown(100 - views.events(s, d)), _ev("100 - x"))
add("mul_scalar", lambda s, d: shown(views.events(s, d) * 3), _ev("x * 3"))
add("div_scalar", lambda s, d: shown(views.events(s, d) / 7), _ev("x / 7"))
add("pow_scalar", lambda s, d: shown((views.events(s, d, "value / 100")) ** 2), _ev("x * x", "value / 100"))
add("clip", lambda s, d: shown(elementwise.clip(views.events(s, d), 20, 90)), _ev("least(greatest(x, 20), 90)"))
add("wrap", lambda s, d: shown(elementwise.wrap(views.events(s, d), 2 * math.pi)), _ev("x - 2 * pi() * floor(x / (2 * pi()) + 0.5)"))
add("foreach", lambda s, d: shown(elementwise.foreach(views.events(s, d), lambda v: v * v + 1)), _ev("x * x + 1"))


def _divmod(s: SparkSession, d: str) -> DataFrame:
    q, m = elementwise.divmod_(views.events(s, d, SIGNED), -0.7)
    return shown(q).withColumnRenamed("v", "q").join(shown(m).withColumnRenamed("v", "m"), "i0")


add("divmod", _divmod, f"SELECT i0, {r('floor(x / -0.7)')} AS q, {r('x + 0.7 * floor(x / -0.7)')} AS m FROM (SELECT event_id AS i0, CAST({SIGNED} AS DOUBLE) AS x FROM events)")
_mask = "floor(value / 50) % 2"
add("where", lambda s, d: shown(elementwise.where(views.events(s, d, _mask), views.events(s, d), views.events(s, d, Y))), f"SELECT event_id AS i0, {r(f'CASE WHEN {_mask} <> 0 THEN value ELSE CAST({Y} AS DOUBLE) END')} AS v FROM events")
add("putmask", lambda s, d: shown(elementwise.putmask(views.events(s, d), -1.0, views.events(s, d, _mask))), f"SELECT event_id AS i0, {r(f'CASE WHEN {_mask} <> 0 THEN -1.0 ELSE value END')} AS v FROM events")


def _broadcast(s: SparkSession, d: str) -> DataFrame:
    t = views.embeddings(s, d)
    return shown(t - reductions.reduce("mean", t, 0))


add("broadcast_subtract", _broadcast, with_views(f"SELECT i0, e.i1, {r('v - m')} AS v FROM emb e JOIN (SELECT i1, avg(v) AS m FROM emb GROUP BY i1) a ON e.i1 = a.i1", "emb"))

# complex

_cx = lambda re, im: with_views(f"SELECT i0, i1, {r(re)} AS re, {r(im)} AS im FROM cplx", "emb", "cplx")
_cr = lambda sql: with_views(f"SELECT i0, i1, {r(sql)} AS v FROM cplx", "emb", "cplx")
_h = "sqrt(re * re + im * im)"
COMPLEX = {
    "exp": ("exp(re) * cos(im)", "exp(re) * sin(im)"),
    "sqrt": (f"sqrt({_h}) * cos(atan2(im, re) / 2)", f"sqrt({_h}) * sin(atan2(im, re) / 2)"),
    "sin": ("sin(re) * cosh(im)", "cos(re) * sinh(im)"),
    "cos": ("cos(re) * cosh(im)", "-sin(re) * sinh(im)"),
    "sinh": ("sinh(re) * cos(im)", "cosh(re) * sin(im)"),
    "cosh": ("cosh(re) * cos(im)", "sinh(re) * sin(im)"),
}
for _name, (_re, _im) in COMPLEX.items():
    add(f"complex_{_name}", lambda s, d, n=_name: shown_complex(elementwise.unary(n, views.complex_embeddings(s, d))), _cx(_re, _im))
add("complex_abs", lambda s, d: shown(elementwise.unary("abs", views.complex_embeddings(s, d))), _cr(_h))
add("complex_add", lambda s, d: shown_complex(views.complex_embeddings(s, d) + (1 - 2j)), _cx("re + 1", "im - 2"))
add("complex_mul", lambda s, d: shown_complex(views.complex_embeddings(s, d) * (1 - 2j)), _cx("re + 2 * im", "im - 2 * re"))
add("complex_div", lambda s, d: shown_complex(views.complex_embeddings(s, d) / (1 - 2j)), _cx("(re - 2 * im) / 5", "(im + 2 * re) / 5"))
add("real", lambda s, d: shown(elementwise.real(views.complex_embeddings(s, d))), _cr("re"))
add("toreal", lambda s, d: shown(elementwise.toreal(views.complex_embeddings(s, d))), _cr("re"))
add("imag", lambda s, d: shown(elementwise.imag(views.complex_embeddings(s, d))), _cr("im"))
add("angle", lambda s, d: shown(elementwise.angle(views.complex_embeddings(s, d))), _cr("atan2(im, re)"))
add("conj", lambda s, d: shown_complex(elementwise.conj(views.complex_embeddings(s, d))), _cx("re", "-im"))
add("tocomplex", lambda s, d: shown_complex(elementwise.tocomplex(views.embeddings(s, d))), with_views(f"SELECT i0, i1, {r('v')} AS re, 0.0 + 0.0 AS im FROM emb", "emb").replace("0.0 + 0.0 AS im", "CAST(0 AS DOUBLE) AS im"))
add("complex_sum", lambda s, d: shown_complex(reductions.reduce("sum", views.complex_embeddings(s, d), 1)), with_views(f"SELECT i0, {r('sum(re)')} AS re, {r('sum(im)')} AS im FROM cplx GROUP BY i0", "emb", "cplx"))
add("complex_mean", lambda s, d: shown_complex(reductions.reduce("mean", views.complex_embeddings(s, d), 0)), with_views(f"SELECT i1 AS i0, {r('avg(re)')} AS re, {r('avg(im)')} AS im FROM cplx GROUP BY i1", "emb", "cplx"))
add("complex_var", lambda s, d: shown(reductions.reduce("var", views.complex_embeddings(s, d), 0)), with_views(f"SELECT i1 AS i0, {r('var_pop(re) + var_pop(im)')} AS v FROM cplx GROUP BY i1", "emb", "cplx"))

# reductions

REDUCTIONS = {
    "sum": "sum(v)",
    "mean": "avg(v)",
    "min": "min(v)",
    "max": "max(v)",
    "median": "median(v)",
    "rms": "sqrt(avg(v * v))",
    "std": "stddev_pop(v)",
    "var": "var_pop(v)",
    "cntnz": "CAST(count(*) FILTER (v <> 0) AS DOUBLE)",
    "cntnan": "CAST(count(*) FILTER (isnan(v)) AS DOUBLE)",
    "all": "CAST(bool_and(v <> 0) AS DOUBLE)",
    "any": "CAST(bool_or(v <> 0) AS DOUBLE)",
    "dbsum": "10 * log10(sum(pow(10, v / 10)))",
}
for _name, _sql in REDUCTIONS.items():
    add(_name, lambda s, d, n=_name: shown(reductions.reduce(n, views.embeddings(s, d), 0), 5), with_views(f"SELECT i1 AS i0, {r(_sql, 5)} AS v FROM emb GROUP BY i1", "emb"))
    add(f"{_name}_flat", lambda s, d, n=_name: shown(reductions.reduce(n, views.embeddings(s, d)), 4), with_views(f"SELECT {r(_sql, 4)} AS v FROM emb", "emb"))
    add(f"{_name}_lanes", lambda s, d, n=_name: shown(reductions.reduce(n, views.lanes(s, d)), 4), with_views(f"SELECT user_id, {r(_sql, 4)} AS v FROM lanes GROUP BY user_id", "lanes"))
add("prod", lambda s, d: shown(reductions.reduce("prod", views.embeddings(s, d), 1).map(lambda v: reals.log10(F.abs(v)))), with_views(f"SELECT i0, {r('log10(abs(product(v)))')} AS v FROM emb GROUP BY i0", "emb"))
add("sub", lambda s, d: shown(reductions.sub(views.lanes(s, d)), 4), with_views(f"SELECT user_id, {r('2 * arg_min(v, i0) - sum(v)', 4)} AS v FROM lanes GROUP BY user_id", "lanes"))
add("cnteq", lambda s, d: shown(reductions.cnteq(views.sizes(s, d), 7)), with_views("SELECT CAST(count(*) FILTER (v = 7) AS DOUBLE) AS v FROM sizes", "sizes"))
add("percentile", lambda s, d: shown(reductions.percentile(views.embeddings(s, d), 90, 0)), with_views(f"SELECT i1 AS i0, {r('quantile_cont(v, 0.9)')} AS v FROM emb GROUP BY i1", "emb"))
add("quantile", lambda s, d: shown(reductions.quantile(views.lanes(s, d), 0.25)), with_views(f"SELECT user_id, {r('quantile_cont(v, 0.25)')} AS v FROM lanes GROUP BY user_id", "lanes"))
add("argmin", lambda s, d: shown(reductions.argmin(views.embeddings(s, d), 1)), with_views("SELECT i0, CAST(arg_min(i1, struct_pack(v := v, i := i1)) AS DOUBLE) AS v FROM emb GROUP BY i0", "emb"))
add("argmax", lambda s, d: shown(reductions.argmax(views.embeddings(s, d), 1)), with_views("SELECT i0, CAST(arg_max(i1, struct_pack(v := v, i := -i1)) AS DOUBLE) AS v FROM emb GROUP BY i0", "emb"))
add("norm", lambda s, d: shown(reductions.norm(views.embeddings(s, d), 2, 1)), with_views(f"SELECT i0, {r('sqrt(sum(v * v))')} AS v FROM emb GROUP BY i0", "emb"))
add("normalize", lambda s, d: shown(lanes.normalize(views.embeddings(s, d), 2, 1)), with_views(f"SELECT i0, i1, {r('v / sqrt(sum(v * v) OVER (PARTITION BY i0))')} AS v FROM emb", "emb"))
add("strjoin", lambda s, d: strings_joined(s, d), with_views("SELECT string_agg(v, '|' ORDER BY i0) AS v FROM names", "names"))


def strings_joined(s: SparkSession, d: str) -> DataFrame:
    return reductions.strjoin(views.part_names(s, d), "|").df


# lanes

_lane = lambda sql, digits=4: with_views(f"SELECT user_id, i0, {r(sql, digits)} AS v FROM lanes", "lanes")
_over = "OVER (PARTITION BY user_id ORDER BY i0"
_five = f"{_over} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
add("cumsum", lambda s, d: shown(lanes.cumsum(views.lanes(s, d)), 4), _lane(f"sum(v) {_over})"))
add("cumprod", lambda s, d: shown(lanes.cumprod(views.lanes(s, d).map(lambda v: 1 + v / 99_991)), 6), _lane(f"product(1 + v / 99991) {_over})", 6))
add("diff", lambda s, d: shown(lanes.diff(views.lanes(s, d))), with_views(f"SELECT user_id, i0, {r('w - v')} AS v FROM (SELECT *, lead(v) {_over}) AS w FROM lanes) WHERE w IS NOT NULL", "lanes"))
add("grad", lambda s, d: shown(lanes.grad(views.lanes(s, d))), with_views(f"SELECT user_id, i0, {r('CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN b - v WHEN b IS NULL THEN v - a ELSE (b - a) / 2 END')} AS v FROM (SELECT *, lag(v) {_over}) AS a, lead(v) {_over}) AS b FROM lanes)", "lanes"))
for _name, _f in {"movmean": "avg", "movmedian": "median", "movmin": "min", "movmax": "max", "movstd": "stddev_pop", "movvar": "var_pop"}.items():
    add(_name, lambda s, d, n=_name: shown(getattr(lanes, n)(views.lanes(s, d).map(lambda v: v / 97), 5), 7), _lane(f"{_f}(v / 97) {_five}", 7))
_padded = f"list(v) {_five}"
add("medfilt1d", lambda s, d: shown(lanes.medfilt1d(views.lanes(s, d), 5)), with_views(f"SELECT user_id, i0, {r('list_sort(list_concat(w, list_resize([]::DOUBLE[], 5 - len(w), 0.0::DOUBLE)))[3]')} AS v FROM (SELECT *, {_padded} AS w FROM lanes)", "lanes"))
_tau = "(2 * pi())"
add("unwrap", lambda s, d: shown(lanes.unwrap(views.lanes(s, d).map(lambda v: v % F.lit(2 * math.pi)), 2 * math.pi), 4), with_views(
    f"SELECT user_id, i0, {r(f'v + sum(c) {_over})', 4)} AS v FROM (SELECT *, CASE WHEN s IS NULL OR abs(s) < pi() THEN 0 ELSE (s - {_tau} * floor((s + pi()) / {_tau})) - s END AS c FROM (SELECT *, v - lag(v) {_over}) AS s FROM (SELECT user_id, i0, v % {_tau} AS v FROM lanes)))",
    "lanes",
))
add("zcr", lambda s, d: shown(lanes.zcr(views.embeddings(s, d), 1)), with_views(f"SELECT i0, {r('avg(c)')} AS v FROM (SELECT i0, CASE WHEN (v < -1e-10) <> (lag(v) OVER (PARTITION BY i0 ORDER BY i1) < -1e-10) THEN 1.0 ELSE 0.0 END AS c FROM emb) GROUP BY i0", "emb"))
add("cumsum_long", lambda s, d: shown(lanes.cumsum(views.events(s, d)), 3), f"SELECT event_id AS i0, {r('sum(value) OVER (ORDER BY event_id)', 3)} AS v FROM events")
add("movmean_long", lambda s, d: shown(lanes.movmean(views.events(s, d), 7)), f"SELECT event_id AS i0, {r('avg(value) OVER (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} AS v FROM events")

# order and sets

_rank = "CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT)"
add("sort", lambda s, d: shown(sorting.sort(views.events(s, d))), "SELECT CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS i0, round(value, 6) + 0.0 AS v FROM events")
add("sort_lanes", lambda s, d: shown(sorting.sort(views.embeddings(s, d))), with_views(f"SELECT i0, CAST(row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS BIGINT) AS i1, {r('v')} AS v FROM emb", "emb"))
add("argsort", lambda s, d: shown(sorting.argsort(views.embeddings(s, d))), with_views("SELECT i0, CAST(row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS BIGINT) AS i1, CAST(i1 AS DOUBLE) AS v FROM emb", "emb"))
add("unique", lambda s, d: shown(sorting.unique(views.sizes(s, d))), with_views(f"SELECT {_rank} AS i0, v FROM (SELECT DISTINCT v FROM sizes)", "sizes"))
add("argunique", lambda s, d: shown(sorting.argunique(views.sizes(s, d))), with_views(f"SELECT {_rank} AS i0, CAST(0 AS BIGINT) AS i1, CAST(i AS DOUBLE) AS v FROM (SELECT v, min(i0) AS i FROM sizes GROUP BY v)", "sizes"))
add("bincount", lambda s, d: shown(indexing.bincount(views.sizes(s, d))), with_views("SELECT CAST(b AS BIGINT) AS i0, CAST(count(v) AS DOUBLE) AS v FROM generate_series(0, (SELECT CAST(max(v) AS BIGINT) FROM sizes)) g(b) LEFT JOIN sizes ON v = b GROUP BY b", "sizes"))
for _side, _op in (("left", "<"), ("right", "<=")):
    add(f"searchsorted_{_side}", lambda s, d, k=_side: shown(indexing.searchsorted(sorting.sort(views.sizes(s, d)), views.events(s, d, "floor(value)"), k == "right")), with_views(f"SELECT event_id AS i0, CAST((SELECT count(*) FROM sizes WHERE v {_op} floor(value)) AS DOUBLE) AS v FROM events", "sizes"))
_set = lambda s, d, x: sorting.likeset(Tensor(views.table(s, d, "lineitem").filter(f"l_returnflag = '{x}'").select(F.lit(0).alias("i0"), F.col("l_partkey").cast("double").alias("v")), 1))
_sql_set = lambda x: f"(SELECT DISTINCT CAST(l_partkey AS DOUBLE) AS v FROM lineitem WHERE l_returnflag = '{x}')"
add("likeset", lambda s, d: shown(_set(s, d, "A")), f"SELECT {_rank} AS i0, v FROM {_sql_set('A')}")
add("unlikeset", lambda s, d: shown(sorting.unlikeset(_set(s, d, "A"))), f"SELECT {_rank} AS i0, v FROM {_sql_set('A')}")
for _name, _word in {"setunion": "UNION", "setintersect": "INTERSECT", "setdiff": "EXCEPT"}.items():
    add(_name, lambda s, d, n=_name: shown(getattr(sorting, n)(_set(s, d, "A"), _set(s, d, "R"))), f"SELECT {_rank} AS i0, v FROM ({_sql_set('A')} {_word} {_sql_set('R')})")
_sym = f"(({_sql_set('A')} EXCEPT {_sql_set('R')}) UNION ({_sql_set('R')} EXCEPT {_sql_set('A')}))"
add("setsymdiff", lambda s, d: shown(sorting.setsymdiff(_set(s, d, "A"), _set(s, d, "R"))), f"SELECT {_rank} AS i0, v FROM {_sym}")
add("setinsert", lambda s, d: shown(sorting.setinsert(_set(s, d, "A"), -5)), f"SELECT {_rank} AS i0, v FROM ({_sql_set('A')} UNION SELECT CAST(-5 AS DOUBLE))")
add("setremove", lambda s, d: shown(sorting.setremove(_set(s, d, "A"), 7)), f"SELECT {_rank} AS i0, v FROM {_sql_set('A')} WHERE v <> 7")
_one = lambda s, x: s.range(1).select(F.lit(x).alias("v"))
add("setcontains", lambda s, d: _one(s, sorting.setcontains(_set(s, d, "A"), 7)), f"SELECT CAST(count(*) > 0 AS DOUBLE) AS v FROM {_sql_set('A')} WHERE v = 7")
add("setissubset", lambda s, d: _one(s, sorting.setissubset(_set(s, d, "A"), _set(s, d, "R"))), f"SELECT CAST(count(*) = 0 AS DOUBLE) AS v FROM ({_sql_set('A')} EXCEPT {_sql_set('R')})")
add("setissuperset", lambda s, d: _one(s, sorting.setissuperset(_set(s, d, "A"), _set(s, d, "R"))), f"SELECT CAST(count(*) = 0 AS DOUBLE) AS v FROM ({_sql_set('R')} EXCEPT {_sql_set('A')})")
add("setisdisjoint", lambda s, d: _one(s, sorting.setisdisjoint(_set(s, d, "A"), _set(s, d, "R"))), f"SELECT CAST(count(*) = 0 AS DOUBLE) AS v FROM ({_sql_set('A')} INTERSECT {_sql_set('R')})")
add("setisequal", lambda s, d: _one(s, sorting.setisequal(_set(s, d, "A"), _set(s, d, "R"))), f"SELECT CAST(count(*) = 0 AS DOUBLE) AS v FROM {_sym}")

# shape and indexing, on a matrix

_e = lambda sql: with_views(sql, "emb")
_v = r("v")
SHAPES = {
    "reshape": (lambda t: shape.reshape(t, t.shape[0] * 2, 32), f"SELECT (i0 * 64 + i1) // 32 AS i0, (i0 * 64 + i1) % 32 AS i1, {_v} AS v FROM emb"),
    "flatten": (shape.flatten, f"SELECT i0 * 64 + i1 AS i0, {_v} AS v FROM emb"),
    "transpose": (shape.transpose, f"SELECT i1 AS i0, i0 AS i1, {_v} AS v FROM emb"),
    "flip": (lambda t: shape.flip(t, 1), f"SELECT i0, 63 - i1 AS i1, {_v} AS v FROM emb"),
    "roll": (lambda t: shape.roll(t, 5, 1), f"SELECT i0, (i1 + 5) % 64 AS i1, {_v} AS v FROM emb"),
    "reverse": (shape.reverse, f"SELECT (SELECT max(i0) FROM emb) - i0 AS i0, 63 - i1 AS i1, {_v} AS v FROM emb"),
    "truncate": (lambda t: shape.truncate(t, 10, 1), f"SELECT i0, i1, {_v} AS v FROM emb WHERE i1 < 10"),
    "pad": (lambda t: shape.pad(t, 1, 2, 9.0, 1), f"SELECT i0, i1 + 1 AS i1, {_v} AS v FROM emb UNION ALL SELECT i0, i1, CAST(9 AS DOUBLE) FROM (SELECT DISTINCT i0 FROM emb), (SELECT CAST(unnest([0, 65, 66]) AS BIGINT) AS i1)"),
    "concat": (lambda t: shape.concat(t, t, 1), f"SELECT i0, i1, {_v} AS v FROM emb UNION ALL SELECT i0, i1 + 64, {_v} FROM emb"),
    "frame": (lambda t: shape.frame(t, 8, 4), f"SELECT i0, CAST(f AS BIGINT) AS i1, CAST(i1 - 4 * f AS BIGINT) AS i2, {_v} AS v FROM emb JOIN range(15) g(f) ON i1 - 4 * f BETWEEN 0 AND 7"),
    "insert": (lambda t: shape.insert(t, 3, reductions.reduce("sum", t, 1), 1), f"SELECT i0, CASE WHEN i1 >= 3 THEN i1 + 1 ELSE i1 END AS i1, {_v} AS v FROM emb UNION ALL SELECT i0, CAST(3 AS BIGINT), {r('sum(v)')} FROM emb GROUP BY i0"),
    "remove": (lambda t: shape.remove(t, 3, 2, 1)[0], f"SELECT i0, CASE WHEN i1 >= 5 THEN i1 - 2 ELSE i1 END AS i1, {_v} AS v FROM emb WHERE i1 NOT IN (3, 4)"),
    "get": (lambda t: indexing.get(t, 3, 5), f"SELECT {_v} AS v FROM emb WHERE i0 = 3 AND i1 = 5"),
    "set": (lambda t: indexing.set(t, -1.0, 3, 5), f"SELECT i0, i1, {r('CASE WHEN i0 = 3 AND i1 = 5 THEN -1 ELSE v END')} AS v FROM emb"),
    "getrow": (lambda t: indexing.getrow(t, 3), f"SELECT i1 AS i0, {_v} AS v FROM emb WHERE i0 = 3"),
    "getcol": (lambda t: indexing.getcol(t, 3), f"SELECT i0, {_v} AS v FROM emb WHERE i1 = 3"),
    "take": (lambda t: indexing.take(t, 7, 1), f"SELECT i0, {_v} AS v FROM emb WHERE i1 = 7"),
    "getslice": (lambda t: indexing.getslice(t, 4, 20, 3, 1), f"SELECT i0, (i1 - 4) // 3 AS i1, {_v} AS v FROM emb WHERE i1 >= 4 AND i1 < 20 AND (i1 - 4) % 3 = 0"),
    "slice_syntax": (lambda t: t[4:20:3, 1], f"SELECT i0, (i1 - 4) // 3 AS i1, {_v} AS v FROM emb WHERE i1 >= 4 AND i1 <= 20 AND (i1 - 4) % 3 = 0"),
    "setslice": (lambda t: indexing.setslice(t, creation.like(indexing.getslice(t, 4, 20, 3, 1), 0.0), 4, 20, 3, 1), f"SELECT i0, i1, {r('CASE WHEN i1 >= 4 AND i1 < 20 AND (i1 - 4) % 3 = 0 THEN 0 ELSE v END')} AS v FROM emb"),
    "select": (lambda t: indexing.select(t, elementwise.binary("gt", t, 0.1)), f"SELECT CAST(row_number() OVER (ORDER BY i0, i1) - 1 AS BIGINT) AS i0, {_v} AS v FROM emb WHERE v > 0.1"),
    "compress": (lambda t: indexing.compress(t, elementwise.binary("gt", reductions.reduce("mean", t, 0), 0.0), 1), f"SELECT i0, k AS i1, {_v} AS v FROM emb JOIN (SELECT i1 AS j, CAST(row_number() OVER (ORDER BY i1) - 1 AS BIGINT) AS k FROM (SELECT i1, avg(v) AS m FROM emb GROUP BY i1) WHERE m > 0) ON i1 = j"),
    "argnonzero": (lambda t: indexing.argnonzero(elementwise.binary("gt", t, 0.3)), "SELECT k AS i0, CAST(c AS BIGINT) AS i1, CAST(CASE c WHEN 0 THEN i0 ELSE i1 END AS DOUBLE) AS v FROM (SELECT i0, i1, CAST(row_number() OVER (ORDER BY i0, i1) - 1 AS BIGINT) AS k FROM emb WHERE v > 0.3), (SELECT unnest([0, 1]) AS c)"),
    "like": (lambda t: creation.like(t, 2.0), "SELECT i0, i1, CAST(2 AS DOUBLE) AS v FROM emb"),
    "copy": (creation.copy, f"SELECT i0, i1, {_v} AS v FROM emb"),
    "dot": (lambda t: linalg.dot(indexing.getrow(t, 1), indexing.getrow(t, 2)), f"SELECT {r('sum(a.v * b.v)')} AS v FROM emb a JOIN emb b ON a.i1 = b.i1 WHERE a.i0 = 1 AND b.i0 = 2"),
    "outer": (lambda t: linalg.outer(indexing.getrow(t, 1), indexing.getrow(t, 2)), f"SELECT a.i1 AS i0, b.i1, {r('a.v * b.v')} AS v FROM emb a, emb b WHERE a.i0 = 1 AND b.i0 = 2"),
    "dist": (lambda t: linalg.dist(indexing.getrow(t, 1), indexing.getrow(t, 2), 3), f"SELECT {r('pow(sum(pow(abs(a.v - b.v), 3)), 1 / 3.0::DOUBLE)')} AS v FROM emb a JOIN emb b ON a.i1 = b.i1 WHERE a.i0 = 1 AND b.i0 = 2"),
    "pairdist": (lambda t: linalg.pairdist(t, shape.flip(t, 1)), f"SELECT a.i0, a.i1, {r('abs(a.v - b.v)')} AS v FROM emb a JOIN emb b ON a.i0 = b.i0 AND a.i1 = 63 - b.i1"),
    "angledist": (lambda t: linalg.angledist(indexing.getrow(t, 1), indexing.getrow(t, 2)), f"SELECT {r('acos(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)))')} AS v FROM emb a JOIN emb b ON a.i1 = b.i1 WHERE a.i0 = 1 AND b.i0 = 2"),
    "amdf": (lambda t: convolution.amdf(t, 6), f"SELECT a.i0, a.i1 - b.i1 AS i1, {r('avg(abs(a.v - b.v))')} AS v FROM emb a JOIN emb b ON a.i0 = b.i0 AND a.i1 - b.i1 BETWEEN 0 AND 6 GROUP BY a.i0, a.i1 - b.i1"),
}
for _name, (_f, _sql) in SHAPES.items():
    add(_name, lambda s, d, f=_f: shown(f(views.embeddings(s, d))), _e(_sql))
_ab = "FROM emb a JOIN emb b ON a.i1 = b.i1 WHERE a.i0 = 1 AND b.i0 = 2"
_share = f"(SELECT sum(a.v * b.v) / sum(b.v * b.v) {_ab})"
for _name, _sql in {"project": f"{_share} * b.v", "reject": f"a.v - {_share} * b.v", "reflect": f"a.v - 2 * {_share} * b.v"}.items():
    add(_name, lambda s, d, n=_name: shown(getattr(linalg, n)(indexing.getrow(views.embeddings(s, d), 1), indexing.getrow(views.embeddings(s, d), 2))), _e(f"SELECT a.i1 AS i0, {r(_sql)} AS v {_ab}"))
add("head", lambda s, d: shown(shape.head(views.sizes(s, d), 50)), with_views("SELECT i0, v FROM sizes WHERE i0 < 50", "sizes"))
add("stack", lambda s, d: shown(shape.stack(views.sizes(s, d), views.sizes(s, d) * 2)), with_views("SELECT CAST(0 AS BIGINT) AS i0, i0 AS i1, v FROM sizes UNION ALL SELECT 1, i0, 2 * v FROM sizes", "sizes"))
add("push", lambda s, d: shown(shape.push(views.sizes(s, d), 99)), with_views("SELECT i0, v FROM sizes UNION ALL SELECT max(i0) + 1, 99 FROM sizes", "sizes"))
add("pop", lambda s, d: shown(shape.pop(views.sizes(s, d))[0]), with_views("SELECT i0, v FROM sizes WHERE i0 < (SELECT max(i0) FROM sizes)", "sizes"))
add("resize", lambda s, d: shown(shape.resize(shape.flatten(views.embeddings(s, d)), 10, 7)), _e(f"SELECT (i0 * 64 + i1) // 7 AS i0, (i0 * 64 + i1) % 7 AS i1, {_v} AS v FROM emb WHERE i0 * 64 + i1 < 70"))
add("argwhere", lambda s, d: shown(indexing.argwhere(views.sizes(s, d), creation.fromarray(s, [3.0, 5.0]))), with_views("SELECT CAST(row_number() OVER (ORDER BY i0) - 1 AS BIGINT) AS i0, CAST(0 AS BIGINT) AS i1, CAST(i0 AS DOUBLE) AS v FROM sizes WHERE v IN (3, 5)", "sizes"))
add("argisnan", lambda s, d: shown(indexing.argisnan(views.events(s, d, NAN_SOME))), "SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS i0, CAST(0 AS BIGINT) AS i1, CAST(event_id AS DOUBLE) AS v FROM events WHERE event_id % 5 = 0")
add("indexof", lambda s, d: shown(indexing.indexof(views.sizes(s, d), 7)), with_views("SELECT CAST(0 AS BIGINT) AS i0, CAST(min(i0) AS DOUBLE) AS v FROM sizes WHERE v = 7 HAVING count(*) > 0", "sizes"))

# creation and closed forms

_series = lambda n, v: f"SELECT CAST(i AS BIGINT) AS i0, {r(v)} AS v FROM range({n}) g(i)"
add("zeros", lambda s, d: shown(creation.zeros(s, (5,))), _series(5, "0.0::DOUBLE"))
add("ones", lambda s, d: shown(creation.ones(s, (5,))), _series(5, "1.0::DOUBLE"))
add("full", lambda s, d: shown(creation.full(s, (5,), 2.5)), _series(5, "2.5::DOUBLE"))
add("identity", lambda s, d: shown(creation.identity(s, 4)), "SELECT CAST(i AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1, CAST(i = j AS DOUBLE) AS v FROM range(4) g(i), range(4) h(j)")
add("arange", lambda s, d: shown(creation.arange(s, 1, 8, 0.5)), _series(14, "1 + i * 0.5::DOUBLE"))
add("linspace", lambda s, d: shown(creation.linspace(s, -1, 1, 9)), _series(9, "-1 + i * 0.25::DOUBLE"))
add("logspace", lambda s, d: shown(creation.logspace(s, 0, 2, 9)), _series(9, "pow(10, i * 0.25::DOUBLE)"))
add("geomspace", lambda s, d: shown(creation.geomspace(s, 1, 81, 5)), _series(5, "pow(3.0::DOUBLE, i)"))
add("hilbertmat", lambda s, d: shown(linalg.hilbertmat(s, 6)), f"SELECT CAST(i AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1, {r('1 / (i + j + 1.0::DOUBLE)')} AS v FROM range(6) g(i), range(6) h(j)")
_x = "(i / 32.0::DOUBLE)"
add("hanning", lambda s, d: shown(windows.hanning(s, 33)), _series(33, f"0.5 - 0.5 * cos(2 * pi() * {_x})"))
add("hamming", lambda s, d: shown(windows.hamming(s, 33)), _series(33, f"0.54 - 0.46 * cos(2 * pi() * {_x})"))
add("bartlett", lambda s, d: shown(windows.bartlett(s, 33)), _series(33, f"CASE WHEN {_x} <= 0.5 THEN 2 * {_x} ELSE 2 - 2 * {_x} END"))
add("blackman", lambda s, d: shown(windows.blackman(s, 33)), _series(33, f"0.42 - 0.5 * cos(2 * pi() * {_x}) + 0.08 * cos(4 * pi() * {_x})"))
add("fftfreq", lambda s, d: shown(fourier.fftfreq(s, 8, 0.125)), _series(8, "CASE WHEN i < 4 THEN i ELSE i - 8 END / 1.0::DOUBLE"))
add("rfftfreq", lambda s, d: shown(fourier.rfftfreq(s, 8, 0.125)), _series(5, "i / 1.0::DOUBLE"))

# products with kernels, transforms, interpolation

_taps = "(SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS k, unnest([0.5, 1.0, -0.25])::DOUBLE AS h)"
_kernel = lambda s: creation.fromarray(s, [0.5, 1.0, -0.25])
add("convolve1d", lambda s, d: shown(convolution.convolve1d(views.embeddings(s, d), _kernel(s), axis=1)), _e(f"SELECT i0, i1 + k AS i1, {r('sum(v * h)')} AS v FROM emb, {_taps} GROUP BY i0, i1 + k"))
add("convolve1d_same", lambda s, d: shown(convolution.convolve1d(views.embeddings(s, d), _kernel(s), "same", 1)), _e(f"SELECT i0, i1 + k - 1 AS i1, {r('sum(v * h)')} AS v FROM emb, {_taps} WHERE i1 + k - 1 BETWEEN 0 AND 63 GROUP BY i0, i1 + k - 1"))
add("correlate1d", lambda s, d: shown(convolution.correlate1d(views.embeddings(s, d), _kernel(s), axis=1)), _e(f"SELECT i0, i1 + 2 - k AS i1, {r('sum(v * h)')} AS v FROM emb, {_taps} GROUP BY i0, i1 + 2 - k"))
_taps2 = "(SELECT CAST(i AS BIGINT) AS p, CAST(j AS BIGINT) AS q, (1 + i + 2 * j)::DOUBLE AS h FROM range(2) g(i), range(2) g2(j))"
_kernel2 = lambda s: creation.fromarray(s, [[1.0, 3.0], [2.0, 4.0]])
add("convolve", lambda s, d: shown(convolution.convolve(views.embeddings(s, d), _kernel2(s))), _e(f"SELECT i0 + p AS i0, i1 + q AS i1, {r('sum(v * h)')} AS v FROM emb, {_taps2} GROUP BY i0 + p, i1 + q"))
add("correlate", lambda s, d: shown(convolution.correlate(views.embeddings(s, d), _kernel2(s))), _e(f"SELECT i0 + 1 - p AS i0, i1 + 1 - q AS i1, {r('sum(v * h)')} AS v FROM emb, {_taps2} GROUP BY i0 + 1 - p, i1 + 1 - q"))
for _name in ("fftconvolve1d", "fftcorrelate1d", "fftconvolve", "fftcorrelate"):
    add(_name, lambda s, d, n=_name: shown(getattr(convolution, n)(views.embeddings(s, d), _kernel2(s) if "1d" not in n else _kernel(s), **({"axis": 1} if "1d" in n else {}))), ORACLES[_name[3:]])
add("deconvolve1d", lambda s, d: shown(convolution.deconvolve1d(convolution.convolve1d(views.embeddings(s, d), _kernel(s), axis=1), _kernel(s), 1)), _e(f"SELECT i0, i1, {_v} AS v FROM emb"))
add("decorrelate1d", lambda s, d: shown(convolution.decorrelate1d(convolution.correlate1d(views.embeddings(s, d), creation.fromarray(s, [-0.25, 1.0, 2.0]), axis=1), creation.fromarray(s, [-0.25, 1.0, 2.0]), 1)), _e(f"SELECT i0, i1, {_v} AS v FROM emb"))
_bins = lambda n: f"(SELECT CAST(b AS BIGINT) AS b FROM range({n}) g(b))"
_turn = "-2 * pi() * ((b * i1) % 64) / 64"
_dft = f"SELECT i0, b AS i1, {r(f'sum(v * cos({_turn}))', 5)} AS re, {r(f'sum(v * sin({_turn}))', 5)} AS im FROM emb, "
add("dft", lambda s, d: shown_complex(fourier.dft(views.embeddings(s, d)), 5), _e(_dft + f"{_bins(64)} GROUP BY i0, b"))
add("fft", lambda s, d: shown_complex(fourier.fft(views.embeddings(s, d)), 5), _e(_dft + f"{_bins(64)} GROUP BY i0, b"))
add("rfft", lambda s, d: shown_complex(fourier.rfft(views.embeddings(s, d)), 5), _e(_dft + f"{_bins(33)} GROUP BY i0, b"))
add("ifft", lambda s, d: shown(elementwise.real(fourier.ifft(fourier.fft(views.embeddings(s, d))))), _e(f"SELECT i0, i1, {_v} AS v FROM emb"))
add("irfft", lambda s, d: shown(fourier.irfft(fourier.rfft(views.embeddings(s, d)))), _e(f"SELECT i0, i1, {_v} AS v FROM emb"))
_cosines = {
    "dctone1d": "CASE WHEN i1 IN (0, 63) THEN 1 ELSE 2 END * cos(pi() * b * i1 / 63)",
    "dcttwo1d": "2 * cos(pi() * b * (2 * i1 + 1) / 128)",
    "dstone1d": "2 * sin(pi() * (b + 1) * (i1 + 1) / 65)",
    "dsttwo1d": "2 * sin(pi() * (b + 1) * (2 * i1 + 1) / 128)",
}
for _name, _sql in _cosines.items():
    add(_name, lambda s, d, n=_name: shown(getattr(fourier, n)(views.embeddings(s, d)), 5), _e(f"SELECT i0, b AS i1, {r(f'sum(v * {_sql})', 5)} AS v FROM emb, {_bins(64)} GROUP BY i0, b"))


def _padded(f) -> Query:
    """A transform in both directions of the whole matrix, whose columns zeros extend to a power of two."""

    def query(s: SparkSession, d: str) -> DataFrame:
        t = views.embeddings(s, d)
        return shown_complex(f(t, fourier.padded_length(t.shape[0])), 5)

    return query


add("hilbert2", _padded(fourier.hilbert2))
# the whole matrix, where the query above with SQL reads its first rows or turns its result back
add("fft2_spectrum", _padded(fourier.fft2))
add("rfft2_spectrum", _padded(fourier.rfft2))
add("hilbert1d_signal", lambda s, d: shown_complex(fourier.hilbert1d(views.embeddings(s, d))))
add("medfilt_whole", lambda s, d: shown(lanes.medfilt(views.embeddings(s, d), 3, 3)))
add("matmul_whole", lambda s, d: shown(linalg.matmul(shape.transpose(views.embeddings(s, d)), views.embeddings(s, d))))
add("inner_whole", lambda s, d: shown(linalg.inner(shape.transpose(views.embeddings(s, d)), shape.transpose(views.embeddings(s, d)))))
_points = "(SELECT CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS k, unnest([0.0, 50.0, 100.0, 200.0])::DOUBLE AS x, unnest([1.0, 3.0, 2.0, 5.0])::DOUBLE AS y)"
_seg = f"(SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM {_points})"
_at = "least(greatest(value, 0), 200)"
INTERP = {
    "linear": "y + (y1 - y) * (a - x) / (x1 - x)",
    "nearest": "CASE WHEN a - x <= x1 - a THEN y ELSE y1 END",
    "previous": "CASE WHEN a >= x1 THEN y1 ELSE y END",
    "next": "CASE WHEN a <= x THEN y ELSE y1 END",
}
_x4, _y4 = lambda s: creation.fromarray(s, [0.0, 50.0, 100.0, 200.0]), lambda s: creation.fromarray(s, [1.0, 3.0, 2.0, 5.0])
for _name, _sql in INTERP.items():
    add(f"interp_{_name}", lambda s, d, m=_name: shown(convolution.interp(views.events(s, d), _x4(s), _y4(s), m)), f"SELECT i0, {r(_sql)} AS v FROM (SELECT event_id AS i0, {_at} AS a FROM events) JOIN {_seg} ON x1 IS NOT NULL AND ((a >= x AND a < x1) OR (a = 200 AND x1 = 200))")
add("interp_cubic", lambda s, d: shown(convolution.interp(views.events(s, d), _x4(s), _y4(s), "cubic")))
add("resample", lambda s, d: shown(convolution.resample(creation.fromarray(s, [0.0, 10.0, 20.0, 30.0]), 7)), _series(7, "5.0::DOUBLE * i"))

# strings

STRINGS = {
    "strupper": ((), "upper(v)"),
    "strlower": ((), "lower(v)"),
    "strcapitalize": ((), "upper(v[1]) || lower(v[2:])"),
    "strswapcase": ((), "translate(v, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')"),
    "strstrip": (("P0t",), "trim(v, 'P0t')"),
    "strlstrip": (("Pa",), "ltrim(v, 'Pa')"),
    "strrstrip": (("0123456789",), "rtrim(v, '0123456789')"),
    "strljust": ((20, "."), "CASE WHEN strlen(v) >= 20 THEN v ELSE rpad(v, 20, '.') END"),
    "strrjust": ((20, "."), "CASE WHEN strlen(v) >= 20 THEN v ELSE lpad(v, 20, '.') END"),
    "strreplace": (("a", "<>"), "replace(v, 'a', '<>')"),
    "strsubstr": ((1, 5), "v[2:5]"),
}
NUMBERS = {
    "strlen": ((), "strlen(v)"),
    "strfind": (("t",), "strpos(v, 't') - 1"),
    "strrfind": (("0",), "CASE WHEN strpos(reverse(v), '0') = 0 THEN -1 ELSE length(v) - strpos(reverse(v), '0') END"),
    "strstartswith": (("P",), "starts_with(v, 'P')"),
    "strendswith": (("0",), "ends_with(v, '0')"),
    "strisalpha": ((), "regexp_full_match(v, '[A-Za-z]+')"),
    "strisdigit": ((), "regexp_full_match(v, '[0-9]+')"),
    "strisalnum": ((), "regexp_full_match(v, '[A-Za-z0-9]+')"),
    "strisspace": ((), "regexp_full_match(v, '\\s+')"),
}
for _name, (_args, _sql) in STRINGS.items():
    add(_name, lambda s, d, n=_name, a=_args: strings.apply(n, views.part_names(s, d), *a).df, with_views(f"SELECT i0, {_sql} AS v FROM names", "names"))
for _name, (_args, _sql) in NUMBERS.items():
    add(_name, lambda s, d, n=_name, a=_args: strings.apply(n, views.part_names(s, d), *a).df, with_views(f"SELECT i0, CAST({_sql} AS DOUBLE) AS v FROM names", "names"))
add("strcenter", lambda s, d: strings.apply("strcenter", views.part_names(s, d), 21, "*").df)
add("strtitle", lambda s, d: strings.apply("strtitle", views.part_names(s, d)).df)
add("strlen_text", lambda s, d: views.table(s, d, "documents").select("doc_id", strings.length(F.col("text")).alias("v")), "SELECT doc_id, CAST(strlen(text) AS DOUBLE) AS v FROM documents")
add("stradd", lambda s, d: (views.part_names(s, d) + "!").df, with_views("SELECT i0, v || '!' AS v FROM names", "names"))
add("strmul", lambda s, d: (views.part_names(s, d) * 2).df, with_views("SELECT i0, repeat(v, 2) AS v FROM names", "names"))
add("strsplit", lambda s, d: strings.spread("strsplit", views.part_names(s, d), "a").df, with_views("SELECT i0, CAST(unnest(range(len(p))) AS BIGINT) AS i1, unnest(p) AS v FROM (SELECT i0, string_split(v, 'a') AS p FROM names)", "names"))
add("strrsplit", lambda s, d: strings.spread("strrsplit", views.part_names(s, d), "a", 1).df)
add("strpartition", lambda s, d: strings.spread("strpartition", views.part_names(s, d), "a").df)
add("strrpartition", lambda s, d: strings.spread("strrpartition", views.part_names(s, d), "a").df)
add("straslist", lambda s, d: strings.spread("straslist", views.part_names(s, d)).df, with_views("SELECT i0, CAST(unnest(range(len(p))) AS BIGINT) AS i1, unnest(p) AS v FROM (SELECT i0, string_split(v, '') AS p FROM names)", "names"))
for _name in ("strtoascii", "strencode", "strtocodepoints"):
    add(_name, lambda s, d, n=_name: strings.spread(n, views.part_names(s, d)).df, with_views("SELECT i0, CAST(unnest(range(len(p))) AS BIGINT) AS i1, CAST(ascii(unnest(p)) AS DOUBLE) AS v FROM (SELECT i0, string_split(v, '') AS p FROM names)", "names"))
add("numtostr", lambda s, d: strings.apply("numtostr", views.sizes(s, d)).df, with_views("SELECT i0, CAST(v AS VARCHAR) AS v FROM sizes", "sizes"))
add("strtonum", lambda s, d: strings.apply("strtonum", strings.apply("numtostr", views.sizes(s, d))).df, with_views("SELECT i0, v FROM sizes", "sizes"))
add("tobinary", lambda s, d: strings.apply("tobinary", views.sizes(s, d), 8).df, with_views("SELECT i0, lpad(bin(CAST(v AS BIGINT)), 8, '0') AS v FROM sizes", "sizes"))
add("tohex", lambda s, d: strings.apply("tohex", views.sizes(s, d), 4).df, with_views("SELECT i0, lpad(hex(CAST(v AS BIGINT)), 4, '0') AS v FROM sizes", "sizes"))
add("frombinary", lambda s, d: strings.apply("frombinary", strings.apply("tobinary", views.sizes(s, d), 8)).df, with_views("SELECT i0, v FROM sizes", "sizes"))
add("fromhex", lambda s, d: strings.apply("fromhex", strings.apply("tohex", views.sizes(s, d), 4)).df, with_views("SELECT i0, v FROM sizes", "sizes"))
add("tobase64", lambda s, d: strings.apply("tobase64", views.part_names(s, d)).df, with_views("SELECT i0, base64(encode(v)) AS v FROM names", "names"))
add("frombase64", lambda s, d: strings.apply("frombase64", strings.apply("tobase64", views.part_names(s, d))).df, with_views("SELECT i0, v FROM names", "names"))
add("tobuffer", lambda s, d: creation.packed(views.lanes(s, d).map(F.floor)).select("user_id", F.hex(strings.tobuffer(F.col("data"), "<u2")).alias("v")))

# coordinates, rooms, levels: columns of lineitem and events

_xyz = "(SELECT event_id AS i0, CAST(value / 100 - 1 AS DOUBLE) AS x, CAST(event_id % 7 - 3 AS DOUBLE) AS y, CAST(event_id % 5 + 0.5 AS DOUBLE) AS z FROM events)"


def _coordinates(f, names: tuple[str, ...], takes: int = 3) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        df = views.table(s, d, "events").select(F.col("event_id").alias("i0"), *(F.expr(f"CAST({e} AS DOUBLE)").alias(c) for c, e in (("x", "value / 100 - 1"), ("y", "event_id % 7 - 3"), ("z", "event_id % 5 + 0.5"))))
        return df.select("i0", *((F.round(c, DIGITS) + 0.0).alias(n) for c, n in zip(f(*(F.col(c) for c in "xyz"[:takes])), names, strict=True)))

    return query


_flat, _deep = "sqrt(x * x + y * y)", "sqrt(x * x + y * y + z * z)"
COORDINATES = {
    "poltocar": (windows.poltocar, 2, ("x * cos(y)", "x * sin(y)")),
    "cartopol": (windows.cartopol, 2, (_flat, "atan2(y, x)")),
    "cyltocar": (windows.cyltocar, 3, ("x * cos(y)", "x * sin(y)", "z")),
    "cartocyl": (windows.cartocyl, 3, (_flat, "atan2(y, x)", "z")),
    "sphtocar": (windows.sphtocar, 3, ("x * sin(y) * cos(z)", "x * sin(y) * sin(z)", "x * cos(y)")),
    "cartosph": (windows.cartosph, 3, (_deep, f"acos(z / {_deep})", "atan2(y, x)")),
    "hoatocar": (windows.hoatocar, 3, ("x * cos(z) * cos(y)", "x * cos(z) * sin(y)", "x * sin(z)")),
    "cartohoa": (windows.cartohoa, 3, (_deep, "atan2(y, x)", f"atan2(z, {_flat})")),
}
for _name, (_f, _n, _parts) in COORDINATES.items():
    _names = ("a", "b", "c")[: len(_parts)]
    add(_name, _coordinates(_f, _names, _n), f"SELECT i0, {', '.join(f'{r(p)} AS {n}' for p, n in zip(_parts, _names, strict=True))} FROM {_xyz}")
ONE_OF_X = {
    "nmtoacn": (lambda x, y, z: (windows.nmtoacn(z, y),), "z * z + z + y"),
    "legendre": (lambda x, y, z: (windows.legendre(x / 4, 2, 0),), "(3 * x * x / 16 - 1) / 2"),
    "sphharm": (lambda x, y, z: (windows.sphharm(1, 1, y, x / 3),), "cos(x / 3) * cos(y)"),
    "samptosec": (lambda x, y, z: (reals.samples_to_seconds(x, 44_100),), "x / 44100"),
    "samptomillis": (lambda x, y, z: (reals.samples_to_millis(x, 44_100),), "x * 1000 / 44100"),
    "sectosamp": (lambda x, y, z: (reals.seconds_to_samples(x, 44_100),), "x * 44100"),
    "millistosamp": (lambda x, y, z: (reals.millis_to_samples(x, 44_100),), "x * 44100 / 1000"),
    "t60sab": (lambda x, y, z: (windows.t60sab(x + 10, z),), "0.161 * (x + 10) / z"),
    "t60eyr": (lambda x, y, z: (windows.t60eyr(x + 10, z + 9, z),), "0.161 * (x + 10) / (-(z + 9) * ln(1 - z / (z + 9)))"),
    "rt60absp": (lambda x, y, z: (windows.rt60absp(x + 10, z),), "0.161 * (x + 10) / z"),
    "fschrd": (lambda x, y, z: (windows.fschrd(x + 10, z),), "2000 * sqrt(z / (x + 10))"),
    "fpqr": (lambda x, y, z: (windows.fpqr(x + 10, z, z + 1, 1, 0, 2),), "343.0 / 2 * sqrt(1 / ((x + 10) * (x + 10)) + 4 / ((z + 1) * (z + 1)))"),
    "t60tofbg": (lambda x, y, z: (windows.t60tofbg(z / 10, x + 2),), "pow(10, -3 * (z / 10) / (x + 2))"),
    "fbgtot60": (lambda x, y, z: (windows.fbgtot60(z / 10, z / 8),), "-3 * (z / 10) / log10(z / 8)"),
}
for _name, (_f, _sql) in ONE_OF_X.items():
    add(_name, _coordinates(_f, ("v",)), f"SELECT i0, {r(_sql)} AS v FROM {_xyz}")
_whole = "(SELECT p_partkey AS i0, CAST(p_size AS DOUBLE) AS x FROM part)"
_n0 = "floor(sqrt(x))"
for _name, _f, _sql in (
    ("acntonm_degree", lambda x: windows.acntonm(x)[0], _n0),
    ("acntonm_order", lambda x: windows.acntonm(x)[1], f"x - {_n0} * {_n0} - {_n0}"),
    ("hoaordtochnls", windows.hoaordtochnls, "(x + 1) * (x + 1)"),
    ("chnlstohoaord", lambda x: windows.chnlstohoaord(x * x), "x - 1"),
    ("sn3dton3d", windows.sn3dton3d, f"sqrt(2 * {_n0} + 1)"),
    ("n3dtosn3d", windows.n3dtosn3d, f"1 / sqrt(2 * {_n0} + 1)"),
):
    add(_name, lambda s, d, f=_f: shown(views.sizes(s, d).map(f)), f"SELECT i0, {r(_sql)} AS v FROM {_whole}")
add("rotmat", lambda s, d: shown(windows.rotmat(s, "z", math.pi / 2)), "SELECT CAST(i AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1, CAST([[0, -1, 0], [1, 0, 0], [0, 0, 1]][i + 1][j + 1] AS DOUBLE) AS v FROM range(3) g(i), range(3) h(j)")
add("rotmatypr", lambda s, d: shown(windows.rotmatypr(s, 0.3, 0.2, 0.1)))


# the flagship: statistics of a moving mean of revenue, by return flag


def revenue(s: SparkSession, d: str) -> DataFrame:
    """Of each return flag's revenue in order: mean, deviation, 90th percentile, and the largest moving mean of 5."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    t = creation.ordered(views.table(s, d, "lineitem"), F.col("l_extendedprice") * (1 - F.col("l_discount")), order, ["l_returnflag"])
    whole = reductions.reduce_many(["mean", "std", "max"], t).join(reductions.percentile(t, 90).df.withColumnRenamed("v", "p90"), "l_returnflag")
    top = reductions.reduce("max", lanes.movmean(t, 5)).df.withColumnRenamed("v", "top")
    return whole.join(top, "l_returnflag").select("l_returnflag", *(F.round(c, 2).alias(c) for c in ("mean", "std", "max", "p90", "top")))


_revenue = "(SELECT l_returnflag, l_extendedprice * (1 - l_discount) AS v, avg(l_extendedprice * (1 - l_discount)) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM lineitem)"
add("revenue", revenue, f"SELECT l_returnflag, round(avg(v), 2) AS mean, round(stddev_pop(v), 2) AS std, round(max(v), 2) AS max, round(quantile_cont(v, 0.9), 2) AS p90, round(max(m), 2) AS top FROM {_revenue} GROUP BY l_returnflag")
