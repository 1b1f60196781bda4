"""Queries of filters, their designs, dense systems and polynomials, with the same in SQL.

Designs are a handful of numbers; their SQL are the closed forms of low orders.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import convolution, creation, filters, fourier, linalg, shape, tiles
from ..tensor import Tensor
from . import views
from .queries import INTERP, ORACLES, QUERIES, add, r, shown, shown_complex
from .views import with_views

# filters along lanes of unequal lengths: the SQL is the recursion, place by place

_LANES = views.SQL["lanes"].replace("AS (", "AS MATERIALIZED (", 1).replace("value AS v", "value / 97 AS v")


def _scaled(s: SparkSession, d: str) -> Tensor:
    """Divided, so that no result lies between two roundings."""
    return views.lanes(s, d).map(lambda v: v / 97)


_B, _A = [0.5, 0.25], [1.0, -0.4]
_SECTIONS = np.array([[0.2, 0.1, 0.05, 1.0, -0.3, 0.1], [1.0, 0.5, 0.0, 1.0, 0.25, 0.0]])
_first_order = f"""WITH RECURSIVE {_LANES}, f AS (
  SELECT user_id, i0, v AS x, 0.5 * v AS y FROM lanes WHERE i0 = 0
  UNION ALL SELECT l.user_id, l.i0, l.v, 0.5 * l.v + 0.25 * f.x + 0.4 * f.y FROM f JOIN lanes l ON l.user_id = f.user_id AND l.i0 = f.i0 + 1) """
_two_sections = f"""WITH RECURSIVE {_LANES}, f AS (
  SELECT user_id, i0, v AS x, CAST(0 AS DOUBLE) AS x1, 0.2 * v AS u, CAST(0 AS DOUBLE) AS u1, 0.2 * v AS y FROM lanes WHERE i0 = 0
  UNION ALL SELECT user_id, i0, x, x1, u, u1, u + 0.5 * u1 - 0.25 * y1 FROM (
    SELECT l.user_id, l.i0, l.v AS x, f.x AS x1, 0.2 * l.v + 0.1 * f.x + 0.05 * f.x1 + 0.3 * f.u - 0.1 * f.u1 AS u, f.u AS u1, f.y AS y1
    FROM f JOIN lanes l ON l.user_id = f.user_id AND l.i0 = f.i0 + 1)) """
_last = "(SELECT user_id, max(i0) AS i0 FROM f GROUP BY user_id)"
add("lfilter", lambda s, d: shown(filters.lfilter(_scaled(s, d), _B, _A)), _first_order + f"SELECT user_id, i0, {r('y')} AS v FROM f")
add("zlfilter", lambda s, d: shown(filters.zlfilter(_scaled(s, d), _B, _A)[1]), _first_order + f"SELECT user_id, CAST(0 AS BIGINT) AS i0, {r('0.25 * x + 0.4 * y')} AS v FROM f JOIN {_last} USING (user_id, i0)")
add("sosfilter", lambda s, d: shown(filters.sosfilter(_scaled(s, d), _SECTIONS)), _two_sections + f"SELECT user_id, i0, {r('y')} AS v FROM f")
_states = "[0.1 * x - -0.3 * u + 0.05 * x1 - 0.1 * u1, 0.05 * x - 0.1 * u, 0.5 * u - 0.25 * y, 0]"
add("zsosfilter", lambda s, d: shown(filters.zsosfilter(_scaled(s, d), _SECTIONS)[1]), _two_sections + f"SELECT user_id, CAST(k AS BIGINT) AS i0, {r(f'CAST({_states}[k + 1] AS DOUBLE)')} AS v FROM f JOIN {_last} USING (user_id, i0), range(4) g(k)")

# designs


def _numbers(s: SparkSession, **parts) -> DataFrame:
    """Rows (part, i0, re, im) of the arrays that a design consists of."""
    rows = [(name, k, float(np.real(x)), float(np.imag(x))) for name, a in parts.items() for k, x in enumerate(np.ravel(a))]
    df = s.createDataFrame(rows, "part string, i0 long, re double, im double")
    return df.select("part", "i0", *((F.round(c, 6) + 0.0).alias(c) for c in ("re", "im")))


def _zpk(f, *args, **kwargs):
    """Zeros and poles are sorted, as they come in no order."""

    def query(s: SparkSession, d: str) -> DataFrame:
        z, p, k = f(*args, **kwargs)
        order = lambda x: np.array(sorted(np.atleast_1d(x), key=lambda c: (round(c.imag, 9), round(c.real, 9))), complex)
        return _numbers(s, z=order(np.asarray(z, complex)), p=order(np.asarray(p, complex)), k=k)

    return query


def _ba(f, *args, **kwargs):
    def query(s: SparkSession, d: str) -> DataFrame:
        b, a = f(*args, **kwargs)
        return _numbers(s, b=b, a=a)

    return query


def _values(*rows: tuple) -> str:
    """SQL of rows (part, i0, re, im)."""
    one = lambda part, k, re, im="0": f"SELECT '{part}' AS part, CAST({k} AS BIGINT) AS i0, {r(f'CAST({re} AS DOUBLE)')} AS re, {r(f'CAST({im} AS DOUBLE)')} AS im"
    return " UNION ALL ".join(one(*x) for x in rows)


_none = (np.zeros(0, complex), np.array([-1.0 + 0j]), 1.0)
add("buttap", _zpk(filters.buttap, 4), f"SELECT 'p' AS part, CAST(k AS BIGINT) AS i0, {r('-cos(pi() * (2 * k - 3) / 8)')} AS re, {r('sin(pi() * (2 * k - 3) / 8)')} AS im FROM range(4) g(k) UNION ALL {_values(('k', 0, 1))}")
add("lptolpzpk", _zpk(filters.lptolpzpk, *_none, 3.0), _values(("p", 0, -3), ("k", 0, 3)))
add("lptohpzpk", _zpk(filters.lptohpzpk, *_none, 3.0), _values(("z", 0, 0), ("p", 0, -3), ("k", 0, 1)))
add("lptobpzpk", _zpk(filters.lptobpzpk, *_none, 2.0, 1.0), _values(("z", 0, 0), ("p", 0, -0.5, "-sqrt(3.75)"), ("p", 1, -0.5, "sqrt(3.75)"), ("k", 0, 1)))
add("lptobszpk", _zpk(filters.lptobszpk, *_none, 2.0, 1.0), _values(("z", 0, 0, -2), ("z", 1, 0, 2), ("p", 0, -0.5, "-sqrt(3.75)"), ("p", 1, -0.5, "sqrt(3.75)"), ("k", 0, 1)))
add("bilinearzpk", _zpk(filters.bilinearzpk, *_none, 2.0), _values(("z", 0, -1), ("p", 0, "3.0 / 5"), ("k", 0, "1.0 / 5")))
add("tftozpk", _zpk(filters.tftozpk, [2.0, -6.0, 4.0], [1.0, 0.0, 0.25]), _values(("z", 0, 1), ("z", 1, 2), ("p", 0, 0, -0.5), ("p", 1, 0, 0.5), ("k", 0, 2)))
add("zpktotf", _ba(filters.zpktotf, np.array([1.0, 2.0]), np.array([0.5j, -0.5j]), 2.0), _values(("b", 0, 2), ("b", 1, -6), ("b", 2, 4), ("a", 0, 1), ("a", 1, 0), ("a", 2, 0.25)))
add("zpktosos", lambda s, d: shown(creation.fromarray(s, filters.zpktosos(np.array([1.0, 2.0]), np.array([0.5j, -0.5j]), 2.0))), f"SELECT CAST(0 AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, {r('CAST([2, -6, 4, 1, 0, 0.25][k + 1] AS DOUBLE)')} AS v FROM range(6) g(k)")
add("lptolp", _ba(filters.lptolp, [1.0], [1.0, 1.0], 3.0), _values(("b", 0, 3), ("a", 0, 1), ("a", 1, 3)))
add("lptohp", _ba(filters.lptohp, [1.0], [1.0, 1.0], 3.0), _values(("b", 0, 1), ("b", 1, 0), ("a", 0, 1), ("a", 1, 3)))
add("lptobp", _ba(filters.lptobp, [1.0], [1.0, 1.0], 2.0, 1.0), _values(("b", 0, 1), ("b", 1, 0), ("a", 0, 1), ("a", 1, 1), ("a", 2, 4)))
add("lptobs", _ba(filters.lptobs, [1.0], [1.0, 1.0], 2.0, 1.0), _values(("b", 0, 1), ("b", 1, 0), ("b", 2, 4), ("a", 0, 1), ("a", 1, 1), ("a", 2, 4)))
# of the second order: with t = tan(pi f)
_t, _n = "tan(pi() * 0.2)", "(1 + sqrt(2) * tan(pi() * 0.2) + pow(tan(pi() * 0.2), 2))"
_butter = [f"pow({_t}, 2) / {_n}", f"2 * pow({_t}, 2) / {_n}", f"pow({_t}, 2) / {_n}", "1", f"2 * (pow({_t}, 2) - 1) / {_n}", f"(1 - sqrt(2) * {_t} + pow({_t}, 2)) / {_n}"]
# of the first order: one pole, by the ripple or the attenuation
_eps = {"cheby1": "sqrt(pow(10, 0.1) - 1)", "ellip": "sqrt(pow(10, 0.1) - 1)", "cheby2": "sqrt(pow(10, 4.0) - 1)"}
_args = {"butter": (), "cheby1": (1.0,), "cheby2": (40.0,), "ellip": (1.0, 40.0)}
for _name in filters.PROTOTYPES:
    _c = f"(2 * {_t} / {_eps.get(_name)})"
    _first = [f"{_c} / (2 + {_c})", f"{_c} / (2 + {_c})", "0", "1", f"({_c} - 2) / (2 + {_c})", "0"]
    _order, _six = (2, _butter) if _name == "butter" else (1, _first)
    _own = (_order, "lowpass", 0.2, *_args[_name])
    _m = _order + 1
    add(f"{_name}ba", _ba(filters.design_ba, _name, *_own, rate=1.0), _values(*(("b", k, _six[k]) for k in range(_m)), *(("a", k, _six[3 + k]) for k in range(_m))))
    _sections = f"SELECT CAST(0 AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, {r('CAST([' + ', '.join(_six) + '][k + 1] AS DOUBLE)')} AS v FROM range(6) g(k)"
    add(f"{_name}sos", lambda s, d, n=_name, own=_own: shown(creation.fromarray(s, filters.design_sos(n, *own, rate=1.0))), _sections)

# what designs of the fourth order let through, at frequencies that events give, against the closed forms


def _passed(name: str, *args: float):
    def query(s: SparkSession, d: str) -> DataFrame:
        b, a = filters.design_ba(name, 4, "lowpass", 0.2, *args, rate=1.0)
        t = views.events(s, d, "0.001 + value % 97 / 97 * 0.48")
        power = lambda c: sum((float(x) * F.cos(2 * np.pi * k * F.col("v")) for k, x in enumerate(c)), F.lit(0.0)) ** 2 + sum((float(x) * F.sin(2 * np.pi * k * F.col("v")) for k, x in enumerate(c)), F.lit(0.0)) ** 2
        return shown(t.map(lambda v: power(b) / power(a)))

    return query


_t4 = lambda x: f"(8 * pow({x}, 4) - 8 * pow({x}, 2) + 1)"
for _name, _more, _sql in (
    ("butter", (), "1 / (1 + pow(x, 8))"),
    ("cheby1", (1.0,), f"1 / (1 + (pow(10, 0.1) - 1) * pow({_t4('x')}, 2))"),
    ("cheby2", (40.0,), f"1 / (1 + (pow(10, 4.0) - 1) / pow({_t4('(1 / x)')}, 2))"),
):
    add(f"response_{_name}", _passed(_name, *_more), f"SELECT i0, {r(_sql)} AS v FROM (SELECT event_id AS i0, tan(pi() * (0.001 + value % 97 / 97 * 0.48)) / tan(pi() * 0.2) AS x FROM events)")

# directions: a rotation by three angles, and harmonics up to the second degree at directions that events give

_ca, _sa, _cb, _sb, _cc, _sc = "cos(0.3)", "sin(0.3)", "cos(-0.2)", "sin(-0.2)", "cos(0.1)", "sin(0.1)"
_rows = f"[[{_ca} * {_cb}, {_ca} * {_sb} * {_sc} - {_sa} * {_cc}, {_ca} * {_sb} * {_cc} + {_sa} * {_sc}], [{_sa} * {_cb}, {_sa} * {_sb} * {_sc} + {_ca} * {_cc}, {_sa} * {_sb} * {_cc} - {_ca} * {_sc}], [-{_sb}, {_cb} * {_sc}, {_cb} * {_cc}]]"
add("rotmatypr", QUERIES["rotmatypr"], f"SELECT CAST(i AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1, {r(f'{_rows}[i + 1][j + 1]')} AS v FROM range(3) g(i), range(3) h(j)")


def _harmonics(s: SparkSession, d: str) -> DataFrame:
    from ..operators import windows

    t = views.events(s, d)
    directions = t.df.select("i0", F.posexplode(F.array(F.col("v") / 50, F.col("v") / 400)).alias("i1", "v")).withColumn("i1", F.col("i1").cast("long"))
    return shown(windows.sphharmacn(Tensor(directions, 2), 2))


_half = "sqrt(3) / 2"
_nine = f"[1, cos(e) * sin(a), sin(e), cos(e) * cos(a), {_half} * pow(cos(e), 2) * sin(2 * a), {_half} * sin(2 * e) * sin(a), (3 * pow(sin(e), 2) - 1) / 2, {_half} * sin(2 * e) * cos(a), {_half} * pow(cos(e), 2) * cos(2 * a)]"
add("sphharmacn", _harmonics, f"SELECT CAST(k AS BIGINT) AS i0, i1, {r(f'{_nine}[k + 1]')} AS v FROM (SELECT event_id AS i1, value / 50 AS a, value / 400 AS e FROM events), range(9) g(k)")

# systems of each four neighbouring cells of a vector, and of three


def _twos(s: SparkSession, d: str) -> Tensor:
    """A matrix of 2 x 2 for each four dimensions, far from singular."""
    t = views.embeddings(s, d)
    row, column = F.floor(F.pmod("i1", F.lit(4)) / 2), F.pmod("i1", F.lit(2))
    cells = t.df.select(F.col("i0").alias("vec"), F.floor(F.col("i1") / 4).alias("part"), row.alias("i0"), column.alias("i1"), (F.col("v") + F.when(row == column, 3.0).otherwise(0.0)).alias("v"))
    return Tensor(cells, 2, ("vec", "part"), (2, 2))


def _threes(s: SparkSession, d: str) -> Tensor:
    t = views.embeddings(s, d)
    cells = t.df.filter("i1 < 63").select(F.col("i0").alias("vec"), F.floor(F.col("i1") / 3).alias("part"), F.pmod("i1", F.lit(3)).alias("i0"), (F.col("v") + F.when(F.pmod("i1", F.lit(3)) == 0, 3.0).otherwise(0.0)).alias("v"))
    return Tensor(cells, 1, ("vec", "part"), (3,))


_at = lambda width, k, more="": f"max(CASE WHEN i1 % {width} = {k} THEN v END){more}"
_two = f"(SELECT i0 AS vec, i1 // 4 AS part, {_at(4, 0, ' + 3')} AS a, {_at(4, 1)} AS b, {_at(4, 2)} AS c, {_at(4, 3, ' + 3')} AS d FROM emb GROUP BY ALL)"
_three = f"(SELECT i0 AS vec, i1 // 3 AS part, {_at(3, 0, ' + 3')} AS a, {_at(3, 1)} AS b, {_at(3, 2)} AS c FROM emb WHERE i1 < 63 GROUP BY ALL)"
_det = "(a * d - b * c)"
_each = lambda n, parts: f"SELECT vec, part, CAST(k AS BIGINT) AS i0, {r('[' + ', '.join(parts) + '][k + 1]')} AS v FROM {{}}, range({n}) g(k)"
add("det", lambda s, d: shown(linalg.det(_twos(s, d))), with_views(f"SELECT vec, part, {r(_det)} AS v FROM {_two}", "emb"))
add("inv", lambda s, d: shown(linalg.inv(_twos(s, d))), with_views(f"SELECT vec, part, CAST(k // 2 AS BIGINT) AS i0, CAST(k % 2 AS BIGINT) AS i1, {r(f'[d, -b, -c, a][k + 1] / {_det}')} AS v FROM {_two}, range(4) g(k)", "emb"))
add("solve", lambda s, d: shown(linalg.solve(_twos(s, d), _right(s, d))), with_views(_each(2, [f"(d - 2 * b) / {_det}", f"(2 * a - c) / {_det}"]).format(_two), "emb"))
add("cross", lambda s, d: shown(linalg.cross(_threes(s, d), shape.flip(_threes(s, d)))), with_views(_each(3, ["b * a - c * b", "c * c - a * a", "a * b - b * c"]).format(_three), "emb"))


def _right(s: SparkSession, d: str) -> Tensor:
    keys = _twos(s, d).df.select("vec", "part").distinct()
    return Tensor(keys.select("vec", "part", F.posexplode(F.array(F.lit(1.0), F.lit(2.0))).alias("i0", "v")).withColumn("i0", F.col("i0").cast("long")), 1, ("vec", "part"), (2,))


def _roots(s: SparkSession, d: str) -> DataFrame:
    """Power sums of the roots, which come in no order."""
    t = convolution.roots(_threes(s, d), 0)
    re, im = F.col("v.re"), F.col("v.im")
    sums = {"re": F.sum(re), "im": F.sum(im), "squares": F.sum(re * re - im * im)}
    return t.df.groupBy("vec", "part").agg(*((F.round(x, 6) + 0.0).alias(n) for n, x in sums.items()))


add("roots", _roots, with_views(f"SELECT vec, part, {r('-b / a')} AS re, CAST(0 AS DOUBLE) AS im, {r('(b * b - 2 * a * c) / (a * a)')} AS squares FROM {_three}", "emb"))


def _cubics(s: SparkSession, d: str) -> DataFrame:
    """Sums of powers of the roots of the cubics that each four dimensions make."""
    t = views.embeddings(s, d)
    first = F.pmod("i1", F.lit(4)) == 0
    cells = t.df.select(F.col("i0").alias("vec"), F.floor(F.col("i1") / 4).alias("part"), F.pmod("i1", F.lit(4)).alias("i0"), (F.col("v") + F.when(first, 2.0).otherwise(0.0)).alias("v"))
    found = convolution.roots(Tensor(cells, 1, ("vec", "part"), (4,)), 0).df
    re, im = F.col("v.re"), F.col("v.im")
    sums = {"one": F.sum(re), "two": F.sum(re * re - im * im), "three": F.sum(re * re * re - 3 * re * im * im)}
    return found.groupBy("vec", "part").agg(*((F.round(x, 6) + 0.0).alias(n) for n, x in sums.items()))


_four = f"(SELECT i0 AS vec, i1 // 4 AS part, {_at(4, 0, ' + 2')} AS a, {_at(4, 1)} AS b, {_at(4, 2)} AS c, {_at(4, 3)} AS d FROM emb GROUP BY ALL)"
add("roots_cubic", _cubics, with_views(f"SELECT vec, part, {r('-b / a')} AS one, {r('(b * b - 2 * a * c) / (a * a)')} AS two, {r('(3 * a * b * c - b * b * b - 3 * a * a * d) / (a * a * a)')} AS three FROM {_four}", "emb"))
add("lagrange", lambda s, d: shown(convolution.lagrange(creation.fromarray(s, [0.0, 1.0, 2.0]), creation.fromarray(s, [1.0, 3.0, 2.0]))), f"SELECT CAST(k AS BIGINT) AS i0, {r('CAST([-1.5, 3.5, 1][k + 1] AS DOUBLE)')} AS v FROM range(3) g(k)")
_fit = "[[-3 / 35.0, 12 / 35.0, 17 / 35.0, 12 / 35.0, -3 / 35.0], [-0.2, -0.1, 0, 0.1, 0.2], [2 / 7.0, -1 / 7.0, -2 / 7.0, -1 / 7.0, 2 / 7.0]]"
add("savgol", lambda s, d: shown(linalg.savgol(s, 5, 2)), f"SELECT CAST(i AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1, {r(f'CAST({_fit}[i + 1][j + 1] AS DOUBLE)')} AS v FROM range(3) g(i), range(5) h(j)")

# inverses of convolutions: back to the matrix

_wide = lambda s: creation.fromarray(s, [[4.0, 1.0], [0.5, -0.5]])
_whole = with_views(f"SELECT i0, i1, {r('v')} AS v FROM emb", "emb")
for _f, _back in ((convolution.convolve, convolution.deconvolve), (convolution.correlate, convolution.decorrelate), (convolution.fftconvolve, convolution.fftdeconvolve), (convolution.fftcorrelate, convolution.fftdecorrelate)):
    # a correlation's inverse begins with the last tap
    _k = _wide if "convolve" in _f.__name__ and "correlate" not in _f.__name__ else lambda s: creation.fromarray(s, [[-0.5, 0.5], [1.0, 4.0]])
    add(_back.__name__, lambda s, d, f=_f, back=_back, k=_k: shown(back(f(views.embeddings(s, d), k(s)), k(s))), _whole)
for _f, _back in ((convolution.fftconvolve1d, convolution.fftdeconvolve1d), (convolution.fftcorrelate1d, convolution.fftdecorrelate1d)):
    add(_back.__name__, lambda s, d, f=_f, back=_back: shown(back(f(views.embeddings(s, d), creation.fromarray(s, [1.0, 3.0, 0.5]), axis=1), creation.fromarray(s, [1.0, 3.0, 0.5]), 1)), _whole)

# interpolation through a table of breakpoints: quantities of orders by their keys


def _through_orders(s: SparkSession, d: str, mode: str) -> DataFrame:
    sums = views.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    points = creation.ordered(sums, F.struct(F.col("l_orderkey").cast("double").alias("x"), F.col("q").alias("y")), ["l_orderkey"])
    x, y = points.map(lambda v: v["x"]), points.map(lambda v: v["y"])
    return shown(convolution.interp(views.events(s, d, "value * 7 - 20"), x, y, mode))


_h = lambda a, b: f"(x{b} - x{a})"
_d = lambda a, b: f"((y{b} - y{a}) / (x{b} - x{a}))"


def _end(h0: str, h1: str, d0: str, d1: str) -> str:
    e = f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
    return f"CASE WHEN {e} * {d0} <= 0 THEN 0 WHEN {d0} * {d1} <= 0 AND abs({e}) > 3 * abs({d0}) THEN 3 * {d0} ELSE {e} END"


def _sloped(points: str) -> str:
    """SQL of pieces (x, y, s, x1, y1, s1) between the points (x, y) of a table."""
    near = ", ".join(f"{f}({c}, {k}) OVER (ORDER BY x) AS {c}{n}" for c in "xy" for f, k, n in (("lag", 2, "a"), ("lag", 1, "b"), ("lead", 1, "d"), ("lead", 2, "e")))
    wide = f"(SELECT x AS xc, y AS yc, {near} FROM {points})"
    first = f"CASE WHEN xe IS NULL THEN {_d('c', 'd')} ELSE {_end(_h('c', 'd'), _h('d', 'e'), _d('c', 'd'), _d('d', 'e'))} END"
    last = f"CASE WHEN xa IS NULL THEN {_d('b', 'c')} ELSE {_end(_h('b', 'c'), _h('a', 'b'), _d('b', 'c'), _d('a', 'b'))} END"
    a, b = f"(2 * {_h('c', 'd')} + {_h('b', 'c')})", f"({_h('c', 'd')} + 2 * {_h('b', 'c')})"
    inner = f"CASE WHEN {_d('b', 'c')} * {_d('c', 'd')} > 0 THEN ({a} + {b}) / ({a} / {_d('b', 'c')} + {b} / {_d('c', 'd')}) ELSE 0 END"
    slopes = f"(SELECT xc AS x, yc AS y, CASE WHEN xb IS NULL THEN {first} WHEN xd IS NULL THEN {last} ELSE {inner} END AS s FROM {wide})"
    return f"(SELECT *, {', '.join(f'lead({c}) OVER (ORDER BY x) AS {c}1' for c in 'xys')} FROM {slopes})"


_u, _w = "((a - x) / (x1 - x))", "(x1 - x)"
_cubic = f"y * (1 - {_u}) * (1 - {_u}) * (1 + 2 * {_u}) + y1 * {_u} * {_u} * (3 - 2 * {_u}) + {_w} * (s * {_u} * (1 - {_u}) * (1 - {_u}) - s1 * {_u} * {_u} * (1 - {_u}))"
_orders = "(SELECT CAST(l_orderkey AS DOUBLE) AS x, sum(l_quantity) AS y FROM lineitem GROUP BY l_orderkey)"
_clamped = "(SELECT event_id AS i0, greatest(least(value * 7 - 20, (SELECT max(x) FROM o)), (SELECT min(x) FROM o)) AS a FROM events)"
for _mode, _sql in {**INTERP, "cubic": _cubic}.items():
    add(
        f"interp_orders_{_mode}",
        lambda s, d, m=_mode: _through_orders(s, d, m),
        f"WITH o AS MATERIALIZED {_orders}, p AS MATERIALIZED (SELECT * FROM {_sloped('o')} WHERE x1 IS NOT NULL) SELECT i0, {r(_sql)} AS v FROM {_clamped} q ASOF JOIN p ON q.a >= p.x",
    )
_four_points = "(SELECT unnest([0.0, 50.0, 100.0, 200.0])::DOUBLE AS x, unnest([1.0, 3.0, 2.0, 5.0])::DOUBLE AS y)"
add("interp_cubic", QUERIES["interp_cubic"], f"WITH p AS MATERIALIZED (SELECT * FROM {_sloped(_four_points)} WHERE x1 IS NOT NULL) SELECT i0, {r(_cubic)} AS v FROM (SELECT event_id AS i0, least(greatest(value, 0), 200) AS a FROM events) q ASOF JOIN p ON q.a >= p.x")

# spectra of the whole matrix, whose columns zeros extend to a power of two

_rows_of = "(SELECT CAST(pow(2, ceil(log2(max(i0) + 1))) AS BIGINT) AS n FROM emb)"


def _padded(f):
    def query(s: SparkSession, d: str) -> DataFrame:
        t = views.embeddings(s, d)
        return shown_complex(f(t, fourier.padded_length(t.shape[0])), 4)

    return query


def _two_steps(bins: int) -> str:
    first = f"a AS (SELECT i0, b, sum(v * cos(2 * pi() * ((b * i1) % 64) / 64)) AS re, -sum(v * sin(2 * pi() * ((b * i1) % 64) / 64)) AS im FROM emb, range({bins}) g(b) GROUP BY i0, b)"
    turned = "cos(2 * pi() * ((k * i0) % n) / n)", "sin(2 * pi() * ((k * i0) % n) / n)"
    second = f"SELECT k AS i0, CAST(b AS BIGINT) AS i1, {r(f'sum(re * {turned[0]} + im * {turned[1]})', 4)} AS re, {r(f'sum(im * {turned[0]} - re * {turned[1]})', 4)} AS im FROM a, {_rows_of}, LATERAL (SELECT CAST(unnest(range(n)) AS BIGINT) AS k) GROUP BY ALL"
    return f"WITH {views.SQL['emb']}, {first} {second}"


add("fft2", _padded(fourier.fft2), _two_steps(64))
add("rfft2", _padded(fourier.rfft2), _two_steps(33))
_extended = with_views(f"SELECT k AS i0, CAST(j AS BIGINT) AS i1, {r('coalesce(v, 0)', 4)} AS {{}} FROM {_rows_of}, LATERAL (SELECT CAST(unnest(range(n)) AS BIGINT) AS k), range(64) g(j) LEFT JOIN emb ON emb.i0 = k AND emb.i1 = j", "emb")
add("ifft2", lambda s, d: _back2(s, d, fourier.fft2, fourier.ifft2), _extended.format("v"))
add("irfft2", lambda s, d: _back2(s, d, fourier.rfft2, fourier.irfft2), _extended.format("v"))


def _back2(s: SparkSession, d: str, there, back) -> DataFrame:
    t = views.embeddings(s, d)
    out = back(there(t, fourier.padded_length(t.shape[0])))
    return shown(out if back is fourier.irfft2 else out.map(lambda v: v["re"]), 4)


_cot = f"sum(CASE WHEN (b.i1 - a.i1) % 2 <> 0 THEN a.v / 32 / tan(pi() * (b.i1 - a.i1) / 64) ELSE 0 END)"
_pairs = "FROM emb a JOIN emb b ON a.i0 = b.i0 GROUP BY b.i0, b.i1"
add("hilbert1d", lambda s, d: shown_complex(fourier.hilbert1d(views.embeddings(s, d))), with_views(f"SELECT b.i0, b.i1, {r('any_value(b.v)')} AS re, {r(_cot)} AS im {_pairs}", "emb"))
add("hilbert1dr", lambda s, d: shown(fourier.hilbert1dr(views.embeddings(s, d))), with_views(f"SELECT b.i0, b.i1, {r(_cot)} AS v {_pairs}", "emb"))

# both axes: along the rows by the pairs above, then along the columns, whose complex cells turn by a quarter
_padded_sql = f"p AS MATERIALIZED (SELECT k AS i0, CAST(j AS BIGINT) AS i1, coalesce(v, 0) AS v FROM {_rows_of}, LATERAL (SELECT CAST(unnest(range(n)) AS BIGINT) AS k), range(64) g(j) LEFT JOIN emb ON emb.i0 = k AND emb.i1 = j)"
_first_axis = f"o AS MATERIALIZED (SELECT b.i0, b.i1, any_value(b.v) AS x, {_cot} AS y FROM p a JOIN p b ON a.i0 = b.i0 GROUP BY b.i0, b.i1)"
_turn = "CASE WHEN (b.i0 - a.i0) % 2 <> 0 THEN 2 * a.{} / n / tan(pi() * (b.i0 - a.i0) / n) ELSE 0 END"
_both_axes = f"SELECT b.i0, b.i1, any_value(b.x) - sum({_turn.format('y')}) AS re, any_value(b.y) + sum({_turn.format('x')}) AS im FROM o a JOIN o b ON a.i1 = b.i1, {_rows_of} GROUP BY b.i0, b.i1"
add("hilbert2", QUERIES["hilbert2"], f"WITH {views.SQL['emb']}, {_padded_sql}, {_first_axis} SELECT i0, i1, {r('re', 5)} AS re, {r('im', 5)} AS im FROM ({_both_axes})")

# frames, mel filters and cepstra

_w = "(0.5 - 0.5 * cos(2 * pi() * j / {}))"
_frames = lambda n, hop, count: f"fr AS (SELECT i0, f, j, v * {_w.format(n - 1)} AS v FROM emb, range({count}) g(f), range({n}) h(j) WHERE i1 = f * {hop} + j)"
_spec = lambda n: f"sp AS (SELECT i0, f, b, sum(v * cos(2 * pi() * ((b * j) % {n}) / {n})) AS re, -sum(v * sin(2 * pi() * ((b * j) % {n}) / {n})) AS im FROM fr, range({n // 2 + 1}) g2(b) GROUP BY i0, f, b)"
add("stft", lambda s, d: shown_complex(fourier.stft(views.embeddings(s, d), 16, 8)[2]), f"WITH {views.SQL['emb']}, {_frames(16, 8, 7)}, {_spec(16)} SELECT i0, CAST(f AS BIGINT) AS i1, CAST(b AS BIGINT) AS i2, {r('re')} AS re, {r('im')} AS im FROM sp")
add("istft", lambda s, d: shown(fourier.istft(fourier.stft(views.embeddings(s, d), 16, 8)[2], 16, 8)), with_views(f"SELECT i0, i1, {r('CASE WHEN i1 IN (0, 63) THEN 0 ELSE v END')} AS v FROM emb", "emb"))


def _mel(filters_: int, n: int, rate: int) -> str:
    edge = f"700 * (pow(10, (2595 * log10(1 + {rate} / 2.0 / 700)) * {{}} / {filters_ + 1} / 2595) - 1)"
    low, mid, high = edge.format("m"), edge.format("(m + 1)"), edge.format("(m + 2)")
    bins = f"(SELECT m, b, b * {rate} / {n}.0 AS f, {low} AS lo, {mid} AS mi, {high} AS hi FROM range({filters_}) g3(m), range({n // 2 + 1}) g4(b))"
    return f"me AS (SELECT m, b, greatest(0, least((f - lo) / (mi - lo), (hi - f) / (hi - mi))) * 2 / (hi - lo) AS w FROM {bins})"


_bank = f"WITH {_mel(20, 512, 16_000)} SELECT CAST(m AS BIGINT) AS i0, CAST(b AS BIGINT) AS i1, {{}} AS v FROM me"
add("mfbank", lambda s, d: shown(fourier.mfbank(s, 20, 512, 16_000)), _bank.format(r("w")))
add("mlogfbank", lambda s, d: shown(fourier.mlogfbank(s, 20, 512, 16_000)), _bank.format(r("ln(greatest(w, 1e-10))")))
_energy = "en AS (SELECT i0, f, m, ln(greatest(sum((re * re + im * im) * w), 1e-10)) AS e FROM sp JOIN me USING (b) GROUP BY i0, f, m)"
_cepstra = f"sum(e * cos(pi() * k * (2 * m + 1) / 24)) * sqrt(2 / 12.0) * CASE WHEN k = 0 THEN sqrt(0.5) ELSE 1 END"
add("mfcc", lambda s, d: shown(fourier.mfcc(views.embeddings(s, d), 8, 12, 32, 16, 8000), 4), f"WITH {views.SQL['emb']}, {_frames(32, 16, 3)}, {_spec(32)}, {_mel(12, 32, 8000)}, {_energy} SELECT i0, CAST(f AS BIGINT) AS i1, CAST(k AS BIGINT) AS i2, {r(_cepstra, 4)} AS v FROM en, range(8) g5(k) GROUP BY i0, f, k")

# products of the whole matrix

add("medfilt", lambda s, d: shown(_medfilt(s, d)), with_views(
    f"SELECT i0, i1, {r('list_sort(list_concat(list(v), list_resize([]::DOUBLE[], 9 - count(*), 0.0::DOUBLE)))[5]')} AS v FROM (SELECT i0 + p - 1 AS i0, i1 + q - 1 AS i1, v FROM emb, range(3) g(p), range(3) h(q)) WHERE i0 BETWEEN 0 AND (SELECT max(i0) FROM emb) AND i1 BETWEEN 0 AND 63 GROUP BY i0, i1",
    "emb",
))

add("medfilt_15", lambda s, d: shown(_medfilt(s, d, 15)), with_views(
    f"SELECT i0, i1, {r('list_sort(list_concat(list(v), list_resize([]::DOUBLE[], 225 - count(*), 0.0::DOUBLE)))[113]')} AS v FROM (SELECT i0 + p - 7 AS i0, i1 + q - 7 AS i1, v FROM emb, range(15) g(p), range(15) h(q)) WHERE i0 BETWEEN 0 AND (SELECT max(i0) FROM emb) AND i1 BETWEEN 0 AND 63 GROUP BY i0, i1",
    "emb",
))
add("movmedian_1001", lambda s, d: shown(_wide_median(s, d)), f"SELECT event_id AS i0, {r('median(value) OVER (ORDER BY event_id ROWS BETWEEN 500 PRECEDING AND 500 FOLLOWING)')} AS v FROM events")


def _wide_median(s: SparkSession, d: str) -> Tensor:
    from ..operators import lanes

    return lanes.movmedian(views.events(s, d), 1001)


def _medfilt(s: SparkSession, d: str, width: int = 3) -> Tensor:
    from ..operators import lanes

    return lanes.medfilt(views.embeddings(s, d), width, width)


_gram = f"SELECT a.i1 AS i0, b.i1 AS i1, {r('sum(a.v * b.v)')} AS v FROM emb a JOIN emb b ON a.i0 = b.i0 GROUP BY a.i1, b.i1"
_own_gram = lambda s, d: linalg.matmul(shape.transpose(views.embeddings(s, d)), views.embeddings(s, d))
add("matmul", lambda s, d: shown(_own_gram(s, d)), with_views(_gram, "emb"))
add("inner", lambda s, d: shown(linalg.inner(shape.transpose(views.embeddings(s, d)), shape.transpose(views.embeddings(s, d)))), with_views(_gram, "emb"))
add("trace", lambda s, d: shown(linalg.trace(_own_gram(s, d))), with_views(f"SELECT {r('sum(v * v)')} AS v FROM emb", "emb"))
add("diag", lambda s, d: shown(linalg.diag(_own_gram(s, d))), with_views(f"SELECT i1 AS i0, {r('sum(v * v)')} AS v FROM emb GROUP BY i1", "emb"))
_cross = lambda s, d: shape.transpose(views.embeddings(s, d))


def _normal(s: SparkSession, d: str) -> tuple[Tensor, Tensor]:
    """Normal equations of labels by embeddings, with 1 added to the diagonal: a matrix of 64 x 64, and the right side."""
    a = linalg.matmul(_cross(s, d), views.embeddings(s, d))
    a = a.cells(a.df.withColumn("v", F.col("v") + F.when(F.col("i0") == F.col("i1"), 1.0).otherwise(0.0)), extents=a.shape)
    label = Tensor(views.table(s, d, "embeddings").select(F.col("vec_id").alias("i0"), F.lit(0).cast("long").alias("i1"), F.col("label").cast("double").alias("v")), 2)
    return a, linalg.matmul(_cross(s, d), label)


def _fitted(s: SparkSession, d: str, side: int, invert: bool) -> Tensor:
    """The matrix times the solution, which is the right side again."""
    a, b = _normal(s, d)
    with tiles.of_side(side):
        x = linalg.matmul(linalg.inv(a), b) if invert else linalg.solve(a, b)
    return linalg.matmul(a, x)


_again = with_views(f"SELECT i1 AS i0, CAST(0 AS BIGINT) AS i1, {r('sum(v * label)', 4)} AS v FROM emb JOIN embeddings ON vec_id = i0 GROUP BY emb.i1", "emb")
add("solve_normal", lambda s, d: shown(_fitted(s, d, 16, False), 4), _again)
add("inv_normal", lambda s, d: shown(_fitted(s, d, 16, True), 4), _again)


def _triangular(s: SparkSession, d: str) -> Tensor:
    """The part of the first 64 rows below the diagonal, with 1 + v * v on it, times its transpose, rows in reverse order."""
    t = views.embeddings(s, d)
    cells = t.df.filter("i0 < 64 AND i1 <= i0").withColumn("v", F.when(F.col("i0") == F.col("i1"), 1 + F.col("v") * F.col("v")).otherwise(F.col("v")))
    low = Tensor(cells, 2, (), (64, 64))
    return shape.flip(linalg.matmul(low, shape.transpose(low)), 0)


def _determinant(s: SparkSession, d: str) -> Tensor:
    with tiles.of_side(16):
        return linalg.det(_triangular(s, d))


# of 64 rows in reverse order, an even permutation
add("det_product", lambda s, d: shown(_determinant(s, d), 4), with_views(f"SELECT {r('exp(2 * sum(ln(1 + v * v)))', 4)} AS v FROM emb WHERE i0 < 64 AND i1 = i0", "emb"))
_bessel = "(SELECT sum(pow(pow({} / 2, k) / gamma(k + 1), 2)) FROM range(40) g6(k))"
_side = "(5.0 * sqrt(1 - pow(2 * i / 32.0 - 1, 2)))"
add("kaiser", lambda s, d: shown(_kaiser(s)), f"SELECT CAST(i AS BIGINT) AS i0, {r('sum(pow(pow(x / 2, k) / gamma(k + 1), 2)) / max(one)')} AS v FROM (SELECT i, {_side} AS x, {_bessel.format('5.0')} AS one FROM range(33) g(i)), range(40) h(k) GROUP BY i")


def _kaiser(s: SparkSession) -> Tensor:
    from ..operators import windows

    return windows.kaiser(s, 33, 5.0)




# other names of the same, from when some of these read a part of the matrix only
for _alias, _name in {"fft2_spectrum": "fft2", "rfft2_spectrum": "rfft2", "hilbert1d_signal": "hilbert1d", "medfilt_whole": "medfilt", "matmul_whole": "matmul", "inner_whole": "inner"}.items():
    add(_alias, QUERIES[_name], ORACLES[_name])
