"""Complex arithmetic on structs of re and im."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import reals

TYPE = "struct<re:double,im:double>"


def make(re: Column | float, im: Column | float = 0.0) -> Column:
    return F.struct(reals.col(re).alias("re"), reals.col(im).alias("im"))


def add(a: Column, b: Column) -> Column:
    return make(a["re"] + b["re"], a["im"] + b["im"])


def subtract(a: Column, b: Column) -> Column:
    return make(a["re"] - b["re"], a["im"] - b["im"])


def mul(a: Column, b: Column) -> Column:
    return make(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def div(a: Column, b: Column) -> Column:
    """Refuses a zero divisor."""
    d = b["re"] * b["re"] + b["im"] * b["im"]
    d = F.when(d == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(d)
    return make((a["re"] * b["re"] + a["im"] * b["im"]) / d, (a["im"] * b["re"] - a["re"] * b["im"]) / d)


def scale(a: Column, k: Column | float) -> Column:
    return make(a["re"] * k, a["im"] * k)


def conj(z: Column) -> Column:
    return make(z["re"], -z["im"])


def magnitude(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def angle(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def exp(z: Column) -> Column:
    return make(F.exp(z["re"]) * F.cos(z["im"]), F.exp(z["re"]) * F.sin(z["im"]))


def ln(z: Column) -> Column:
    return make(reals.ln(magnitude(z)), angle(z))


def log(z: Column, base: Column) -> Column:
    return div(ln(z), ln(base))


def pow(z: Column, w: Column) -> Column:
    """Refuses a base of zero."""
    base = F.when(magnitude(z) == 0, F.raise_error(F.lit("zero base")).cast(TYPE)).otherwise(z)
    return exp(mul(w, ln(base)))


def _root(z: Column, n: int) -> Column:
    r, t = F.pow(magnitude(z), F.lit(1.0 / n)), angle(z) / n
    return make(r * F.cos(t), r * F.sin(t))


def sqrt(z: Column) -> Column:
    return _root(z, 2)


def cbrt(z: Column) -> Column:
    return _root(z, 3)


def sin(z: Column) -> Column:
    return make(F.sin(z["re"]) * F.cosh(z["im"]), F.cos(z["re"]) * F.sinh(z["im"]))


def cos(z: Column) -> Column:
    return make(F.cos(z["re"]) * F.cosh(z["im"]), -F.sin(z["re"]) * F.sinh(z["im"]))


def tan(z: Column) -> Column:
    return div(sin(z), cos(z))


def sinh(z: Column) -> Column:
    return make(F.sinh(z["re"]) * F.cos(z["im"]), F.cosh(z["re"]) * F.sin(z["im"]))


def cosh(z: Column) -> Column:
    return make(F.cosh(z["re"]) * F.cos(z["im"]), F.sinh(z["re"]) * F.sin(z["im"]))


def tanh(z: Column) -> Column:
    return div(sinh(z), cosh(z))


def one() -> Column:
    return make(1.0)


def i() -> Column:
    return make(0.0, 1.0)


def asin(z: Column) -> Column:
    w = ln(add(mul(i(), z), sqrt(subtract(one(), mul(z, z)))))
    return make(w["im"], -w["re"])


def acos(z: Column) -> Column:
    return subtract(make(math.pi / 2), asin(z))


def atan(z: Column) -> Column:
    iz = mul(i(), z)
    return mul(make(0.0, 0.5), subtract(ln(subtract(one(), iz)), ln(add(one(), iz))))


def asinh(z: Column) -> Column:
    return ln(add(z, sqrt(add(mul(z, z), one()))))


def acosh(z: Column) -> Column:
    return ln(add(z, mul(sqrt(add(z, one())), sqrt(subtract(z, one())))))


def atanh(z: Column) -> Column:
    return scale(subtract(ln(add(one(), z)), ln(subtract(one(), z))), 0.5)


def sign(z: Column) -> Column:
    r = magnitude(z)
    return F.when(r == 0, make(0.0)).otherwise(make(z["re"] / F.when(r == 0, 1.0).otherwise(r), z["im"] / F.when(r == 0, 1.0).otherwise(r)))


def wrap(z: Column, period: Column) -> Column:
    return make(reals.wrap(z["re"], period), reals.wrap(z["im"], period))


UNARY = {"sign": sign, "exp": exp, "sqrt": sqrt, "cbrt": cbrt, "sin": sin, "cos": cos, "tan": tan, "asin": asin, "acos": acos, "atan": atan}
UNARY |= {"sinh": sinh, "cosh": cosh, "tanh": tanh, "asinh": asinh, "acosh": acosh, "atanh": atanh}
BINARY = {"add": add, "subtract": subtract, "mul": mul, "div": div, "pow": pow, "log": log}
