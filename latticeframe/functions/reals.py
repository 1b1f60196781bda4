"""Real functions with IEEE results where Spark's own give NULL, an error or another order of NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: From here on every double is whole.
WHOLE = float(2**52)


def col(x: Column | float | int) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def truth(x: Column) -> Column:
    """A boolean as 0 or 1."""
    return x.cast("double")


def div(a: Column, b: Column) -> Column:
    """IEEE division: x / 0 is infinite, 0 / 0 is NaN."""
    by_zero = F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def strict_div(a: Column, b: Column) -> Column:
    """Division of one array by another, which refuses zeros."""
    return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def ln(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), NAN).when(x == 0, -INF).otherwise(F.ln(F.when(x > 0, x)))


def log10(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), NAN).when(x == 0, -INF).otherwise(F.log10(F.when(x > 0, x)))


def log(x: Column, base: Column) -> Column:
    return div(ln(x), ln(base))


def floor(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= WHOLE), x).otherwise(F.floor(x).cast("double"))


def ceil(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= WHOLE), x).otherwise(F.ceil(x).cast("double"))


def divide_floor(a: Column, b: Column) -> Column:
    return floor(div(a, b))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign."""
    return a - b * divide_floor(a, b)


def minimum(a: Column, b: Column) -> Column:
    return F.least(a, b)  # NaN is Spark's largest, so it is passed over


def maximum(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, low), high))


def wrap(x: Column, period: Column) -> Column:
    """``x`` moved by whole periods into [-period / 2, period / 2)."""
    half = period / 2
    rest = (x + half) % period
    return F.when(rest < 0, rest + period).otherwise(rest) - half


def _no_nan(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b)


COMPARISONS = {
    "gt": lambda a, b: truth((a > b) & _no_nan(a, b)),
    "lt": lambda a, b: truth((a < b) & _no_nan(a, b)),
    "ge": lambda a, b: truth((a >= b) & _no_nan(a, b)),
    "le": lambda a, b: truth((a <= b) & _no_nan(a, b)),
    "eq": lambda a, b: truth((a == b) & _no_nan(a, b)),
    "ne": lambda a, b: truth((a != b) | ~_no_nan(a, b)),
    "logicand": lambda a, b: truth((a != 0) & (b != 0)),
    "logicor": lambda a, b: truth((a != 0) | (b != 0)),
}
TESTS = {
    "isnan": lambda x: truth(F.isnan(x)),
    "isinf": lambda x: truth(F.abs(x) == INF),
    "isfin": lambda x: truth(~F.isnan(x) & (F.abs(x) < INF)),
    "logicnot": lambda x: truth(x == 0),
}
UNARY = {
    "abs": F.abs,
    "sign": F.signum,
    "floor": floor,
    "ceil": ceil,
    "round": F.rint,
    "exp": F.exp,
    "sqrt": F.sqrt,
    "cbrt": F.cbrt,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "asinh": F.asinh,
    "acosh": F.acosh,
    "atanh": F.atanh,
    "degtorad": F.radians,
    "radtodeg": F.degrees,
}
BINARY = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": div,
    "pow": F.pow,
    "log": log,
    "hypot": F.hypot,
    "minimum": minimum,
    "maximum": maximum,
    "atan2": F.atan2,
    "wrap": wrap,
} | COMPARISONS


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def db_sum(x: Column) -> Column:
    """Levels in dB added by power."""
    return 10 * log10(F.sum(F.pow(F.lit(10.0), x / 10)))


def samples_to_seconds(x: Column, rate: float) -> Column:
    return x / F.lit(float(rate))


def samples_to_millis(x: Column, rate: float) -> Column:
    return x * 1000 / F.lit(float(rate))


def seconds_to_samples(x: Column, rate: float) -> Column:
    return x * F.lit(float(rate))


def millis_to_samples(x: Column, rate: float) -> Column:
    return x * F.lit(float(rate)) / 1000
