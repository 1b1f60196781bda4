"""Operators on arrays of strings. Lengths and places are in bytes, letters are ASCII.

What Spark's functions can say is said in them: texts are handled as binaries, or as Latin-1
strings with one character for each byte. Rare forms are small vectorised functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import reals
from ..tensor import REAL, STRING, Tensor
from .elementwise import literal, zipped

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space.
BLANKS = " \t\n\x0b\f\r"


def bytewise(s: Column) -> Column:
    """One character for each byte."""
    return F.decode(s.cast("binary"), "ISO-8859-1")


def textwise(b: Column) -> Column:
    """Back from one character for each byte."""
    return F.encode(b, "ISO-8859-1").cast("string")


def _quoted(s: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in s)


def upper(s: Column) -> Column:
    return F.translate(s, LOWER, UPPER)


def lower(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def capitalize(s: Column) -> Column:
    return F.concat(upper(F.substring(s, 1, 1)), lower(F.substring(s, F.lit(2), F.length(s))))


def swapcase(s: Column) -> Column:
    return F.translate(s, LOWER + UPPER, UPPER + LOWER)


def title(s: Column) -> Column:
    """A letter is raised after what isn't a letter, else lowered: runs of letters are capitalised one by one."""
    runs = F.regexp_extract_all(s, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(runs, capitalize), "")


def strip(s: Column, chars: str = BLANKS, left: bool = True, right: bool = True) -> Column:
    found = f"[{_quoted(bytes(chars, 'utf-8').decode('latin-1'))}]+"
    b = bytewise(s)
    if left:
        b = F.regexp_replace(b, f"\\A{found}", "")
    if right:
        b = F.regexp_replace(b, f"{found}\\z", "")
    return textwise(b)


def lstrip(s: Column, chars: str = BLANKS) -> Column:
    return strip(s, chars, right=False)


def rstrip(s: Column, chars: str = BLANKS) -> Column:
    return strip(s, chars, left=False)


def _missing(s: Column, width: int) -> Column:
    return F.greatest(F.lit(0), F.lit(width) - F.octet_length(s))


def ljust(s: Column, width: int, fill: str = " ") -> Column:
    return F.concat(s, F.repeat(F.lit(fill), _missing(s, width)))


def rjust(s: Column, width: int, fill: str = " ") -> Column:
    return F.concat(F.repeat(F.lit(fill), _missing(s, width)), s)


def center(s: Column, width: int, fill: str = " ") -> Column:
    """Of an odd margin the extra place is left if the width is odd too."""
    m = _missing(s, width)
    left = F.floor(m / 2).cast("int") + F.when((m % 2 == 1) & F.lit(width % 2 == 1), 1).otherwise(0)
    return F.concat(F.repeat(F.lit(fill), left), s, F.repeat(F.lit(fill), m - left))


def replace(s: Column, old: str, new: str, count: int = -1) -> Column:
    """All occurrences or the first ``count``; an empty ``old`` stands before each character and at the end."""
    if old and count < 0:
        return F.replace(s, F.lit(old), F.lit(new))
    if old:  # cut at the first occurrences, which a split with a limit does
        return F.array_join(F.split(s, _quoted(old), count + 1), new) if count else s

    @F.pandas_udf("string")
    def bounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v if v is None else v.replace(old, new, count))

    return bounded(s)


def substr(s: Column, start: int, stop: int, step: int = 1) -> Column:
    """Bytes from ``start`` up to ``stop``."""
    if not 0 <= start <= stop or step < 1:
        raise ValueError(f"{start}:{stop}:{step}")
    part = F.substring(bytewise(s), start + 1, stop - start)
    if step > 1:
        part = F.regexp_replace(part, f"(?s)(.).{{0,{step - 1}}}", "$1")
    return textwise(part)


def length(s: Column) -> Column:
    return F.octet_length(s).cast("double")


def find(s: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    """The lowest place of a part, -1 where it is missing."""
    b, x = bytewise(s), sub.encode().decode("latin-1")
    whole = b if end is None else F.substring(b, 1, end)
    place = F.locate(x, whole, start + 1) if x else F.when(F.length(whole) >= start, start + 1).otherwise(0)
    return (place - 1).cast("double")


def rfind(s: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    b, x = bytewise(s), sub.encode().decode("latin-1")
    whole = b if end is None else F.substring(b, 1, end)
    if not x:
        return F.when(F.length(whole) >= start, F.length(whole)).otherwise(-1).cast("double")
    at = F.locate(x[::-1], F.reverse(whole))
    place = F.when(at > 0, F.length(whole) - at - len(x) + 1).otherwise(-1)
    return F.when(place >= start, place).otherwise(-1).cast("double")


def startswith(s: Column, prefix: str) -> Column:
    return reals.truth(F.startswith(s, F.lit(prefix)))


def endswith(s: Column, suffix: str) -> Column:
    return reals.truth(F.endswith(s, F.lit(suffix)))


def _only(letters: str):
    return lambda s: reals.truth(s.rlike(f"\\A[{letters}]+\\z"))


isalpha, isdigit, isalnum, isspace = _only("A-Za-z"), _only("0-9"), _only("A-Za-z0-9"), _only(" \\t\\n\\x0B\\f\\r")
#: What counts as a number: Python's float() on ASCII, without digit separators.
NUMBER = r"(?i)\A\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?|nan)\s*\z"


def tonum(s: Column) -> Column:
    """The number that a string spells, else NaN."""
    plain = F.regexp_replace(lower(F.regexp_replace(s, r"\s", "")), "inf(inity)?", "Infinity")
    return F.coalesce(F.when(s.rlike(NUMBER), F.when(plain.contains("nan"), reals.NAN).otherwise(plain.try_cast("double"))), F.lit(reals.NAN))


def numtostr(x: Column) -> Column:
    """A number's shortest text, as Python writes it."""
    @F.pandas_udf("string")
    def text(v: pd.Series) -> pd.Series:
        return v.map(repr)

    return text(x)


def isbinary_digits(s: Column, prefix: str, digits: str) -> Column:
    return s.rlike(f"\\A({prefix})?[{digits}]+\\z")


def _digits(x: Column, f, half: int, width: int) -> Column:
    """Digits of a whole number up to 2**64, by its upper and lower 32 bits, as doubles of that size don't fit a long."""
    high = F.floor(x / 2.0**32)
    low = (x - high * F.lit(2.0**32)).cast("long")
    digits = F.when(high > 0, F.concat(f(high.cast("long")), F.lpad(f(low), half, "0"))).otherwise(f(low))
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(width) - F.length(digits))), digits)


def tobinary(x: Column, width: int = 0) -> Column:
    return _digits(x, F.bin, 32, width)


def tohex(x: Column, width: int = 0) -> Column:
    return _digits(x, F.hex, 8, width)


def _parsed(s: Column, prefix: str, digits: str, base: int) -> Column:
    value = F.conv(F.regexp_replace(s, f"\\A{prefix}", ""), base, 10).cast("double")
    return F.when(isbinary_digits(s, prefix, digits), value).otherwise(F.raise_error(F.lit("not a number in this base")).cast("double"))


def frombinary(s: Column) -> Column:
    return _parsed(s, "0[bB]", "01", 2)


def fromhex(s: Column) -> Column:
    return _parsed(s, "0[xX]", "0-9A-Fa-f", 16)


# one string to an array of values, and back


def codes(s: Column) -> Column:
    """Bytes as an array of doubles."""
    return F.transform(F.filter(F.split(bytewise(s), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("double"))


def codepoints(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("double"))


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def chr_(x: Column) -> Column:
    return F.when((x >= 1) & (x <= 127), F.chr(x.cast("long"))).otherwise(F.raise_error(F.lit("a code from 1 to 127")).cast("string"))


def ord_(s: Column) -> Column:
    return F.when(F.octet_length(s) == 1, F.ascii(bytewise(s)).cast("double")).otherwise(F.raise_error(F.lit("a string of one byte")).cast("double"))


def fromcodes(data: Column) -> Column:
    """One string of ASCII codes."""
    return F.array_join(F.transform(data, chr_), "")


def _bytes(data: Column) -> Column:
    digits = F.transform(data, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0"))
    return F.unhex(F.array_join(digits, ""))


def decode(data: Column) -> Column:
    """One string of UTF-8 bytes, checked."""
    return F.validate_utf8(_bytes(data).cast("string"))


def fromcodepoints(data: Column) -> Column:
    """One string of code points."""
    units = F.transform(data, lambda p: F.lpad(F.hex(p.cast("long")), 8, "0"))
    return F.decode(F.unhex(F.array_join(units, "")), "UTF-32")


def listasstr(data: Column, separator: str = ",") -> Column:
    """Numbers as one string, each as Python writes it."""

    @F.pandas_udf("array<string>")
    def texts(lists: pd.Series) -> pd.Series:
        return lists.map(lambda p: [repr(float(x)) for x in p])

    return F.array_join(texts(data), separator)


def split(s: Column, separator: str, limit: int = -1) -> Column:
    """Parts between separators, cut from the left at most ``limit`` times."""
    return F.split(s, _quoted(separator), limit + 1 if limit >= 0 else -1)


def rsplit(s: Column, separator: str, limit: int = -1) -> Column:
    back = F.split(F.reverse(s), _quoted(separator[::-1]), limit + 1 if limit >= 0 else -1)
    return F.reverse(F.transform(back, F.reverse))


def partition(s: Column, separator: str) -> Column:
    parts = split(s, separator, 1)
    return F.when(F.size(parts) == 2, F.array(F.get(parts, F.lit(0)), F.lit(separator), F.get(parts, F.lit(1)))).otherwise(F.array(s, F.lit(""), F.lit("")))


def rpartition(s: Column, separator: str) -> Column:
    parts = rsplit(s, separator, 1)
    return F.when(F.size(parts) == 2, F.array(F.get(parts, F.lit(0)), F.lit(separator), F.get(parts, F.lit(1)))).otherwise(F.array(F.lit(""), F.lit(""), s))


def binstrtoarr(s: Column) -> Column:
    return F.transform(characters(F.regexp_replace(s, "\\A0[bB]", "")), lambda c: c.cast("double"))


def hexstrtoarr(s: Column) -> Column:
    return characters(F.regexp_replace(s, "\\A0[xX]", ""))


def tobase64(s: Column) -> Column:
    return F.regexp_replace(F.base64(s.cast("binary")), "\\s", "")


def bytestobase64(data: Column) -> Column:
    return F.regexp_replace(F.base64(_bytes(data)), "\\s", "")


def frombase64(s: Column) -> Column:
    """The text of canonical base64."""
    raw = F.unbase64(s)
    same = F.regexp_replace(F.base64(raw), "\\s", "") == s
    return F.when(same, raw.cast("string")).otherwise(F.raise_error(F.lit("not canonical base64")).cast("string"))


#: NumPy types that arrays are stored as.
STORED = ("|u1", "|i1", "<u2", ">u2", "<i2", ">i2", "<u4", ">u4", "<i4", ">i4", "<u8", ">u8", "<i8", ">i8", "<f4", ">f4", "<f8", ">f8")


def tobuffer(data: Column, dtype: str) -> Column:
    """The bytes of an array in a NumPy type with its byte order; values out of range are refused."""
    import numpy as np

    if dtype not in STORED:
        raise ValueError(f"type {dtype}")

    @F.pandas_udf("binary")
    def stored(x: pd.Series) -> pd.Series:
        def one(values) -> bytes:
            a = np.asarray(values, float)
            kind = np.dtype(dtype)
            if kind.kind in "iu" and (a != np.floor(a)).any() or kind.kind in "iu" and ((a < np.iinfo(kind).min) | (a > np.iinfo(kind).max)).any():
                raise ValueError(f"a value doesn't fit {dtype}")
            return a.astype(kind).tobytes()

        return x.map(one)

    return stored(data)


def frombuffer(data: Column, dtype: str) -> Column:
    """The values that bytes hold in a NumPy type."""
    import numpy as np

    if dtype not in STORED:
        raise ValueError(f"type {dtype}")

    @F.pandas_udf("array<double>")
    def read(x: pd.Series) -> pd.Series:
        return x.map(lambda b: np.frombuffer(b, dtype).astype(float))

    return read(data)


#: Functions of each string that give a string, or a number.
MAPS = {"strupper": upper, "strlower": lower, "strcapitalize": capitalize, "strswapcase": swapcase, "strtitle": title}
MAPS |= {"strstrip": strip, "strlstrip": lstrip, "strrstrip": rstrip, "strcenter": center, "strljust": ljust, "strrjust": rjust}
MAPS |= {"strreplace": replace, "strsubstr": substr, "strlen": length, "strfind": find, "strrfind": rfind, "strstartswith": startswith}
MAPS |= {"strendswith": endswith, "strisalpha": isalpha, "strisdigit": isdigit, "strisalnum": isalnum, "strisspace": isspace}
MAPS |= {"strtonum": tonum, "frombinary": frombinary, "fromhex": fromhex, "tobase64": tobase64, "frombase64": frombase64, "strord": ord_}
NUMBER_MAPS = {"numtostr": numtostr, "tobinary": tobinary, "tohex": tohex, "strchr": chr_}
#: Functions of one string that give an array.
SPREADS = {"strtoascii": codes, "strencode": codes, "strtocodepoints": codepoints, "straslist": characters, "strsplit": split}
SPREADS |= {"strrsplit": rsplit, "strpartition": partition, "strrpartition": rpartition, "binstrtoarr": binstrtoarr, "hexstrtoarr": hexstrtoarr}


def apply(name: str, t: Tensor, *args, **kwargs) -> Tensor:
    """A named function of each cell."""
    t.need(REAL if name in NUMBER_MAPS else STRING)
    return t.map(lambda v: (MAPS | NUMBER_MAPS)[name](v, *args, **kwargs))


def spread(name: str, t: Tensor, *args) -> Tensor:
    """A named function of each string as a further axis."""
    t.need(STRING)
    cells = t.df.select(*t.places, F.posexplode(SPREADS[name](F.col("v"), *args)).alias(f"i{t.ndim}", "v"))
    return t.cells(cells, t.ndim + 1)


def concat(a: Tensor | str, b: Tensor | str) -> Tensor:
    """Strings joined cell by cell, arrays broadcast."""
    if isinstance(a, Tensor) and isinstance(b, Tensor):
        return zipped(a, b, F.concat)
    if isinstance(a, Tensor):
        return a.map(lambda v: F.concat(v, literal(b)))
    return b.map(lambda v: F.concat(literal(a), v))


def repeat(t: Tensor, n: int | Tensor) -> Tensor:
    times = lambda v, k: F.repeat(v, F.greatest(F.lit(0), k.cast("int")))
    return zipped(t, n, times) if isinstance(n, Tensor) else t.map(lambda v: times(v, F.lit(n)))
