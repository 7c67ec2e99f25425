"""Path functions on single values: strings, numbers, conversions, dates. Null stands for 'nothing'."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- strings ------------------------------------------------------------------------------------


def index_of(x: Column, s: str) -> Column:
    """Byte offset of the first occurrence, -1 if there is none."""
    at = F.locate(s, x)
    return F.when(at == 0, F.lit(-1)).otherwise(F.octet_length(F.left(x, at - 1)))


def last_index_of(x: Column, s: str) -> Column:
    """Byte offset of the last occurrence, -1 if there is none."""
    back = F.locate(s[::-1], F.reverse(x))
    return F.when(back == 0, F.lit(-1)).otherwise(F.octet_length(F.left(x, F.length(x) - (back - 1) - len(s))))


def substring(x: Column, start: int, length: int | None = None) -> Column:
    """Bytes from a 0-based start, like the offsets above; nothing if it lies outside, or where bytes are no whole characters."""
    if length is not None and length < 0:
        raise ValueError("substring() of a negative length")
    raw = x.cast("binary")
    part = F.try_validate_utf8(F.substring(raw, start + 1, length if length is not None else 2**31 - 1).cast("string"))
    return F.when((F.lit(start) >= 0) & (F.lit(start) < F.octet_length(x)), part)


def length(x: Column) -> Column:
    """Bytes."""
    return F.octet_length(x)


def to_chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def trim(x: Column) -> Column:
    """White space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(x, r"^(?U)\s+", ""), r"(?U)\s+$", "")


def matches(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit("(?s)" + pattern))


def matches_full(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(f"(?s)^(?:{pattern})$"))


def encode(x: Column, kind: str) -> Column:
    raw = x.cast("binary")
    return {"hex": F.lower(F.hex(raw)), "base64": F.base64(raw), "urlbase64": F.translate(F.base64(raw), "+/", "-_")}[kind]


def decode(x: Column, kind: str) -> Column:
    return {"hex": F.unhex(x), "base64": F.unbase64(x), "urlbase64": F.unbase64(F.translate(x, "-_", "+/"))}[kind].cast("string")


# Characters that need escaping, the ampersand first.
ESCAPES = {"html": [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")], "json": [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]}


def escape(x: Column, kind: str) -> Column:
    for plain, coded in ESCAPES[kind]:
        x = F.replace(x, F.lit(plain), F.lit(coded))
    return x


def unescape(x: Column, kind: str) -> Column:
    """One scan from the left, so what an escape gives is not read again: the text is cut at escapes, and each is replaced by itself."""
    table = F.create_map(*[F.lit(v) for plain, coded in ESCAPES[kind] for v in (coded, plain)])
    codes = "|".join("\\Q" + coded + "\\E" for _, coded in ESCAPES[kind])
    pieces = F.regexp_extract_all(x, F.lit(f"(?s){codes}|."), F.lit(0))
    return F.array_join(F.transform(pieces, lambda t: F.coalesce(F.try_element_at(table, t), t)), "")


def replace_matches(x: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(x, "(?s)" + pattern, by)


def to_string(x: Column, kind: str = "") -> Column:
    """Canonical text; instants (``kind`` datetime) with a zone suffix."""
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if kind == "datetime" else x.cast("string")


def split(x: Column, by: str) -> Column:
    return F.split(x, r"\Q" + by + r"\E")


def _fold(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t).lower() if c.isalnum()))


def folded(x: Column) -> Column:
    """Lower case without accents, letters and digits only, for text beyond ASCII."""
    return F.pandas_udf(_fold, StringType())(x)


# ---- numbers ------------------------------------------------------------------------------------


def concatenate(a: Column, b: Column) -> Column:
    """``a & b``: nothing counts as an empty string."""
    return F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def negate(x: Column) -> Column:
    return F.try_subtract(F.lit(0), x)


def exp(x: Column) -> Column:
    return F.exp(x)


def add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("decimal(28,9)"), b.cast("decimal(28,9)"))


def div(a: Column, b: Column) -> Column:
    """Whole quotient, cut towards zero; nothing for a zero divisor."""
    q = a / F.nullif(b, F.lit(0))
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q)).cast("long")


def mod(a: Column, b: Column) -> Column:
    return a % F.nullif(b, F.lit(0))


def truncate(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


def round_even(x: Column, digits: int = 0) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(x, digits)


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log(x: Column, base: float) -> Column:
    return F.when(x > 0, F.log(base, x))


def power(x: Column, e: float) -> Column:
    """Nothing for a negative base with a fractional exponent."""
    return F.when((x >= 0) | F.lit(float(e).is_integer()), F.pow(x, F.lit(float(e))))


def low_boundary(x: Column, digits: int) -> Column:
    """The least value that rounds to ``x`` at its precision."""
    return x - F.lit(0.5 * 10.0 ** -digits)


def high_boundary(x: Column, digits: int) -> Column:
    return x + F.lit(0.5 * 10.0 ** -digits)


# ---- conversions --------------------------------------------------------------------------------


def to_boolean(x: Column) -> Column:
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("true", "yes", "1", "1.0"), True).when(t.isin("false", "no", "0", "0.0"), False)


def converts_to_boolean(x: Column) -> Column:
    """Unlike ``to_boolean`` without yes and no."""
    return F.lower(F.trim(x.cast("string"))).isin("true", "false", "0", "1", "0.0", "1.0")


def to_integer(x: Column) -> Column:
    t = x.cast("string")
    return F.when(t.rlike(r"^-?\d+$"), t.try_cast("bigint"))


def to_decimal(x: Column) -> Column:
    t = x.cast("string")
    return F.when(t.rlike(r"^[+-]?\d+(\.\d+)?$"), t.try_cast("decimal(38,12)"))


def to_date(x: Column) -> Column:
    """First day of a date that may lack month or day."""
    t = x.cast("string")
    return F.when(t.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), F.try_to_date(F.concat(t, F.when(F.length(t) == 4, "-01-01").when(F.length(t) == 7, "-01").otherwise("")), "yyyy-MM-dd"))


_DATETIME = r"^\d{4}(-\d{2}(-\d{2}(T\d{2}(:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}:\d{2})?)?)?)?$"
_TIME = r"^T?(([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d(\.\d{1,9})?)?)?)$"


def to_datetime(x: Column) -> Column:
    """The first instant (UTC, timestamp_ntz) of text with a date and perhaps a time; without a zone it is UTC."""
    t = x.cast("string")
    zone = F.coalesce(F.nullif(F.regexp_extract(t, r"T.*?(Z|[+-]\d{2}:\d{2})$", 1), F.lit("")), F.lit("Z"))
    bare = F.regexp_replace(t, r"(T.*?)(Z|[+-]\d{2}:\d{2})$", "$1")
    padded = F.concat(bare, F.substring(F.lit("0001-01-01T00:00:00"), F.length(bare) + 1, F.lit(19)), zone)
    seconds = (F.unix_micros(padded.try_cast("timestamp")) / F.lit(1_000_000)).cast("decimal(18,6)")
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.when(t.rlike(_DATETIME), epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds))


def to_time(x: Column) -> Column:
    """Text of a time of day as far as stated, without a leading T."""
    t = x.cast("string")
    return F.when(t.rlike(_TIME), F.regexp_extract(t, _TIME, 1))


def _converts(to):
    def test(x: Column) -> Column:
        return F.when(x.isNotNull(), to(x).isNotNull())

    test.__doc__ = f"Does ``{to.__name__}`` give a value?"
    return test


converts_to_integer, converts_to_decimal = _converts(to_integer), _converts(to_decimal)
converts_to_date, converts_to_datetime, converts_to_time = _converts(to_date), _converts(to_datetime), _converts(to_time)


def converts_to_string(x: Column) -> Column:
    """Any single value does; an object does not, and it is no Column of a plain type."""
    return F.when(x.isNotNull(), F.lit(True))


def decimal_precision(x: Column) -> Column:
    """Digits after the point of a number as text."""
    return F.length(F.regexp_extract(x.cast("string"), r"\.(\d+)$", 1))


def time_precision(x: Column) -> Column:
    """Digits that a time states: 2, 4, 6 or 9."""
    digits = F.length(F.regexp_replace(to_time(x), r"\D", ""))
    return F.when(digits > 6, 9).otherwise(digits)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; texts that are both dates compare as dates, and only at equal precision."""
    both = a.cast("string").rlike(_DATETIME) & b.cast("string").rlike(_DATETIME)
    plain = F.when(a < b, -1).when(a > b, 1).when(a == b, 0)
    return F.when(both, compare_dates(a.cast("string"), b.cast("string"))).otherwise(plain)


def date_precision(x: Column) -> Column:
    """Digits that a date states: 4, 6 or 8."""
    n = F.length(x.cast("string"))
    return F.when(n == 4, 4).when(n == 7, 6).when(n == 10, 8)


def compare_dates(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for dates of equal precision, else null."""
    return F.when(F.length(a) == F.length(b), F.when(a < b, -1).when(a > b, 1).otherwise(0))


def to_quantity(x: Column) -> Column:
    """struct(value, unit) of ``12 mg`` or ``12 'mg'``."""
    p = r"^([+-]?\d+(?:\.\d+)?)(?:\s+'?([^']+?)'?)?$"
    return F.when(x.rlike(p), F.struct(F.regexp_extract(x, p, 1).cast("decimal(28,9)").alias("value"), F.nullif(F.regexp_extract(x, p, 2), F.lit("")).alias("unit")))


converts_to_quantity = _converts(to_quantity)
