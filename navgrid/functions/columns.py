"""Column expressions: cleaning, coercion and labels. All stay in the JVM."""

import re

from pyspark.sql import Column, functions as F

from navgrid.schema import STATUS_EMPTY, STATUS_OK

# Everything a Unicode-aware strip removes; the four separators are not in White_Space.
_BLANK = r"[\s\x1c-\x1f]"
_EDGES = rf"(?U)^{_BLANK}+|{_BLANK}+$"
_NUMBER = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: Column | str) -> Column:
    """Strip every kind of white space, not only blanks."""
    return F.regexp_replace(_col(c), _EDGES, "")


def normalise_id(c: Column | str) -> Column:
    """Digits of the identifier padded to 14; null when there are none or more than 14."""
    digits = F.regexp_replace(_col(c).cast("string"), r"(?U)\D", "")
    return F.when(F.length(digits).between(1, 14), F.lpad(digits, 14, "0"))


def to_double(c: Column | str) -> Column:
    """Number or null. The pattern keeps out literals that only the JVM reads as numbers (1d, 0x1p3)."""
    return F.when(_col(c).rlike(_NUMBER), _col(c).try_cast("double"))


def to_day(c: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Date in exactly this format or null.

    The shape is tested first: a failing parse costs an exception per row, a failing pattern does not. With an
    ISO shape the plain cast is exact and faster than a formatter.
    """
    shape = "^(?!0000)" + re.sub("[yMd]", r"\\d", fmt) + r"\z"
    day = _col(c).try_cast("date") if fmt == "yyyy-MM-dd" else F.try_to_date(_col(c), fmt)
    return F.when(_col(c).rlike(shape), day)


def parse_day_first(c: Column | str) -> Column:
    return to_day(c, "dd/MM/yyyy")


def window_is_open(start: Column | str, end: Column | str) -> Column:
    """Whether a window may be analysed: both ends are there and the first lies before the last."""
    return F.coalesce(_col(start) < _col(end), F.lit(False))


def format_day(c: Column | str) -> Column:
    return F.date_format(_col(c), "dd/MM/yyyy")


def utc_day(c: Column | str) -> Column:
    """UTC day of a timestamp. The session time zone has to be UTC (see navgrid.session)."""
    return F.to_date(_col(c))


def positive(c: Column | str) -> Column:
    """Strictly positive and a number: Spark sorts NaN above every number, so it has to go first."""
    return ~F.isnan(_col(c)) & (_col(c) > 0)


def subclass_or_blank(c: Column | str) -> Column:
    return F.coalesce(trim_all(c), F.lit(""))


def shorten(c: Column | str, n: int = 62) -> Column:
    return F.when(F.length(_col(c)) <= n, _col(c)).otherwise(
        F.concat(F.substring(_col(c), 1, n - 1), F.lit("…")))


def label(name: Column | str, key: Column | str) -> Column:
    return F.concat_ws("  ·  ", _col(name), _col(key))


def status(count: Column | str) -> Column:
    return F.when(_col(count) == 0, STATUS_EMPTY).otherwise(STATUS_OK)


def base100_to_return(c: Column | str) -> Column:
    return _col(c) / 100.0 - 1.0


def rate_factor(c: Column | str) -> Column:
    """Percent rate to growth factor; a loss of everything or more is an error."""
    factor = 1.0 + _col(c) / 100.0
    return F.when(factor <= 0, F.raise_error(F.lit("A daily rate is -100% or less."))).otherwise(factor)


def overlaps(first: Column | str, last: Column | str, start: str | None, end: str | None) -> Column:
    """Period [first, last] (YYYY-MM text) touches [start, end]; a missing bound is open."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (_col(last) >= start)
    if end is not None:
        keep = keep & (_col(first) <= end)
    return keep


def valid_period(c: Column | str) -> Column:
    """YYYY-MM text from 2000 on, months 01 to 12."""
    return F.coalesce(
        _col(c).rlike(r"^\d{4}-(0[1-9]|1[0-2])\z") & (F.substring(_col(c), 1, 4) >= "2000"), F.lit(False))
