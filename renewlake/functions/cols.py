"""Scalar column helpers: clipping, division, dates, lenient parsing, medians."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- numbers -----------------------------------------------------------------

def clip(c, low=None, high=None) -> Column:
    """Clamp a non-null number. least/greatest skip NULL, so fill first."""
    out = col(c)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return out


def filled(c, value=0.0) -> Column:
    """NULL and NaN -> value, as double."""
    return F.coalesce(F.nanvl(col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(value)))


def safe_divide(numerator, denominator, default: float = 0.0) -> Column:
    """numerator / denominator; zero or NULL denominator (or NULL numerator) -> default."""
    ratio = F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))
    return F.coalesce(ratio, F.lit(float(default)))


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it is false or NULL."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def count_if(condition: Column) -> Column:
    return F.sum(flag(condition)).cast("long")


def rate_to_pct(c) -> Column:
    """A rate given as 0..1 becomes a percentage; larger values are kept; NULL -> 0."""
    value = col(c).cast("double")
    return F.coalesce(F.when(value.between(0.0, 1.0), value * 100.0).otherwise(value), F.lit(0.0))


def churn_probability_from_rate(c) -> Column:
    """Negative or NULL -> 0, above 1 is read as a percentage, result within 0..1."""
    value = filled(c, 0.0)
    value = F.when(value < 0, 0.0).when(value > 1, value / 100.0).otherwise(value)
    return clip(value, 0.0, 1.0)


def upper_median(c: str) -> Column:
    """Element at index floor(n/2) of the ascending values (exact, discrete)."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")


# --- dates and months --------------------------------------------------------

def month_start(c) -> Column:
    return F.trunc(col(c), "month")


def yyyymm(c) -> Column:
    return (F.year(col(c)) * 100 + F.month(col(c))).cast("int")


def yyyymmdd(c) -> Column:
    return (F.year(col(c)) * 10000 + F.month(col(c)) * 100 + F.dayofmonth(col(c))).cast("int")


def month_to_date(c) -> Column:
    """First day of a yyyymm month number."""
    m = col(c)
    return F.make_date((m / 100).cast("int"), (m % 100).cast("int"), F.lit(1))


def shift_month(c, months: int) -> Column:
    return yyyymm(F.add_months(month_to_date(c), months))


def month_label(c) -> Column:
    """yyyymm number -> 'YYYY-MM'."""
    return F.date_format(month_to_date(c), "yyyy-MM")


def days_in_month(c) -> Column:
    return F.dayofmonth(F.last_day(month_to_date(c)))


# --- lenient parsing of text columns -----------------------------------------

def text(c) -> Column:
    return F.coalesce(F.trim(col(c).cast("string")), F.lit(""))


INFINITE = ("inf", "+inf", "-inf")


def parse_float(c) -> Column:
    """A plain decimal number or a name of a special value; anything else -> NULL.

    The cast alone would also take type suffixes ("12d", "1.5f"), hexadecimal numbers
    ("0x1p3") and white space other than blanks at the ends. Those are told by single
    characters: a pattern for each value costs more than the cast.
    """
    t = text(c)
    last = F.right(t, F.lit(1))
    suffixed = last.isin("d", "D", "f", "F") & ~F.lower(t).isin(*INFINITE)
    return F.when((t > " ") & (last > " ") & ~suffixed & ~t.contains("x") & ~t.contains("X"), t).try_cast("double")


def parse_int(c) -> Column:
    """Text -> number -> truncated toward zero; blank or bad -> NULL."""
    return parse_float(c).try_cast("int")


def _iso_text(t: Column, iso: bool, compact: bool) -> Column:
    """The text as yyyy-mm-dd when it has one of the wanted shapes. Casting ISO text to a date
    is far cheaper than a pattern formatter, and a bad value costs no exception."""
    out = None
    if iso:
        out = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
    if compact:
        spelled = F.concat_ws("-", t.substr(1, 4), t.substr(5, 2), t.substr(7, 2))
        shape = t.rlike(r"^\d{8}$")
        out = F.when(shape, spelled) if out is None else out.when(shape, spelled)
    return out


def parse_date_compact(c) -> Column:
    """Exactly eight digits, yyyymmdd."""
    return _iso_text(text(c), iso=False, compact=True).try_cast("date")


def parse_date_flexible(c) -> Column:
    """yyyy-mm-dd, else yyyymmdd, else NULL."""
    return _iso_text(text(c), iso=True, compact=True).try_cast("date")


def parse_date_iso(c) -> Column:
    """yyyy-mm-dd, else NULL."""
    return _iso_text(text(c), iso=True, compact=False).try_cast("date")
