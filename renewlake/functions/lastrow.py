"""The last transaction of a group as one number of fixed width.

The maximum of a struct makes Spark sort the raw rows by group first: its buffer has no
fixed width. Packed into one decimal of 38 digits the same order is a hash aggregate. From
high to low digits: payment day and expiry (days, 23 bits each, together 14 digits), row id
(20 digits), two flags (two digits each). 0 stands for NULL, so NULLs come first as in a
struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DAY_BITS, FLAG_BASE, MAX_FLAGS = 23, 100, 2
LOW_DIGITS = 24


def _number(value: int) -> Column:
    return F.lit(str(value)).cast(f"decimal({len(str(value))},0)")


def _day_code(day) -> Column:
    return F.coalesce(F.unix_date(day).cast("long") + (1 << (DAY_BITS - 1)), F.lit(0).cast("long"))


def last_row(df: DataFrame, *flags: str) -> Column:
    """Aggregate: the last transaction by payment date, expiry, row id (if there is one) and flags.

    Flags are whole numbers of 0 to 98 or NULL, two at most; read the result with `last_expiry`
    and `last_flag`.
    """
    if len(flags) > MAX_FLAGS:
        raise ValueError(f"at most {MAX_FLAGS} flags")
    days = _day_code("transaction_date") * (1 << DAY_BITS) + _day_code("membership_expire_date")
    code = F.lit(0)
    for name in flags:
        code = code * FLAG_BASE + F.coalesce(F.col(name).cast("int") + 1, F.lit(0))
    low = code.cast("decimal(4,0)")
    if "rid" in df.columns:
        rid = F.coalesce(F.col("rid").cast("decimal(20,0)") + _number((1 << 63) + 1), _number(0))
        low = rid.cast("decimal(20,0)") * _number(FLAG_BASE ** MAX_FLAGS) + low
    high = days.cast("decimal(14,0)") * _number(10 ** LOW_DIGITS)
    return F.max((high + low).cast("decimal(38,0)"))


def last_expiry(packed: str) -> Column:
    days = F.call_function("div", F.col(packed), _number(10 ** LOW_DIGITS)) % (1 << DAY_BITS)
    return F.when(days > 0, F.date_from_unix_date((days - (1 << (DAY_BITS - 1))).cast("int")))


def last_flag(packed: str, place: int, flags: int) -> Column:
    """Flag number `place` (from 0) of the `flags` that were packed."""
    codes = (F.col(packed) % _number(FLAG_BASE ** MAX_FLAGS)).cast("int")
    code = F.floor(codes / FLAG_BASE ** (flags - 1 - place)).cast("int") % FLAG_BASE
    return F.when(code > 0, code - 1)
