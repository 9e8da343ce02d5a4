"""Numbers from text without a pattern per value, and the packed order of last rows."""

import datetime as dt
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from renewlake.functions.cols import parse_float
from renewlake.functions.lastrow import last_expiry, last_flag, last_row

NUMBER = re.compile(r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))|(?i:nan)")


def plain(value):
    t = (value or "").strip(" ")
    if not NUMBER.fullmatch(t):
        return None
    return float(t)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.text("0123456789.eE+-dDfFxXnaNiI \t_L", max_size=7), st.none(), st.floats().map(str)), min_size=300, max_size=400))
def test_numbers(spark, values):
    values += ["12d", "1.5f", "0x1p3", "1f", "1D", "inf", "-INF", "+Infinity", "nan", "NaN", "\t1", "1\n", " 1 ", "1e5", "1.e5", ".5",
               "5.", ".", "", "e5", "1_0", "١", "0X1", "1e400", "-0", "infd", "nanf", "1L"]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(
        parse_float("v")).collect()]
    assert [str(x) for x in got] == [str(plain(v)) for v in values]


@pytest.mark.parametrize("with_id", [True, False])
def test_last_rows(spark, with_id):
    rnd = random.Random(with_id)
    day = lambda: rnd.choice([None, dt.date(1, 1, 1), dt.date(9999, 12, 31), dt.date(1969, 12, 31), dt.date(2024, 2, rnd.randint(1, 9))])
    ids = [None, -2**63, 2**63 - 1, -1, 0, 7, 10**18]
    rows = [(rnd.randrange(40), day(), day(), rnd.choice(ids), rnd.choice([None, 0, 1, 98]), rnd.choice([None, 0, 1])) for _ in range(900)]
    names = "k int, transaction_date date, membership_expire_date date, rid long, is_cancel int, is_auto_renew int"
    df = spark.createDataFrame(rows, names)
    if not with_id:
        df = df.drop("rid")
    got = df.groupBy("k").agg(last_row(df, "is_cancel", "is_auto_renew").alias("p"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    got = {r[0]: tuple(r)[1:] for r in got.select("k", last_expiry("p"), last_flag("p", 0, 2), last_flag("p", 1, 2)).collect()}
    low = lambda v: (v is not None, v)
    order = lambda r: [low(x) for x in r[1:]] if with_id else [low(x) for x in (*r[1:3], *r[4:])]
    want = {}
    for r in rows:
        if r[0] not in want or order(r) > order(want[r[0]]):
            want[r[0]] = r
    assert got == {k: (r[2], r[4], r[5]) for k, r in want.items()}
    one = df.groupBy("k").agg(last_row(df, "is_auto_renew").alias("p")).select(last_flag("p", 0, 1))
    assert {r[0] for r in one.collect()} <= {None, 0, 1}
    with pytest.raises(ValueError):
        last_row(df, "a", "b", "c")
    assert df.groupBy().agg(last_row(df.limit(0), "is_cancel").alias("p")).count() == 1
    assert df.limit(0).groupBy().agg(last_row(df).alias("p")).select(last_expiry("p"), F.col("p")).first()[:] == (None, None)
