"""Churn labels against a plain month-by-month walk, also with one member owning a third of the rows."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from renewlake.operators import labels as L

SCHEMA = ("rid long, msno string, payment_method_id int, payment_plan_days int, plan_list_price double, actual_amount_paid double, "
          "is_auto_renew int, transaction_date date, membership_expire_date date, is_cancel int")
MONTHS = [202302 + i for i in range(8)]


def number(day):
    return day.year * 10000 + day.month * 100 + day.day


def walk(rows):
    """Expected labels, one member and month at a time."""
    out, members = {}, defaultdict(list)
    for r in rows:
        members[r[1]].append(r)

    def rank(r):
        expire = number(r[8])
        return (-r[4], -r[3], -r[2], r[9], -expire if r[9] else expire, r[0])

    for msno, own in members.items():
        for month in MONTHS:
            past = [r for r in own if number(r[7]) // 100 < month]
            if not past:
                continue
            last = max(r[7] for r in past)
            eff = max((r for r in past if r[7] == last), key=rank)
            if number(eff[8]) // 100 != month:
                continue
            expire, gap = eff[8], None
            for r in sorted((r for r in own if number(r[7]) // 100 >= month), key=lambda r: (r[7], rank(r))):
                if r[9]:
                    expire = min(expire, r[8])
                else:
                    gap = (r[7] - expire).days
                    break
            before = sorted((r for r in own if (r[7], r[8], r[0]) < (eff[7], eff[8], eff[0])), key=lambda r: (r[7], r[8], r[0]))
            since = (eff[7] - before[-1][7]).days if before else -1
            out[(msno, month)] = (eff[0], gap, int(gap is None or gap >= 30), len(past), sum(r[9] for r in past), since)
    return out


def random_rows(seed, n, hot_share):
    rng = random.Random(seed)
    rows = []
    for rid in range(n):
        day = dt.date(2023, 1, 1) + dt.timedelta(days=rng.randrange(280))
        cancel = int(rng.random() < 0.25)
        expire = day + dt.timedelta(days=rng.choice([0, 1, 5, 20, 33] if cancel else [7, 30, 31, 90]))
        member = "hot" if rng.random() < hot_share else f"m{rng.randrange(40)}"
        rows.append((rid, member, rng.choice([38, 41]), rng.choice([7, 30]), rng.choice([99.0, 149.0]), 99.0, rng.randrange(2), day, expire, cancel))
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 0.0), (2, 0.35)])
def test_labels_equal_the_walk(spark, seed, hot):
    rows = random_rows(seed, 900, hot)
    tx = L.fix_expiry(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = L.add_label(L.cohort(L.effective_days(tx), 202301, 202309))
    got = {
        (r["msno"], r["target_month"]): (r["rid"], r["renewal_gap_days"], r["is_churn"], r["to_date_rows"], r["to_date_cancels"],
                                         r["days_since_previous_transaction"])
        for r in got.collect()
    }
    assert got == walk(rows) and len(got) > 30


def test_walk_examples(spark):
    day = dt.date.fromisoformat

    def gap(rows):
        full = [(i, "u", 41, 30, 149.0, 149.0, 1, day(a), day(b), c) for i, (a, b, c) in enumerate(rows)]
        got = L.add_label(L.cohort(L.effective_days(L.fix_expiry(spark.createDataFrame(full, SCHEMA))), 202301, 202304)).collect()
        return {r["target_month"]: (r["renewal_gap_days"], r["is_churn"]) for r in got}

    first = ("2023-01-05", "2023-02-04", 0)
    assert gap([first, ("2023-02-02", "2023-02-02", 1), ("2023-03-10", "2023-04-09", 0)])[202302] == (36, 1)
    assert gap([first, ("2023-03-10", "2023-04-09", 0)])[202302] == (34, 1)
    with_early = gap([first, ("2023-03-01", "2023-03-31", 0)])
    assert with_early[202302] == (25, 0)
    assert gap([first, ("2023-03-10", "2023-04-09", 0)])[202304] == (None, 1)


def test_lower_offer_wins_on_one_day(spark):
    day = dt.date(2023, 1, 5)
    rows = [(0, "u", 41, 30, 149.0, 149.0, 1, day, dt.date(2023, 2, 4), 0), (1, "u", 41, 30, 99.0, 99.0, 1, day, dt.date(2023, 2, 4), 0)]
    ranked = L.same_day_rank(spark.createDataFrame(rows, SCHEMA)).orderBy("day_rank").collect()
    assert ranked[-1]["plan_list_price"] == 99.0
    assert L.effective_days(L.fix_expiry(spark.createDataFrame(rows, SCHEMA))).first()["plan_list_price"] == 99.0
