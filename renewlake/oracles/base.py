"""Shared sub-selects: the domain tables over the test tables."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}

_NAME = re.compile(r"\b[ds]_[a-z0-9_]+\b")


def cte(name: str, sql: str) -> None:
    CTES[name] = nudge_rounding(sql)


def oracle(key: str, sql: str) -> None:
    if key in ORACLES:
        raise ValueError(f"twin {key} is defined twice")
    ORACLES[key] = with_ctes(nudge_rounding(sql))


def nudge_rounding(sql: str) -> str:
    """round(x, d) -> round(x + 10^-(d+3), d), as the registry does on the Spark side.

    A value that lies on a rounding half up to the last bits of a double then comes
    out alike in both engines.
    """
    out, i = [], 0
    for m in re.finditer(r"\bround\(", sql):
        depth, comma, j = 1, None, m.end()
        while depth:
            ch = sql[j]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = j
            j += 1
        digits = int(sql[comma + 1 : j - 1])
        out.append((comma, f" + 1e-{digits + 3}"))
    text, last = "", 0
    for at, extra in sorted(out):
        text += sql[last:at] + extra
        last = at
    return text + sql[last:]


def with_ctes(sql: str) -> str:
    sql = sql.strip()
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in CTES and name not in order:
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    head = "WITH " + ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in order)
    return head + (",\n" + sql[5:] if sql[:5].upper() == "WITH " else "\n" + sql)


def fold(c: str) -> str:
    return (f"(DATE '2023-01-01' + CAST(date_diff('day', DATE '1995-01-01', CAST({c} AS DATE)) % 420 AS INTEGER))")


def yyyymm(c: str) -> str:
    return f"CAST(year({c})*100 + month({c}) AS INTEGER)"


def yyyymmdd(c: str) -> str:
    return f"CAST(year({c})*10000 + month({c})*100 + day({c}) AS INTEGER)"


def mstart(c: str) -> str:
    return f"CAST(date_trunc('month', {c}) AS DATE)"


def label(c: str) -> str:
    """yyyymm -> YYYY-MM"""
    return f"(CAST({c} // 100 AS VARCHAR) || '-' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))"


def mdate(c: str) -> str:
    """yyyymm -> first day of the month"""
    return f"make_date({c} // 100, {c} % 100, 1)"


def prev_month(c: str) -> str:
    return f"CAST(CASE WHEN {c} % 100 = 1 THEN {c} - 89 ELSE {c} - 1 END AS INTEGER)"


cte("d_members", """
SELECT CAST(c_custkey AS VARCHAR) AS msno, CAST(c_nationkey + 1 AS INTEGER) AS city,
  CAST(CASE WHEN c_custkey % 97 = 0 THEN 1050 ELSE (c_custkey * 7) % 75 END AS INTEGER) AS bd,
  CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE '' END AS gender,
  CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 3 WHEN 'BUILDING' THEN 4 WHEN 'FURNITURE' THEN 7
    WHEN 'HOUSEHOLD' THEN 9 WHEN 'MACHINERY' THEN 13 END AS INTEGER) AS registered_via,
  DATE '2022-01-01' + CAST((c_custkey * 13) % 700 AS INTEGER) AS registration_init_time
FROM customer""")

cte("d_tx", f"""
SELECT rid, msno, payment_method_id, payment_plan_days, plan_list_price,
  plan_list_price * (10 - rid % 3) / 10 AS actual_amount_paid, is_auto_renew, transaction_date,
  transaction_date + CAST(CASE WHEN is_cancel = 1 THEN rid % 10 ELSE payment_plan_days END AS INTEGER)
    AS membership_expire_date, is_cancel
FROM (SELECT o_orderkey AS rid, CAST(o_custkey AS VARCHAR) AS msno,
  CAST(30 + o_custkey % 12 AS INTEGER) AS payment_method_id,
  CAST(CASE WHEN o_orderkey % 13 = 0 THEN 7 WHEN o_orderkey % 5 = 4 THEN 90 ELSE 30 END AS INTEGER) AS payment_plan_days,
  CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN o_orderkey % 5 = 4 THEN 400 WHEN o_orderkey % 10 = 3 THEN 240
    WHEN o_orderkey % 10 = 1 THEN 99 ELSE 149 END AS DOUBLE) AS plan_list_price,
  CAST(o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') AS INTEGER) AS is_auto_renew,
  {fold('o_orderdate')} AS transaction_date,
  CAST(o_orderkey % 11 = 0 AS INTEGER) AS is_cancel FROM orders)""")

cte("d_logs", f"""
SELECT CAST(o_custkey AS VARCHAR) AS msno, {fold('l_shipdate')} AS date,
  CAST(l_linenumber AS INTEGER) AS num_25, CAST(CAST(floor(l_quantity) AS INTEGER) % 5 AS INTEGER) AS num_50,
  CAST(l_partkey % 4 AS INTEGER) AS num_75, CAST(l_suppkey % 3 AS INTEGER) AS num_985,
  CAST(CAST(floor(l_quantity) AS INTEGER) % 20 AS INTEGER) AS num_100, CAST(1 + l_partkey % 40 AS INTEGER) AS num_unq,
  CASE WHEN l_partkey % 10 = 0 THEN l_extendedprice ELSE l_extendedprice / 20 END AS total_secs
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

cte("d_elogs", """
SELECT event_id, CAST(user_id AS VARCHAR) AS msno, CAST(ts AS DATE) AS date,
  CAST(event_type = 'error' AS INTEGER) AS num_25, CAST(event_type = 'signup' AS INTEGER) AS num_50,
  CAST(event_type = 'view' AS INTEGER) AS num_75, CAST(event_type = 'click' AS INTEGER) AS num_985,
  CAST(event_type = 'purchase' AS INTEGER) AS num_100,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS num_unq, value * 60 AS total_secs
FROM events""")


def _mixed(c: str, even: str) -> str:
    return f"CASE WHEN {even} THEN strftime({c}, '%Y%m%d') ELSE strftime({c}, '%Y-%m-%d') END"


cte("d_raw_tx", f"""
SELECT CAST(rid AS VARCHAR) AS rid, CASE WHEN rid % 50 = 0 THEN ' ' ELSE msno END AS msno,
  CAST(payment_method_id AS VARCHAR) AS payment_method_id, CAST(payment_plan_days AS VARCHAR) AS payment_plan_days,
  CASE WHEN rid % 53 = 0 THEN 'abc' WHEN rid % 59 = 0 THEN '-1.0' ELSE CAST(plan_list_price AS VARCHAR) END AS plan_list_price,
  CAST(actual_amount_paid AS VARCHAR) AS actual_amount_paid, CAST(is_auto_renew AS VARCHAR) || '.0' AS is_auto_renew,
  CASE WHEN rid % 67 = 0 THEN '2023/01/01' ELSE {_mixed('transaction_date', 'rid % 2 = 0')} END AS transaction_date,
  {_mixed('(CASE WHEN rid % 61 = 0 THEN transaction_date - 3 ELSE membership_expire_date END)', 'rid % 2 = 0')} AS membership_expire_date,
  CAST(is_cancel AS VARCHAR) AS is_cancel
FROM d_tx""")

cte("d_raw_members", f"""
SELECT CASE WHEN k % 50 = 0 THEN '' ELSE msno || ' ' END AS msno, CAST(city AS VARCHAR) AS city,
  CASE WHEN k % 41 = 0 THEN '' ELSE CAST(bd AS VARCHAR) END AS bd,
  CASE gender WHEN 'male' THEN ' Male' WHEN 'female' THEN 'FEMALE' ELSE '' END AS gender,
  CASE WHEN k % 43 = 0 THEN 'x' ELSE CAST(registered_via AS VARCHAR) END AS registered_via,
  CASE WHEN k % 47 = 0 THEN '' ELSE {_mixed('registration_init_time', 'k % 4 <> 0')} END AS registration_init_time
FROM (SELECT *, CAST(msno AS BIGINT) AS k FROM d_members)""")

cte("d_raw_logs", f"""
SELECT CASE WHEN num_unq = 7 AND num_100 = 3 THEN '' ELSE msno END AS msno,
  CASE WHEN num_unq = 9 AND num_100 = 4 THEN 'n/a' ELSE {_mixed('date', 'num_unq % 2 = 0')} END AS date,
  CAST(num_25 AS VARCHAR) AS num_25, CAST(num_50 AS VARCHAR) AS num_50, CAST(num_75 AS VARCHAR) AS num_75,
  CAST(num_985 AS VARCHAR) AS num_985, CAST(num_100 AS VARCHAR) AS num_100,
  CASE WHEN num_unq = 11 AND num_100 = 5 THEN '-2' ELSE CAST(num_unq AS VARCHAR) END AS num_unq,
  CASE WHEN num_unq = 13 AND num_100 = 6 THEN 'abc' ELSE CAST(total_secs AS VARCHAR) END AS total_secs
FROM d_logs""")

cte("d_raw_train", """
SELECT CASE WHEN c_custkey % 50 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS msno,
  CASE WHEN c_custkey % 37 = 0 THEN '9' WHEN c_custkey % 2 = 0 THEN '1.0' ELSE '0' END AS is_churn,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE strftime(d, '%Y%m%d') END AS transaction_date,
  CASE WHEN c_custkey % 8 = 0 THEN '' ELSE strftime(d + 1, '%Y-%m-%d') END AS membership_expire_date,
  strftime(d + 2, '%Y%m%d') AS date
FROM (SELECT c_custkey, DATE '2023-03-01' + CAST(c_custkey % 60 AS INTEGER) AS d FROM customer)""")


# Parsing of text columns, as SQL text.
def p_text(c: str) -> str:
    return f"coalesce(trim({c}), '')"


def p_int(c: str) -> str:
    return f"TRY_CAST(trunc(TRY_CAST(trim({c}) AS DOUBLE)) AS INTEGER)"


def p_float(c: str) -> str:
    return f"TRY_CAST(trim({c}) AS DOUBLE)"


def p_compact(c: str) -> str:
    return (f"(CASE WHEN regexp_full_match(trim({c}), '[0-9]{{8}}') "
            f"THEN CAST(try_strptime(trim({c}), '%Y%m%d') AS DATE) END)")


def p_flex(c: str) -> str:
    return (f"coalesce(CASE WHEN regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') "
            f"THEN TRY_CAST(trim({c}) AS DATE) END, {p_compact(c)})")
