"""Twins of the source, cleaning and streaming queries."""

from renewlake.oracles.base import (cte, label, mdate, mstart, oracle, p_compact, p_flex, p_float, p_int, prev_month, yyyymm)

oracle("csv_scan", "SELECT * FROM d_raw_tx")
oracle("csv_scan_typed", "SELECT msno, city, registration_init_time FROM d_members")
oracle("csv_multi_source", "SELECT * FROM d_raw_tx")

_TX_FLOAT = ("plan_list_price", "actual_amount_paid")
cte("s_typed_tx", f"""SELECT CAST(rid AS BIGINT) AS rid, trim(msno) AS msno, {', '.join(f'{p_int(c)} AS {c}' for c in ('payment_method_id', 'payment_plan_days', 'is_auto_renew', 'is_cancel'))},
  {', '.join(f'{p_float(c)} AS {c}' for c in _TX_FLOAT)}, {', '.join(f'{p_flex(c)} AS {c}' for c in ('transaction_date', 'membership_expire_date'))} FROM d_raw_tx""")
cte("s_clean_tx", """SELECT * FROM s_typed_tx WHERE msno <> '' AND transaction_date IS NOT NULL AND membership_expire_date IS NOT NULL
  AND plan_list_price >= 0 AND actual_amount_paid >= 0 AND payment_plan_days >= 0 AND payment_method_id IS NOT NULL AND is_auto_renew IS NOT NULL AND is_cancel IS NOT NULL""")
_INTS = ("num_25", "num_50", "num_75", "num_985", "num_100", "num_unq")
cte("s_typed_logs", f"""SELECT trim(msno) AS msno, {p_flex('date')} AS date, {', '.join(f'{p_int(c)} AS {c}' for c in _INTS)}, {p_float('total_secs')} AS total_secs FROM d_raw_logs""")
cte("s_clean_logs", f"""SELECT * FROM s_typed_logs WHERE msno <> '' AND date IS NOT NULL AND total_secs >= 0 AND {' AND '.join(f'{c} >= 0' for c in _INTS)}""")


def typed_members(date: str, bd: str, gender: str) -> str:
    return f"""SELECT trim(msno) AS msno, {p_int('city')} AS city, {bd} AS bd, CASE WHEN trim(gender) = '' THEN 'unknown' ELSE {gender} END AS gender,
  {p_int('registered_via')} AS registered_via, {date} AS registration_init_time FROM d_raw_members"""


cte("s_clean_members", f"""SELECT * FROM ({typed_members(p_compact('registration_init_time'), f"CASE WHEN {p_int('bd')} > 0 THEN {p_int('bd')} END", 'lower(trim(gender))')})
  WHERE msno <> '' AND registration_init_time IS NOT NULL""")
cte("s_clean_train", f"""SELECT * FROM (SELECT trim(msno) AS msno, {p_int('is_churn')} AS is_churn,
  {p_flex("coalesce(nullif(trim(transaction_date), ''), nullif(trim(membership_expire_date), ''), nullif(trim(date), ''))")} AS churn_event_date FROM d_raw_train)
  WHERE msno <> '' AND is_churn IN (0, 1)""")

oracle("csv_chunk_scan", f"""SELECT msno, {mstart('date')} AS snapshot_month, CAST(sum(num_25 + num_50) AS BIGINT) AS skip_num,
  CAST(sum(num_25 + num_50 + num_75 + num_985 + num_100) AS BIGINT) AS play_num, CAST(sum(num_unq) AS BIGINT) AS disc_num, round(sum(total_secs), 4) AS total_secs,
  count(*) AS active_days FROM s_clean_logs WHERE date >= DATE '2023-01-01' AND date < DATE '2023-09-01' GROUP BY 1, 2""")
oracle("parquet_scan_subset", "SELECT o_orderkey, o_orderstatus, 'none' AS channel, round(o_totalprice, 4) AS o_totalprice FROM orders")
_TX = """rid, msno, payment_method_id, payment_plan_days, round(plan_list_price, 4) AS plan_list_price, round(actual_amount_paid, 4) AS actual_amount_paid,
  is_auto_renew, transaction_date, membership_expire_date, is_cancel"""
oracle("parquet_sink", f"SELECT {_TX} FROM d_tx")
oracle("csv_sink", """SELECT transaction_date, count(*) AS rows, round(sum(actual_amount_paid), 4) AS paid, CAST(sum(is_cancel) AS BIGINT) AS cancels FROM s_clean_tx GROUP BY ALL""")
_REV = "event_date, round(total_revenue, 4) AS total_revenue, total_transactions, cancel_count, auto_renew_count"
oracle("batch_append_sink", f"SELECT {_REV} FROM s_kpi_rev")
oracle("revenue_kpi_rebuild", f"SELECT {_REV} FROM s_kpi_rev")
_OK = "msno <> '' AND transaction_date IS NOT NULL AND membership_expire_date IS NOT NULL"
oracle("bulk_load_transactions", f"""SELECT rid, msno, coalesce(payment_method_id, 0) AS payment_method_id, coalesce(payment_plan_days, 0) AS payment_plan_days,
  round(coalesce(plan_list_price, 0), 4) AS plan_list_price, round(coalesce(actual_amount_paid, 0), 4) AS actual_amount_paid, coalesce(is_auto_renew, 0) AS is_auto_renew,
  transaction_date, membership_expire_date, coalesce(is_cancel, 0) AS is_cancel FROM s_typed_tx WHERE {_OK}""")
oracle("bulk_load_counts", f"SELECT count(*) FILTER ({_OK}) AS inserted, count(*) - count(*) FILTER ({_OK}) AS dropped FROM s_typed_tx")
oracle("bulk_load_members", f"""SELECT * FROM ({typed_members(p_flex('registration_init_time'), p_int('bd'), 'trim(gender)')})
  WHERE msno <> '' AND registration_init_time IS NOT NULL""")
oracle("guarded_rebuild", """SELECT * REPLACE (round(discovery_ratio, 6) AS discovery_ratio, round(skip_ratio, 6) AS skip_ratio),
  'written,rebuilt,skipped,rebuilt' AS steps FROM s_snap""")
oracle("month_partitioned_table", f"""SELECT {yyyymm('date')} AS yyyymm, count(*) AS rows, round(sum(total_secs), 4) AS secs, min(date) AS first, max(date) AS last FROM d_logs GROUP BY 1""")
oracle("jdbc_scan_pushdown", "SELECT * FROM s_profile")
oracle("clean_members", "SELECT * FROM s_clean_members")
oracle("member_dimension", "SELECT * FROM s_clean_members")
oracle("clean_transactions", f"SELECT {_TX} FROM s_clean_tx")
oracle("clean_user_logs", "SELECT * REPLACE (round(total_secs, 4) AS total_secs) FROM s_clean_logs")
oracle("clean_train", "SELECT * FROM s_clean_train")
oracle("parse_date_strict", f"SELECT registration_init_time, {p_compact('registration_init_time')} AS parsed FROM d_raw_members")
oracle("parse_date_flexible", "SELECT CAST(rid AS VARCHAR) AS rid, transaction_date, membership_expire_date FROM s_typed_tx")
oracle("parse_int_lenient", f"SELECT rid, {p_int('plan_list_price')} AS list_price, {p_int('actual_amount_paid')} AS paid, {p_int('is_auto_renew')} AS auto FROM d_raw_tx")
oracle("parse_float_lenient", f"""SELECT date, count({p_float('total_secs')}) AS parsed, count(*) AS rows, round(sum({p_float('total_secs')}), 4) AS secs FROM d_raw_logs GROUP BY 1""")
oracle("clean_drop_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", (SELECT count(*) FROM {c}) AS kept, (SELECT count(*) FROM {r}) - (SELECT count(*) FROM {c}) AS dropped"
    for n, c, r in (("members", "s_clean_members", "d_raw_members"), ("transactions", "s_clean_tx", "d_raw_tx"),
                    ("user_logs", "s_clean_logs", "d_raw_logs"), ("train", "s_clean_train", "d_raw_train"))))
oracle("tx_expiry_fix", f"""SELECT rid, transaction_date, greatest(membership_expire_date, transaction_date) AS membership_expire_date,
  CAST(membership_expire_date < transaction_date AS INTEGER) AS invalid_expire_before_txn, {yyyymm('transaction_date')} AS transaction_month,
  {yyyymm('greatest(membership_expire_date, transaction_date)')} AS expire_month FROM s_typed_tx WHERE transaction_date IS NOT NULL AND membership_expire_date IS NOT NULL""")
oracle("prepare_facts", f"""SELECT CASE WHEN regexp_full_match(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST(date AS DATE) END AS log_date, count(*) AS rows,
  round(sum({p_float('total_secs')}), 4) AS secs, CAST(sum({p_int('num_unq')}) AS BIGINT) AS unq FROM d_raw_logs GROUP BY 1""")
_M = "CAST(strftime({}, '%Y%m') AS INTEGER)"
oracle("month_arith", f"""SELECT m, {mdate('m')} AS start, {prev_month('m')} AS previous, {_M.format(mdate('m') + " + INTERVAL 1 MONTH")} AS next,
  {_M.format(mdate('m') + " + INTERVAL 14 MONTH")} AS later, {label('m')} AS label, CAST(day(last_day({mdate('m')})) AS INTEGER) AS days
  FROM (SELECT DISTINCT {yyyymm('membership_expire_date')} AS m FROM d_tx)""")
oracle("safe_divide", """SELECT rid, round(CASE WHEN plan_list_price = 0 THEN 0.0 ELSE actual_amount_paid / plan_list_price END, 4) AS paid_share,
  round(CASE WHEN payment_plan_days = 7 THEN -1.0 ELSE plan_list_price / payment_plan_days END, 4) AS per_day FROM d_tx""")
oracle("event_payload_encode", f"""SELECT trim(msno) AS key, trim(msno) AS msno, CAST({p_int('city')} AS VARCHAR) AS city, CAST({p_int('bd')} AS VARCHAR) AS bd,
  CASE WHEN trim(gender) = '' THEN 'unknown' ELSE trim(gender) END AS gender, CAST({p_int('registered_via')} AS VARCHAR) AS registered_via, registration_init_time FROM d_raw_members""")
oracle("kafka_json_parse", """SELECT msno AS kafka_key, date, CAST(sum(num_unq) AS BIGINT) AS unq, round(sum(total_secs), 4) AS secs, count(*) AS rows FROM s_typed_logs GROUP BY ALL""")
oracle("replay_by_day", """SELECT CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS replay_day, date AS replay_date, count(*) AS rows, count(DISTINCT msno) AS members
  FROM s_typed_logs WHERE msno <> '' AND date >= DATE '2023-03-30' GROUP BY date QUALIFY row_number() OVER (ORDER BY date) <= 60""")
oracle("replay_date_filter", """SELECT start, transaction_date AS day, count(*) AS rows FROM d_raw_tx, (VALUES ('2023-06-01'), ('2023/06/01')) v(start)
  WHERE start = '2023/06/01' OR NOT regexp_full_match(transaction_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR transaction_date >= start GROUP BY ALL""")
oracle("kafka_source", "SELECT msno AS key, count(*) AS messages FROM d_elogs GROUP BY ALL")
oracle("stream_fact_and_kpi", """SELECT transaction_date AS event_date, round(sum(actual_amount_paid), 4) AS total_revenue, count(*) AS total_transactions,
  count(*) FILTER (is_cancel = 1) AS cancel_count, count(*) FILTER (is_auto_renew = 1) AS auto_renew_count, count(*) AS fact_rows FROM s_clean_tx GROUP BY ALL""")
oracle("stream_activity", """SELECT date AS event_date, count(DISTINCT msno) AS active_users, round(sum(total_secs), 4) AS total_listening_secs,
  round(avg(num_unq), 4) AS avg_unique_songs, count(*) AS fact_rows FROM d_elogs GROUP BY ALL""")
oracle("stream_churn_risk", """SELECT event_date, count(*) FILTER (risk >= 0.6) AS high_risk_users, round(avg(risk), 4) AS avg_risk_score FROM (
  SELECT event_date, 0.4 * coalesce(is_cancel, 0.0) + 0.3 * (1.0 - coalesce(is_auto_renew, 1.0)) + 0.3 * CAST(secs < 1800 AS DOUBLE) AS risk
  FROM (SELECT msno, date AS event_date, sum(total_secs) AS secs FROM d_elogs GROUP BY ALL) LEFT JOIN s_profile USING (msno)) GROUP BY ALL""")
oracle("stream_daily_upsert", """SELECT date AS event_date, count(DISTINCT msno) AS active_users, round(sum(total_secs), 4) AS total_listening_secs,
  round(avg(num_unq), 4) AS avg_unique_songs FROM d_elogs GROUP BY ALL""")
oracle("replay_reset", """SELECT * FROM (VALUES ('fact', 0), ('kpi_activity', 0), ('kpi_churn_risk', 0)) v("table", rows)
  UNION ALL SELECT 'kpi_revenue', (SELECT count(*) FROM s_kpi_rev) UNION ALL SELECT 'member_month', (SELECT count(*) FROM s_snap WHERE source = 'history_precompute')""")
oracle("stable_sample", "SELECT msno FROM (SELECT DISTINCT msno FROM s_snap) ORDER BY md5(msno), msno LIMIT 500")
