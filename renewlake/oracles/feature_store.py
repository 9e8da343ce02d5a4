"""Twins of the label and feature queries.

The labels are written row by row (row numbers and self joins), independent of the
day-wise formulation on the Spark side.
"""

from renewlake.oracles.base import cte, mdate, oracle, prev_month, yyyymm, yyyymmdd

KEY = """plan_list_price DESC, payment_plan_days DESC, payment_method_id DESC, is_cancel,
  CASE WHEN is_cancel = 1 THEN -date_diff('day', DATE '2000-01-01', membership_expire_date) ELSE date_diff('day', DATE '2000-01-01', membership_expire_date) END, rid"""

cte("s_rows", f"""SELECT *, CAST(membership_expire_date < transaction_date AS INTEGER) AS invalid_expire_before_txn,
  {yyyymm('transaction_date')} AS tm, {yyyymm('membership_expire_date')} AS em,
  row_number() OVER (PARTITION BY msno ORDER BY transaction_date, {KEY}) AS k,
  row_number() OVER (PARTITION BY msno ORDER BY transaction_date, membership_expire_date, rid) AS by_expiry,
  lag(transaction_date) OVER (PARTITION BY msno ORDER BY transaction_date, membership_expire_date, rid) AS previous FROM d_tx""")
cte("s_next", """SELECT *, lead(tm) OVER w AS ntm, lead(transaction_date) OVER w AS ntd FROM s_rows WINDOW w AS (PARTITION BY msno ORDER BY k)""")
cte("s_cohort_rows", """SELECT *, em AS target_month FROM s_next WHERE (ntd IS NULL OR ntd <> transaction_date)
  AND tm < em AND (ntm IS NULL OR ntm >= em) AND em > 202301 AND em <= 202402""")
cte("s_gap", """SELECT c.msno, c.target_month, c.k, min(p.k) AS nk FROM s_cohort_rows c
  LEFT JOIN s_rows p ON p.msno = c.msno AND p.k > c.k AND p.is_cancel = 0 GROUP BY ALL""")
cte("s_gap_days", """SELECT c.*, date_diff('day', least(c.membership_expire_date, coalesce(x.mc, c.membership_expire_date)), p.transaction_date) AS gap
  FROM s_cohort_rows c JOIN s_gap g ON g.msno = c.msno AND g.k = c.k
  LEFT JOIN s_rows p ON p.msno = c.msno AND p.k = g.nk
  LEFT JOIN (SELECT g.msno, g.k, min(r.membership_expire_date) AS mc FROM s_gap g JOIN s_rows r
    ON r.msno = g.msno AND r.k > g.k AND r.k < g.nk AND r.is_cancel = 1 GROUP BY ALL) x ON x.msno = c.msno AND x.k = c.k""")
cte("s_churn", "SELECT *, CAST(gap IS NULL OR gap >= 30 AS INTEGER) AS is_churn FROM s_gap_days")
cte("s_hist", """SELECT c.msno, c.target_month, count(*) AS n, sum(r.actual_amount_paid) AS paid, sum(r.plan_list_price) AS listed,
  sum(r.is_cancel) AS cancels, sum(r.is_auto_renew) AS autos FROM s_cohort_rows c JOIN s_rows r ON r.msno = c.msno AND r.tm < c.target_month GROUP BY ALL""")
_LAGS = ", ".join(f"coalesce(lag(is_churn, {k}) OVER w, -1) AS last_{k}_is_churn" for k in range(1, 6))
cte("s_labels", f"""SELECT msno, target_month, is_churn, {yyyymmdd('membership_expire_date')} AS expire_date, {yyyymmdd('transaction_date')} AS transaction_date,
  payment_method_id, payment_plan_days, plan_list_price, actual_amount_paid, is_auto_renew, invalid_expire_before_txn, {_LAGS},
  coalesce(avg(is_churn) OVER b, CAST(-1 AS DOUBLE)) AS churn_rate, CAST(coalesce(sum(is_churn) OVER b, -1) AS INTEGER) AS churn_count,
  CAST(CASE WHEN count(*) OVER b = 0 THEN -1 ELSE count(*) OVER b END AS INTEGER) AS transaction_count,
  plan_list_price - actual_amount_paid AS discount, CAST(plan_list_price - actual_amount_paid > 0 AS INTEGER) AS is_discount,
  CASE WHEN payment_plan_days IN (0, -1) THEN -1.0 ELSE actual_amount_paid / payment_plan_days END AS amt_per_day,
  CAST(h.n AS INTEGER) AS historical_transaction_rows, h.paid AS historical_paid_total, h.paid / h.n AS historical_paid_mean,
  h.listed / h.n AS historical_list_price_mean, CAST(h.cancels AS INTEGER) AS historical_cancel_count, h.cancels / h.n AS historical_cancel_rate,
  h.autos / h.n AS historical_auto_renew_rate,
  CAST(coalesce(date_diff('day', previous, transaction_date_raw), -1) AS INTEGER) AS days_since_previous_transaction
  FROM (SELECT *, transaction_date AS transaction_date_raw FROM s_churn) JOIN s_hist h USING (msno, target_month)
  WINDOW w AS (PARTITION BY msno ORDER BY target_month), b AS (PARTITION BY msno ORDER BY target_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

oracle("same_day_rank", f"""SELECT msno, transaction_date, rid, CAST(row_number() OVER (PARTITION BY msno, transaction_date ORDER BY {KEY}) AS INTEGER) AS day_rank FROM d_tx""")
oracle("effective_tx", "SELECT msno, target_month, transaction_date, membership_expire_date AS expire_date, rid FROM s_cohort_rows")
oracle("renewal_gap", "SELECT msno, target_month, CAST(gap AS INTEGER) AS renewal_gap_days FROM s_gap_days")
oracle("churn_label", """SELECT target_month, count(*) AS members, CAST(sum(is_churn) AS BIGINT) AS churned, count(gap) AS renewed_later FROM s_churn GROUP BY ALL""")
_DOUBLES = ("plan_list_price actual_amount_paid churn_rate discount amt_per_day historical_paid_total historical_paid_mean "
            "historical_list_price_mean historical_cancel_rate historical_auto_renew_rate").split()


def rounded(columns, of=()):
    return ", ".join(f"round({c}, 4) AS {c}" for c in columns if not of or c in of)


oracle("churn_history", f"""SELECT msno, target_month, {', '.join(f'last_{k}_is_churn' for k in range(1, 6))}, round(churn_rate, 4) AS churn_rate,
  churn_count, transaction_count FROM s_labels""")
oracle("tx_history_aggregates", """SELECT msno, target_month, historical_transaction_rows, historical_cancel_count, round(historical_paid_total, 4) AS historical_paid_total,
  round(historical_paid_mean, 4) AS historical_paid_mean, round(historical_list_price_mean, 4) AS historical_list_price_mean,
  round(historical_cancel_rate, 4) AS historical_cancel_rate, round(historical_auto_renew_rate, 4) AS historical_auto_renew_rate FROM s_labels""")
oracle("tx_point_features", """SELECT msno, target_month, round(discount, 4) AS discount, is_discount, round(amt_per_day, 4) AS amt_per_day,
  days_since_previous_transaction FROM s_labels""")
oracle("month_labels", f"SELECT * REPLACE ({rounded(_DOUBLES)}) FROM s_labels")

# logs -------------------------------------------------------------------------------------
LOGS = ("num_25", "num_50", "num_75", "num_985", "num_100", "num_unq")
cte("s_log_agg", f"""SELECT {yyyymm('date')} AS log_month, msno, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}_sum' for c in LOGS)},
  sum(least(greatest(total_secs, 0), 86400)) AS total_secs_sum, count(*) AS "count", {yyyymmdd('max(date)')} AS last_log_date,
  CAST(sum(CAST(total_secs > 86400 AS INTEGER)) AS BIGINT) AS capped_log_count FROM d_logs GROUP BY 1, 2""")
cte("s_required", f"SELECT DISTINCT {prev_month('target_month')} AS log_month, msno FROM s_labels")
oracle("log_month_agg", "SELECT * REPLACE (round(total_secs_sum, 4) AS total_secs_sum) FROM s_log_agg SEMI JOIN s_required USING (log_month, msno)")
oracle("log_cache_coverage", """SELECT log_month, count(r) AS required_msnos, count(b) AS cached_rows, count(r + b) AS usable_rows,
  count(*) FILTER (b IS NULL) AS missing_required_msnos, count(*) FILTER (r IS NULL) AS unexpected_cached_msnos
  FROM (SELECT *, 1 AS r FROM s_required) FULL OUTER JOIN (SELECT log_month, msno, 1 AS b FROM s_log_agg) USING (log_month, msno) GROUP BY ALL""")
_ALL = (*LOGS, "total_secs")
cte("s_raw", f"""SELECT l.*, {', '.join(f'a.{c}_sum' for c in _ALL)}, a."count", a.last_log_date, a.capped_log_count,
  {', '.join(f'a.{c}_sum / a."count" AS {c}_mean' for c in _ALL)}, e.city, e.bd, e.gender, e.registered_via, e.registration_init_time
  FROM s_labels l LEFT JOIN s_log_agg a ON a.msno = l.msno AND a.log_month = {prev_month('l.target_month')} LEFT JOIN s_enc e ON e.msno = l.msno""")
cte("s_enc", f"""SELECT msno, city, CASE WHEN bd BETWEEN 15 AND 65 THEN bd END AS bd,
  CAST(CASE gender WHEN 'male' THEN 1 WHEN 'female' THEN 2 ELSE 0 END AS INTEGER) AS gender, registered_via,
  {yyyymmdd('registration_init_time')} AS registration_init_time FROM d_members""")
_LOGF = ", ".join([*(f"{c}_sum" for c in LOGS), "round(total_secs_sum, 4) AS total_secs_sum", '"count"', "last_log_date", "capped_log_count",
                   *(f"round({c}_mean, 4) AS {c}_mean" for c in _ALL)])
oracle("log_features", f"SELECT msno, target_month, {_LOGF} FROM s_raw")
oracle("log_secs_cap", """SELECT date, CAST(sum(CAST(total_secs > 86400 AS INTEGER)) AS BIGINT) AS capped, round(max(least(total_secs, 86400)), 4) AS max_secs,
  round(sum(least(total_secs, 86400)), 4) AS secs FROM d_logs GROUP BY ALL""")
oracle("member_encode", "SELECT * FROM s_enc")


# feature layers ------------------------------------------------------------------------------
def d(c: str) -> str:
    return f"CAST(strptime(CAST({c} AS VARCHAR), '%Y%m%d') AS DATE)"


def div(a: str, b: str, default: str = "0.0") -> str:
    return f"coalesce({a} / nullif(CAST({b} AS DOUBLE), 0), CAST({default} AS DOUBLE))"


def days(a: str, b: str) -> str:
    return f"CAST(date_diff('day', {a}, {b}) AS INTEGER)"


cte("s_l0", f"""SELECT * REPLACE (CASE WHEN invalid_registration_after_snapshot = 0 THEN registration_init_time END AS registration_init_time) FROM
  (SELECT *, {mdate('target_month')} - 1 AS snap, CAST(coalesce({d('registration_init_time')} > {mdate('target_month')} - 1, false) AS INTEGER)
   AS invalid_registration_after_snapshot FROM s_raw)""")
cte("s_l1", f"""SELECT *, CAST(coalesce(bd, -1) AS DOUBLE) AS age, CAST(bd IS NOT NULL AS INTEGER) AS has_valid_age,
  CAST(transaction_date // 100 AS INTEGER) AS transaction_month, CAST(expire_date // 100 AS INTEGER) AS expire_month, CAST(expire_date // 100 AS INTEGER) AS last_expire_month,
  CAST(transaction_date % 100 AS INTEGER) AS transaction_day, CAST(expire_date % 100 AS INTEGER) AS expire_day,
  CAST(registration_init_time // 10000 AS INTEGER) AS registration_year, CAST(registration_init_time // 100 % 100 AS INTEGER) AS registration_month,
  CAST(registration_init_time % 100 AS INTEGER) AS registration_day, {days('snap', d('expire_date'))} AS days_to_expire,
  {days(d('registration_init_time'), 'snap')} AS membership_age_days, {days(d('last_log_date'), 'snap')} AS days_since_last_listen,
  {div(days(d('registration_init_time'), 'snap'), '30', '-1')} AS tenure_months FROM s_l0""")
cte("s_l2", f"""SELECT *, CASE WHEN actual_amount_paid > 0 THEN actual_amount_paid ELSE plan_list_price END AS expected_renewal_amount,
  plan_list_price - actual_amount_paid AS price_gap, {div('(plan_list_price - actual_amount_paid)', 'plan_list_price')} AS discount_ratio,
  {div('actual_amount_paid', 'plan_list_price')} AS payment_to_list_ratio, {div('(plan_list_price - actual_amount_paid)', 'payment_plan_days')} AS price_gap_per_plan_day,
  {div('total_secs_sum', 'actual_amount_paid')} AS secs_per_paid_amount FROM s_l1""")
cte("s_l3a", """SELECT *, num_25_sum * CAST(0.25 AS DOUBLE) + num_50_sum * CAST(0.5 AS DOUBLE) + num_75_sum * CAST(0.75 AS DOUBLE) + num_985_sum * CAST(0.985 AS DOUBLE) + num_100_sum * CAST(1 AS DOUBLE) AS weighted_completion_sum,
  num_25_sum + num_50_sum + num_75_sum + num_985_sum + num_100_sum AS listen_events_sum, num_25_sum + num_50_sum + num_75_sum AS skip_events_sum FROM s_l2""")
_Q = {"secs_per_log": ("total_secs_sum", '"count"'), "unique_per_log": ("num_unq_sum", '"count"'), "num100_per_log": ("num_100_sum", '"count"'),
      "weighted_completion_per_log": ("weighted_completion_sum", '"count"'), "listen_events_per_log": ("listen_events_sum", '"count"'),
      "avg_secs_per_unique": ("total_secs_sum", "num_unq_sum"), "secs_per_plan_day": ("total_secs_sum", "payment_plan_days"),
      "uniques_per_plan_day": ("num_unq_sum", "payment_plan_days"), "logs_per_plan_day": ('"count"', "payment_plan_days"),
      "remaining_plan_ratio": ("days_to_expire", "payment_plan_days"), "completion_ratio": ("weighted_completion_sum", "listen_events_sum"),
      "skip_ratio": ("skip_events_sum", "listen_events_sum"), "discovery_ratio": ("num_unq_sum", "listen_events_sum"),
      "capped_log_share": ("capped_log_count", '"count"')}
cte("s_l3", f"""SELECT *, least(greatest(1 - discovery_ratio, 0.0), 1.0) AS replay_ratio FROM (SELECT *, {', '.join(f'{div(a, b)} AS {n}' for n, (a, b) in _Q.items())} FROM s_l3a)""")
cte("s_l4", f"""SELECT *, CAST({' + '.join(f'greatest(last_{k}_is_churn, 0)' for k in range(1, 6))} AS DOUBLE) AS recent_churn_events,
  CAST({' + '.join(f'{6 - k} * greatest(last_{k}_is_churn, 0)' for k in range(1, 6))} AS DOUBLE) AS weighted_recent_churn FROM s_l3""")


def f(c: str) -> str:
    return f"CAST(coalesce({c}, false) AS INTEGER)"


cte("s_l5", f"""SELECT *, 1 AS is_expiring_user, {f('is_auto_renew = 0')} AS is_manual_renew, {f('listen_events_sum > 0 AND skip_ratio >= 0.5')} AS high_skip_flag,
  {f('listen_events_sum > 0 AND discovery_ratio < 0.2')} AS low_discovery_flag, {f('amt_per_day > 0 AND amt_per_day < 4.5')} AS deal_hunter_flag,
  {f('expected_renewal_amount <= 0')} AS free_trial_flag, {f('listen_events_sum > 0 AND skip_ratio >= 0.5 AND discovery_ratio < 0.2')} AS content_fatigue_flag,
  CAST(is_auto_renew * is_discount AS DOUBLE) AS auto_renew_discount_interaction, churn_rate * transaction_count AS churn_rate_x_transaction_count FROM s_l4""")
cte("s_l6", """SELECT *, rfm_recency_score + rfm_frequency_score + rfm_monetary_score AS rfm_total_score FROM (SELECT *,
  CASE WHEN listen_events_sum > 0 THEN CASE WHEN days_since_last_listen <= 7 THEN 3 WHEN days_since_last_listen <= 21 THEN 2 ELSE 1 END ELSE 0 END AS rfm_recency_score,
  CASE WHEN "count" > 15 THEN 3 WHEN "count" > 5 THEN 2 WHEN "count" > 0 THEN 1 ELSE 0 END AS rfm_frequency_score,
  CASE WHEN expected_renewal_amount >= 150 THEN 3 WHEN expected_renewal_amount >= 100 THEN 2 WHEN expected_renewal_amount > 0 THEN 1 ELSE 0 END AS rfm_monetary_score FROM s_l5)""")
cte("s_l7", """SELECT *, CASE WHEN age BETWEEN 15 AND 20 THEN 1 WHEN age BETWEEN 21 AND 25 THEN 2 WHEN age BETWEEN 26 AND 35 THEN 3 WHEN age BETWEEN 36 AND 50 THEN 4 WHEN age BETWEEN 51 AND 65 THEN 5 ELSE 0 END AS age_segment_code,
  CASE WHEN amt_per_day <= 0 THEN 1 WHEN amt_per_day < 4.5 THEN 2 WHEN amt_per_day < 6.5 THEN 3 WHEN amt_per_day >= 6.5 THEN 4 ELSE 0 END AS price_segment_code,
  CASE WHEN membership_age_days >= 365 THEN 4 WHEN membership_age_days >= 180 THEN 3 WHEN membership_age_days >= 30 THEN 2 WHEN membership_age_days >= 0 THEN 1 ELSE 0 END AS loyalty_segment_code,
  CASE WHEN "count" > 15 THEN 4 WHEN "count" > 5 THEN 3 WHEN "count" > 0 THEN 2 WHEN "count" <= 0 THEN 1 ELSE 0 END AS active_segment_code,
  CASE WHEN listen_events_sum <= 0 THEN 0 WHEN skip_ratio < 0.2 THEN 1 WHEN skip_ratio < 0.5 THEN 2 ELSE 3 END AS skip_segment_code,
  CASE WHEN listen_events_sum <= 0 THEN 0 WHEN discovery_ratio < 0.2 THEN 1 WHEN discovery_ratio < 0.5 THEN 2 ELSE 3 END AS discovery_segment_code,
  CASE is_auto_renew WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS renewal_segment_code,
  CASE WHEN rfm_total_score >= 8 THEN 3 WHEN rfm_total_score >= 5 THEN 2 WHEN rfm_total_score > 0 THEN 1 ELSE 0 END AS rfm_segment_code FROM s_l6""")


def label(code: str, values: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values.split(';'))}], {code} + 1)"


_SEGMENTS = {
    "age": "Unknown;15-20;21-25;26-35;36-50;51-65",
    "price": "Unknown;Free Trial / Zero Pay;Deal Hunter < 4.5;Standard 4.5-6.5;Premium >= 6.5",
    "loyalty": "Unknown;New < 30d;Growing 30-179d;Established 180-364d;Loyal >= 365d",
    "active": "Unknown;Inactive;Light 1-5 logs;Active 6-15 logs;Heavy > 15 logs",
    "skip": "No Listening Data;Low < 20%;Medium 20-50%;High >= 50%",
    "discovery": "No Listening Data;Habit < 20%;Balanced 20-50%;Explore >= 50%",
    "renewal": "Unknown;Pay_Auto-Renew;Pay_Manual",
    "rfm": "Unclassified;Low Value;Mid Value;High Value",
}
cte("s_l8", f"""SELECT * REPLACE (coalesce(gender, 0) AS gender), {label('coalesce(gender, 0)', 'Unknown;Male;Female')} AS gender_profile,
  loyalty_segment || ' | ' || renewal_segment || ' | ' || price_segment || ' | ' || discovery_segment AS bi_segment_name
  FROM (SELECT * EXCLUDE (snap), {', '.join(f"{label(f'{n}_segment_code', v)} AS {n}_segment" for n, v in _SEGMENTS.items())} FROM s_l7)""")
TEXT = ["msno", *[f"{n}_segment" for n in _SEGMENTS], "gender_profile", "bi_segment_name"]
cte("s_features", f"SELECT {', '.join(TEXT)}, coalesce(COLUMNS(* EXCLUDE ({', '.join(TEXT)})), -1) FROM s_l8")

_FDOUBLE = set(_DOUBLES) | {"tenure_months", "age", "total_secs_sum", *(f"{c}_mean" for c in _ALL), "expected_renewal_amount", "price_gap", "discount_ratio",
                            "payment_to_list_ratio", "price_gap_per_plan_day", "secs_per_paid_amount", "weighted_completion_sum", *_Q, "replay_ratio",
                            "churn_rate_x_transaction_count", "recent_churn_events", "weighted_recent_churn", "auto_renew_discount_interaction"}


def layer(key: str, source: str, columns: str) -> None:
    cols = ", ".join(f"round({c}, 4) AS {c}" if c in _FDOUBLE else c for c in columns.split())
    oracle(key, f"SELECT msno, target_month, {cols} FROM {source}")


layer("feat_dates", "s_l1", """invalid_registration_after_snapshot registration_init_time age has_valid_age transaction_month expire_month last_expire_month transaction_day
  expire_day registration_year registration_month registration_day days_to_expire membership_age_days days_since_last_listen tenure_months""")
layer("feat_price", "s_l2", "expected_renewal_amount price_gap discount_ratio payment_to_list_ratio price_gap_per_plan_day secs_per_paid_amount")
layer("feat_listening", "s_l3", "weighted_completion_sum listen_events_sum skip_events_sum replay_ratio " + " ".join(_Q))
layer("feat_churn_recency", "s_l4", "recent_churn_events weighted_recent_churn")
layer("feat_flags", "s_l5", """is_expiring_user is_manual_renew high_skip_flag low_discovery_flag deal_hunter_flag free_trial_flag content_fatigue_flag
  auto_renew_discount_interaction churn_rate_x_transaction_count""")
layer("rfm_scores", "s_l6", "rfm_recency_score rfm_frequency_score rfm_monetary_score rfm_total_score")
layer("segment_codes", "s_l7", " ".join(f"{n}_segment_code" for n in _SEGMENTS))
layer("segment_labels", "s_l8", " ".join(f"{n}_segment" for n in _SEGMENTS) + " gender gender_profile bi_segment_name")
layer("fillna_numeric", "s_features", 'bd last_log_date "count" total_secs_sum registration_init_time membership_age_days days_since_last_listen')
oracle("feature_frame", f"SELECT * REPLACE ({', '.join(f'round({c}, 4) AS {c}' for c in sorted(_FDOUBLE))}) FROM s_features")
oracle("snapshot_validation", """SELECT count(*) FILTER (last_log_date > 0 AND "count" > 0 AND days_since_last_listen < 0) AS negative_days_since_last_listen,
  count(*) FILTER (days_to_expire < 0 OR days_to_expire > 31) AS days_to_expire_out_of_range,
  count(*) FILTER (registration_init_time > 0 AND membership_age_days < 0) AS negative_membership_age FROM s_features""")
oracle("uniqueness_check", """SELECT count(*) AS duplicated_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM
  (SELECT msno, count(*) AS n FROM s_labels GROUP BY ALL HAVING count(*) > 1)""")
cte("s_expected", "SELECT msno FROM s_profile WHERE is_cancel = 0")
cte("s_built", "SELECT * FROM s_features WHERE target_month = 202402")
oracle("cohort_alignment", """SELECT *, CAST(missing_from_built = 0 AND unexpected_in_built = 0 AS INTEGER) AS exact_match FROM (
  SELECT (SELECT count(*) FROM s_expected) AS expected_rows, (SELECT count(*) FROM s_built) AS built_rows,
  (SELECT count(*) FROM s_expected ANTI JOIN s_built USING (msno)) AS missing_from_built, (SELECT count(*) FROM s_built ANTI JOIN s_expected USING (msno)) AS unexpected_in_built)""")
oracle("cohort_aligned_rows", """SELECT msno, coalesce(target_month, 202402) AS target_month, transaction_date, round(expected_renewal_amount, 4) AS expected_renewal_amount,
  CAST(transaction_date IS NULL AS INTEGER) AS missing_from_built_test FROM s_expected LEFT JOIN s_built USING (msno)""")
oracle("member_backfill", """SELECT e.msno, coalesce(b.target_month, 202402) AS target_month, coalesce(b.transaction_date, -1) AS transaction_date,
  coalesce(b.city, m.city, -1) AS city, coalesce(b.bd, m.bd, -1) AS bd, CAST(b.transaction_date IS NULL AS INTEGER) AS missing_from_built_test,
  coalesce(m.gender, -1) AS gender, coalesce(m.registered_via, -1) AS registered_via, coalesce(m.registration_init_time, -1) AS registration_init_time
  FROM s_expected e LEFT JOIN s_built b ON b.msno = e.msno LEFT JOIN s_enc m ON m.msno = e.msno""")
oracle("model_bi_split", f"""SELECT CASE WHEN target_month < 202402 THEN 'train' ELSE 'score' END AS part, count(*) AS rows,
  CAST((SELECT count(*) FROM (UNPIVOT (SELECT CAST(COLUMNS(* EXCLUDE ({', '.join(TEXT)}, is_churn, transaction_date, expire_date)) AS DOUBLE)
    FROM (SELECT * FROM s_features LIMIT 1)) ON COLUMNS(*))) AS INTEGER) AS model_columns,
  CAST({len(TEXT) - 1} AS INTEGER) AS bi_columns, round(sum(age + rfm_total_score + days_to_expire), 4) AS checksum FROM s_features GROUP BY 1""")
