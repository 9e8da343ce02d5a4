"""Twins of the snapshot, KPI, dashboard and rule-score queries."""

from renewlake.oracles.base import cte, mstart, oracle

M = mstart("membership_expire_date")

cte("s_tx_ranked", f"""SELECT *, {M} AS snapshot_month,
  row_number() OVER (PARTITION BY msno, {M} ORDER BY transaction_date DESC, membership_expire_date DESC, rid DESC) AS rn FROM d_tx""")
cte("s_tx_last", """SELECT msno, snapshot_month, max(CASE WHEN rn = 1 THEN membership_expire_date END) AS last_expire_date,
  max(CASE WHEN rn = 1 THEN is_cancel END) AS churned, max(CASE WHEN rn = 1 THEN is_auto_renew END) AS is_auto_renew,
  count(*) AS tx_count, avg(plan_list_price / greatest(payment_plan_days, 1)) AS avg_price_per_day,
  min(transaction_date) AS first_tx_date, max(transaction_date) AS last_tx_date FROM s_tx_ranked GROUP BY ALL""")
cte("s_log_last", f"""SELECT msno, {mstart('date')} AS snapshot_month, CAST(sum(num_25 + num_50) AS BIGINT) AS skip_num,
  CAST(sum(num_25 + num_50 + num_75 + num_985 + num_100) AS BIGINT) AS play_num, CAST(sum(num_unq) AS BIGINT) AS disc_num,
  sum(total_secs) AS total_secs, count(*) AS active_days FROM d_logs GROUP BY ALL""")
cte("s_snap_all", """SELECT t.*, m.bd, m.gender,
  CAST(greatest(coalesce(date_diff('day', m.registration_init_time, t.last_expire_date), date_diff('day', t.first_tx_date, t.last_expire_date)), 0) AS INTEGER) AS survival_days,
  CASE WHEN l.play_num > 0 THEN l.skip_num / l.play_num ELSE 0.0 END AS skip_ratio,
  CASE WHEN l.play_num > 0 THEN l.disc_num / l.play_num ELSE 0.0 END AS discovery_ratio,
  CASE WHEN l.active_days > 0 THEN l.total_secs / l.active_days ELSE 0.0 END AS avg_daily_secs
FROM s_tx_last t LEFT JOIN d_members m USING (msno) LEFT JOIN s_log_last l USING (msno, snapshot_month)""")
cte("s_snap_full", """SELECT snapshot_month, msno, last_expire_date, churned, is_auto_renew, survival_days,
  CASE WHEN bd BETWEEN 10 AND 20 THEN '15_20' WHEN bd BETWEEN 21 AND 30 THEN '21_30' WHEN bd BETWEEN 31 AND 40 THEN '31_40'
    WHEN bd BETWEEN 41 AND 100 THEN '41_plus' ELSE 'unknown' END AS age_bucket,
  CASE WHEN gender IN ('male', 'female') THEN gender ELSE 'unknown' END AS gender_bucket,
  CASE WHEN tx_count <= 2 THEN 'low' WHEN tx_count <= 6 THEN 'medium' ELSE 'high' END AS txn_freq_bucket,
  CASE WHEN skip_ratio < 0.2 THEN 'low_skip' WHEN skip_ratio < 0.5 THEN 'mid_skip' ELSE 'high_skip' END AS skip_ratio_bucket,
  CASE WHEN avg_price_per_day < 4.5 THEN 'deal_<4.5' WHEN avg_price_per_day < 8 THEN 'standard_4.5_8' ELSE 'premium_>=8' END AS price_segment,
  CASE WHEN survival_days < 90 THEN 'new_<90d' WHEN survival_days < 365 THEN 'growing_90_365d' ELSE 'loyal_>=365d' END AS loyalty_segment,
  CASE WHEN avg_daily_secs < 900 THEN 'inactive_<15m' WHEN avg_daily_secs < 3600 THEN 'casual_15m_1h' ELSE 'engaged_>=1h' END AS active_segment,
  discovery_ratio, skip_ratio FROM s_snap_all""")
cte("s_snap", f"""SELECT *, 'history_precompute' AS source FROM s_snap_full WHERE snapshot_month >= DATE '2023-01-01' AND snapshot_month < DATE '2023-09-01'
UNION ALL SELECT *, 'realtime_2017_plus' FROM s_snap_full WHERE snapshot_month >= DATE '2023-09-01'
  AND snapshot_month IN (SELECT {mstart('date')} FROM d_logs)""")

oracle("snapshot_months", f"SELECT DISTINCT {mstart('date')} AS snapshot_month FROM d_logs WHERE date >= DATE '2023-01-01'")
oracle("tx_last", """SELECT msno, snapshot_month, last_expire_date, churned, is_auto_renew, tx_count,
  round(avg_price_per_day, 4) AS avg_price_per_day, first_tx_date FROM s_tx_last""")
oracle("tx_features_history", """SELECT msno, snapshot_month, last_expire_date, churned, is_auto_renew, tx_count,
  round(avg_price_per_day, 4) AS avg_price_per_day, first_tx_date, last_tx_date FROM s_tx_last
  WHERE snapshot_month >= DATE '2023-01-01' AND snapshot_month < DATE '2023-09-01'""")
oracle("log_last", """SELECT msno, snapshot_month, skip_num, play_num, disc_num, round(total_secs, 4) AS total_secs, active_days FROM s_log_last""")
oracle("members_dedup", """SELECT msno, CAST(city + 1 AS INTEGER) AS city, bd, gender, registered_via, registration_init_time FROM d_members
  WHERE msno IN (SELECT msno FROM d_tx)""")
oracle("survival_days", """SELECT msno, snapshot_month, CAST(greatest(coalesce(date_diff('day', registration_init_time, last_expire_date),
  date_diff('day', first_tx_date, last_expire_date)), 0) AS INTEGER) AS survival_days
  FROM s_tx_last LEFT JOIN (SELECT msno, CASE WHEN registered_via <> 3 THEN registration_init_time END AS registration_init_time FROM d_members) USING (msno)""")
oracle("behavior_ratios", """SELECT msno, snapshot_month, round(skip_ratio, 6) AS skip_ratio, round(discovery_ratio, 6) AS discovery_ratio,
  round(avg_daily_secs, 4) AS avg_daily_secs FROM s_snap_all""")
oracle("bucket_age", """SELECT bd, CASE WHEN bd BETWEEN 10 AND 20 THEN '15_20' WHEN bd BETWEEN 21 AND 30 THEN '21_30'
  WHEN bd BETWEEN 31 AND 40 THEN '31_40' WHEN bd BETWEEN 41 AND 100 THEN '41_plus' ELSE 'unknown' END AS bucket, count(*) AS users
  FROM d_members GROUP BY ALL""")
oracle("bucket_gender", """SELECT gender, CASE WHEN lower(trim(gender)) IN ('male','female') THEN lower(trim(gender)) ELSE 'unknown' END AS bucket,
  count(*) AS users FROM d_raw_members GROUP BY ALL""")
oracle("bucket_txn_freq", """SELECT tx_count, CASE WHEN tx_count <= 2 THEN 'low' WHEN tx_count <= 6 THEN 'medium' ELSE 'high' END AS bucket,
  count(*) AS users FROM s_tx_last GROUP BY ALL""")
oracle("bucket_skip", """SELECT snapshot_month, CASE WHEN play_num = 0 OR skip_num / play_num < 0.2 THEN 'low_skip'
  WHEN skip_num / play_num < 0.5 THEN 'mid_skip' ELSE 'high_skip' END AS bucket, count(*) AS users FROM s_log_last GROUP BY ALL""")
oracle("bucket_price", """SELECT snapshot_month, CASE WHEN avg_price_per_day < 4.5 THEN 'deal_<4.5' WHEN avg_price_per_day < 8 THEN 'standard_4.5_8'
  ELSE 'premium_>=8' END AS bucket, count(*) AS users, round(min(avg_price_per_day), 4) AS low, round(max(avg_price_per_day), 4) AS high
  FROM s_tx_last GROUP BY 1, 2""")
oracle("bucket_loyalty", """SELECT survival_days, loyalty_segment AS bucket, count(*) AS users FROM s_snap GROUP BY ALL""")
oracle("bucket_activity", """SELECT snapshot_month, CASE WHEN total_secs / active_days < 900 THEN 'inactive_<15m'
  WHEN total_secs / active_days < 3600 THEN 'casual_15m_1h' ELSE 'engaged_>=1h' END AS bucket, count(*) AS users FROM s_log_last GROUP BY ALL""")
_SNAP = """SELECT * REPLACE (round(discovery_ratio, 6) AS discovery_ratio, round(skip_ratio, 6) AS skip_ratio) FROM"""
oracle("member_month_snapshot", f"{_SNAP} (SELECT *, 'realtime_2017_plus' AS source FROM s_snap_full)")
oracle("snapshot_history_vs_realtime", f"{_SNAP} s_snap")

# KPIs -------------------------------------------------------------------------------
cte("s_kpi_rev", """SELECT transaction_date AS event_date, sum(actual_amount_paid) AS total_revenue, count(*) AS total_transactions,
  count(*) FILTER (is_cancel = 1) AS cancel_count, count(*) FILTER (is_auto_renew = 1) AS auto_renew_count FROM d_tx GROUP BY ALL""")
cte("s_kpi_act", """SELECT date AS event_date, count(DISTINCT msno) AS active_users, sum(total_secs) AS total_listening_secs,
  avg(num_unq) AS avg_unique_songs FROM d_logs GROUP BY ALL""")
cte("s_profile", """SELECT msno, CAST(is_cancel AS DOUBLE) AS is_cancel, CAST(is_auto_renew AS DOUBLE) AS is_auto_renew FROM d_tx
  QUALIFY row_number() OVER (PARTITION BY msno ORDER BY transaction_date DESC, membership_expire_date DESC, rid DESC) = 1""")
cte("s_risk", """SELECT *, 0.4 * is_cancel + 0.3 * (1.0 - is_auto_renew) + 0.3 * low_activity_flag AS risk_score FROM (
  SELECT msno, event_date, total_secs, coalesce(is_cancel, 0.0) AS is_cancel, coalesce(is_auto_renew, 1.0) AS is_auto_renew,
    CASE WHEN total_secs < 1800 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS low_activity_flag
  FROM (SELECT msno, date AS event_date, sum(total_secs) AS total_secs FROM d_logs GROUP BY ALL) LEFT JOIN s_profile USING (msno))""")
cte("s_kpi_risk", """SELECT event_date, count(*) FILTER (risk_score >= 0.6) AS high_risk_users, avg(risk_score) AS avg_risk_score
  FROM s_risk GROUP BY ALL""")
_REV = "event_date, round(total_revenue, 4) AS total_revenue, total_transactions, cancel_count, auto_renew_count"
oracle("transaction_kpi", f"SELECT {_REV} FROM s_kpi_rev")
oracle("activity_kpi", """SELECT event_date, active_users, round(total_listening_secs, 4) AS total_listening_secs,
  round(avg_unique_songs, 4) AS avg_unique_songs FROM s_kpi_act""")
oracle("tx_profile", "SELECT * FROM s_profile")
oracle("churn_risk_features", """SELECT * REPLACE (round(total_secs, 4) AS total_secs, round(risk_score, 4) AS risk_score) FROM s_risk""")
oracle("churn_risk_kpi", "SELECT event_date, high_risk_users, round(avg_risk_score, 4) AS avg_risk_score FROM s_kpi_risk")
oracle("latest_version_wins", """SELECT event_date, round(sum(actual_amount_paid) FILTER (keep), 4) AS total_revenue,
  count(*) FILTER (keep) AS total_transactions, count(*) FILTER (keep AND is_cancel = 1) AS cancel_count,
  count(*) FILTER (keep AND is_auto_renew = 1) AS auto_renew_count, CAST(CASE WHEN day(event_date) <= 20 THEN 2 ELSE 1 END AS INTEGER) AS processed_at
  FROM (SELECT *, transaction_date AS event_date, day(transaction_date) <= 20 OR is_cancel = 0 AS keep FROM d_tx)
  GROUP BY event_date HAVING count(*) FILTER (keep) > 0""")

# dashboards ---------------------------------------------------------------------------
UPPER = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {} DESC)"
cte("s_tab1_kpis", f"""SELECT snapshot_month, source, count(*) AS total_expiring_users, avg(churned) * 100 AS historical_churn_rate,
  CAST({UPPER.format('survival_days')} AS DOUBLE) AS overall_median_survival, avg(is_auto_renew) * 100 AS auto_renew_rate
  FROM s_snap GROUP BY ALL""")
oracle("segment_filter", "SELECT snapshot_month, msno, price_segment FROM s_snap WHERE price_segment = 'deal_<4.5'")
oracle("tab1_kpis", """SELECT snapshot_month, total_expiring_users, round(historical_churn_rate, 4) AS historical_churn_rate,
  overall_median_survival, round(auto_renew_rate, 4) AS auto_renew_rate FROM s_tab1_kpis""")
cte("s_km_input", """SELECT snapshot_month, dimension, dimension_value, survival_days AS day, churned, count(*) AS users FROM (
  UNPIVOT (SELECT snapshot_month, survival_days, churned, age_bucket, gender_bucket, txn_freq_bucket, skip_ratio_bucket FROM s_snap)
  ON age_bucket, gender_bucket, txn_freq_bucket, skip_ratio_bucket INTO NAME dimension VALUE dimension_value) GROUP BY ALL""")
oracle("km_input", "SELECT * FROM s_km_input")


def km(source: str, keys: str, day: str, at_risk0: str, events0: str) -> str:
    return f"""SELECT {keys}, CAST({day} AS INTEGER) AS day, round(ROUND(product(1 - events / at_risk) OVER (PARTITION BY {keys} ORDER BY {day}) + 1e-10, 6), 6) AS survival_prob,
  at_risk, events FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY {keys} ORDER BY {day} DESC) AS BIGINT) AS at_risk FROM {source})
UNION ALL SELECT {keys}, 0, 1.0, {at_risk0}, {events0} FROM {source} GROUP BY {keys}"""


cte("s_km_days", """SELECT snapshot_month, dimension, dimension_value, day, CAST(sum(CASE WHEN churned = 1 THEN users ELSE 0 END) AS BIGINT) AS events,
  CAST(sum(users) AS BIGINT) AS n FROM s_km_input GROUP BY ALL""")
oracle("km_curve", km("s_km_days", "snapshot_month, dimension, dimension_value", "day", "NULL", "NULL"))
oracle("segment_mix", """SELECT snapshot_month, segment_type, segment_value, count(*) AS users, round(avg(churned) * 100, 4) AS churn_rate_pct,
  round((1 - avg(churned)) * 100, 4) AS retain_rate_pct FROM (
  SELECT snapshot_month, 'price_segment' AS segment_type, price_segment AS segment_value, churned FROM s_snap
  UNION ALL SELECT snapshot_month, 'loyalty_segment', loyalty_segment, churned FROM s_snap
  UNION ALL SELECT snapshot_month, 'active_segment', active_segment, churned FROM s_snap) GROUP BY ALL""")
oracle("boredom_scatter", """SELECT snapshot_month, discovery_ratio, skip_ratio, users, round(c, 4) AS churn_rate_pct FROM (
  SELECT snapshot_month, round_even(discovery_ratio * 100, 0) / 100 AS discovery_ratio, round_even(skip_ratio * 100, 0) / 100 AS skip_ratio,
    count(*) AS users, avg(churned) * 100 AS c FROM s_snap GROUP BY 1, 2, 3)
  QUALIFY row_number() OVER (PARTITION BY snapshot_month ORDER BY users DESC, discovery_ratio, skip_ratio) <= 800""")
oracle("tab1_month_options", "SELECT DISTINCT strftime(snapshot_month, '%Y-%m') AS month FROM s_snap")
oracle("month_options_kpi", """SELECT DISTINCT strftime(d, '%Y-%m') AS month FROM (SELECT transaction_date AS d FROM d_tx
  UNION ALL SELECT date FROM d_logs)""")
oracle("latest_month", f"SELECT CAST(date_trunc('month', max(membership_expire_date)) AS DATE) AS latest_month FROM d_tx")
cte("s_dash", f"""SELECT s.*, date_diff('day', m.registration_init_time, s.membership_expire_date) AS days
  FROM (SELECT * FROM s_tx_ranked WHERE rn = 1) s LEFT JOIN d_members m USING (msno)""")
cte("s_dash_metrics", f"""SELECT snapshot_month AS month_start, count(*) AS total_expiring_users, avg(is_cancel) * 100 AS historical_churn_rate,
  avg(is_auto_renew) * 100 AS auto_renew_rate, CAST({UPPER.format('days')} AS DOUBLE) AS median_survival_days FROM s_dash GROUP BY ALL""")
oracle("dashboard_metrics", """SELECT month_start, total_expiring_users, round(historical_churn_rate, 4) AS historical_churn_rate,
  round(auto_renew_rate, 4) AS auto_renew_rate FROM s_dash_metrics""")
oracle("dashboard_survival", "SELECT month_start, median_survival_days FROM s_dash_metrics")
oracle("revenue_series", f"SELECT event_date, round(total_revenue, 4) AS total_revenue, total_transactions FROM s_kpi_rev")
oracle("risk_series", f"SELECT event_date, high_risk_users, round(avg_risk_score, 6) AS avg_risk_score FROM s_kpi_risk")
oracle("activity_series", f"""SELECT event_date, active_users, round(total_listening_secs, 4) AS total_listening_secs FROM s_kpi_act""")
oracle("as_of", """SELECT strftime(max(d) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS as_of FROM (
  SELECT max(transaction_date) AS d FROM d_tx UNION ALL SELECT max(date) FROM d_logs)""")
oracle("snapshot_fallback", " UNION ALL ".join(f"""SELECT month_start, CASE WHEN s.n > 0 THEN s.n ELSE f.total_expiring_users END AS total_expiring_users,
  round(CASE WHEN s.n > 0 THEN s.c ELSE f.historical_churn_rate END, 4) AS historical_churn_rate,
  CASE WHEN s.m > 0 THEN s.m ELSE coalesce(f.median_survival_days, 0.0) END AS median_survival_days,
  round(CASE WHEN s.n > 0 THEN s.a ELSE f.auto_renew_rate END, 4) AS auto_renew_rate, '{given}' AS given
  FROM s_dash_metrics f FULL OUTER JOIN (SELECT snapshot_month AS month_start, total_expiring_users AS n, historical_churn_rate AS c,
    overall_median_survival AS m, auto_renew_rate AS a FROM s_tab1_kpis WHERE {part}) s USING (month_start)"""
  for given, part in (("whole", "true"), ("realtime part", "source = 'realtime_2017_plus'"))))
cte("s_cohort", f"""SELECT s.snapshot_month, s.msno, churned, is_auto_renew, price_segment, loyalty_segment, active_segment, discovery_ratio, skip_ratio,
  coalesce(avg_paid, 0.0) AS avg_paid, coalesce(avg_plan_days, 30.0) AS avg_plan_days, coalesce(CAST(txn_count AS DOUBLE), 1.0) AS txn_count,
  coalesce(avg_daily_secs, 0.0) AS avg_daily_secs FROM s_snap s
  LEFT JOIN (SELECT msno, {M} AS snapshot_month, avg(actual_amount_paid) AS avg_paid, avg(greatest(payment_plan_days, 1)) AS avg_plan_days,
    count(*) AS txn_count FROM d_tx GROUP BY ALL) USING (msno, snapshot_month)
  LEFT JOIN (SELECT msno, {mstart('date')} AS snapshot_month, avg(total_secs) AS avg_daily_secs FROM d_logs GROUP BY ALL) USING (msno, snapshot_month)""")
oracle("model_cohort", """SELECT * REPLACE (round(discovery_ratio, 4) AS discovery_ratio, round(skip_ratio, 4) AS skip_ratio, round(avg_paid, 4) AS avg_paid,
  round(avg_plan_days, 4) AS avg_plan_days, round(avg_daily_secs, 4) AS avg_daily_secs) FROM s_cohort""")

# rule-based scores -----------------------------------------------------------------------
cte("s_flags", """SELECT snapshot_month, msno, price_segment, avg_daily_secs, least(skip_ratio, 1.0) AS skip_ratio, least(discovery_ratio, 1.0) AS discovery_ratio,
  avg_paid, txn_count, CAST(1 - is_auto_renew AS DOUBLE) AS manual_flag, CAST(churned AS DOUBLE) AS cancel_signal_flag,
  CAST(avg_daily_secs < 1800 AS DOUBLE) AS low_activity_flag, CAST(skip_ratio > 0.5 AS DOUBLE) AS high_skip_flag,
  CAST(discovery_ratio < 0.15 AS DOUBLE) AS low_discovery_flag, CAST(price_segment = 'deal_<4.5' AS DOUBLE) AS deal_flag,
  avg_paid / avg_plan_days AS daily_price_est FROM s_cohort""")


def prob(manual: str, skip: str) -> str:
    return (f"least(greatest(CAST(0.05 AS DOUBLE) + CAST(0.30 AS DOUBLE) * {manual} + CAST(0.25 AS DOUBLE) * low_activity_flag + CAST(0.15 AS DOUBLE) * {skip} "
            f"+ CAST(0.10 AS DOUBLE) * low_discovery_flag + CAST(0.15 AS DOUBLE) * cancel_signal_flag, 0.01), 0.99)")


def hazard(p: str, skip: str) -> str:
    return f"greatest(CAST(1 AS DOUBLE) + CAST(1.5 AS DOUBLE) * {p} + CAST(0.3 AS DOUBLE) * {skip} + CAST(0.2 AS DOUBLE) * low_activity_flag, 0.1)"


cte("s_prob", f"SELECT *, {prob('manual_flag', 'high_skip_flag')} AS churn_probability FROM s_flags")
cte("s_scored", f"""SELECT *, avg_paid * (6 + (1 - churn_probability) * 6) * (1 + txn_count * CAST(0.03 AS DOUBLE)) AS predicted_future_cltv,
  churn_probability * avg_paid * 6 AS revenue_at_risk, {hazard('churn_probability', 'high_skip_flag')} AS hazard_ratio_proxy,
  CASE WHEN manual_flag = 1 THEN 'Manual Renewal' WHEN low_activity_flag = 1 THEN 'Low Activity' WHEN high_skip_flag = 1 THEN 'High Skip Ratio'
    WHEN cancel_signal_flag = 1 THEN 'Cancel Signal' WHEN low_discovery_flag = 1 THEN 'Low Discovery' ELSE 'Manual Renewal' END AS primary_risk_driver,
  price_segment || ' / ' || CASE WHEN manual_flag = 1 THEN 'Manual Renewal' ELSE 'Auto-Renew' END || ' / ' ||
    CASE WHEN discovery_ratio < 0.15 THEN 'Habit Listener' WHEN discovery_ratio < 0.35 THEN 'Balanced Listener' ELSE 'Explorer Listener' END AS strategic_segment
  FROM s_prob""")
oracle("score_member", """SELECT snapshot_month, msno, price_segment, round(avg_daily_secs, 4) AS avg_daily_secs, round(skip_ratio, 4) AS skip_ratio,
  round(discovery_ratio, 4) AS discovery_ratio, round(avg_paid, 4) AS avg_paid, txn_count, manual_flag, cancel_signal_flag, low_activity_flag,
  high_skip_flag, low_discovery_flag, deal_flag, round(daily_price_est, 4) AS daily_price_est, round(churn_probability, 4) AS churn_probability,
  round(predicted_future_cltv, 4) AS predicted_future_cltv, round(revenue_at_risk, 4) AS revenue_at_risk,
  round(hazard_ratio_proxy, 4) AS hazard_ratio_proxy FROM s_scored""")
oracle("primary_driver_rule", """SELECT snapshot_month, primary_risk_driver, count(*) AS users, sum(manual_flag) AS manual, sum(high_skip_flag) AS skip
  FROM s_scored GROUP BY ALL""")
oracle("strategic_segment", "SELECT snapshot_month, msno, strategic_segment FROM s_scored")
cte("s_driver_mode", """SELECT snapshot_month, strategic_segment, primary_risk_driver FROM
  (SELECT snapshot_month, strategic_segment, primary_risk_driver, count(*) AS n FROM s_scored GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY snapshot_month, strategic_segment ORDER BY n DESC, primary_risk_driver) = 1""")
cte("s_segsum", """SELECT * FROM (SELECT snapshot_month, strategic_segment, count(*) AS user_count, avg(churn_probability) AS avg_churn_prob,
  avg(churn_probability) * 100 AS avg_churn_prob_pct, avg(predicted_future_cltv) AS avg_future_cltv, sum(predicted_future_cltv) AS total_future_cltv,
  sum(revenue_at_risk) AS revenue_at_risk FROM s_scored GROUP BY ALL) JOIN s_driver_mode USING (snapshot_month, strategic_segment)""")
_SEG = """snapshot_month, strategic_segment, user_count, round(avg_churn_prob, 4) AS avg_churn_prob, round(avg_churn_prob_pct, 4) AS avg_churn_prob_pct,
  round(avg_future_cltv, 4) AS avg_future_cltv, round(total_future_cltv, 4) AS total_future_cltv, round(s.revenue_at_risk, 4) AS revenue_at_risk, primary_risk_driver"""
oracle("segment_summary", f"SELECT {_SEG} FROM s_segsum s")
oracle("segment_quadrant", f"""SELECT {_SEG}, CASE WHEN avg_churn_prob_pct >= 50 THEN CASE WHEN s.avg_future_cltv >= mid THEN 'Must Save' ELSE 'Let Go' END
  WHEN s.avg_future_cltv >= mid THEN 'Loyal Core' ELSE 'Stable Low-Tier' END AS quadrant,
  CAST(row_number() OVER (PARTITION BY snapshot_month ORDER BY s.revenue_at_risk DESC, strategic_segment) AS INTEGER) AS risk_order
  FROM s_segsum s JOIN (SELECT snapshot_month, quantile_cont(avg_future_cltv, 0.5) AS mid FROM s_segsum GROUP BY ALL) USING (snapshot_month)""")
cte("s_pkpis", """SELECT snapshot_month, avg(churn_probability) * 100 AS forecasted_churn_rate, sum(revenue_at_risk) AS predicted_revenue_at_risk,
  coalesce(sum(predicted_future_cltv) FILTER (churn_probability <= 0.5), 0.0) AS predicted_total_future_cltv FROM s_scored GROUP BY ALL""")
oracle("predictive_kpis", """SELECT snapshot_month, round(forecasted_churn_rate, 4) AS forecasted_churn_rate, round(predicted_revenue_at_risk, 4) AS predicted_revenue_at_risk,
  round(predicted_total_future_cltv, 4) AS predicted_total_future_cltv, strategic_segment AS top_segment, round(revenue_at_risk, 4) AS top_segment_risk,
  user_count AS top_segment_user_count FROM s_pkpis JOIN s_segsum USING (snapshot_month)
  QUALIFY row_number() OVER (PARTITION BY snapshot_month ORDER BY revenue_at_risk DESC, strategic_segment) = 1""")
oracle("revenue_leakage", """SELECT snapshot_month, primary_risk_driver AS risk_driver, count(*) AS user_count, round(sum(revenue_at_risk), 4) AS revenue_at_risk
  FROM s_scored GROUP BY 1, 2""")
oracle("forecast_decay", """SELECT snapshot_month, segment, CAST(m AS INTEGER) AS month_num, 'T+' || m AS timeline,
  round(pow(least(greatest(1 - p * 0.85, 0.05), 0.99), m) * 100, 4) AS retention_pct
  FROM (SELECT snapshot_month, CASE price_segment WHEN 'deal_<4.5' THEN 'Deal Hunter' WHEN 'premium_>=8' THEN 'Premium' ELSE 'Standard' END AS segment,
    avg(churn_probability) AS p FROM s_scored GROUP BY ALL), range(1, 13) t(m)""")
oracle("predictive_mom_delta", """SELECT k.snapshot_month, round(k.forecasted_churn_rate, 4) AS forecasted_churn_rate,
  round(coalesce(p.forecasted_churn_rate, 0.0), 4) AS previous_forecasted_churn_rate,
  round(k.forecasted_churn_rate - coalesce(p.forecasted_churn_rate, 0.0), 4) AS forecasted_churn_delta_pp_vs_prev_month
  FROM s_pkpis k LEFT JOIN s_pkpis p ON p.snapshot_month + INTERVAL 1 MONTH = k.snapshot_month""")


def shifted(auto: str, upsell: str, skip: str) -> str:
    after = f"CAST(skip_ratio * (1 - {skip}) > 0.5 AS DOUBLE)"
    return f"""SELECT *, {hazard('p2', 'skip2')} AS h2, daily_price_est * 30 AS base, greatest(churn_probability - p2, 0) * daily_price_est * 6 * 30 AS saved,
    {upsell} * deal_flag * daily_price_est * 30 * 0.8 AS gain FROM (SELECT *, {prob(f'(manual_flag * (1 - {auto}))', after)} AS p2, {after} AS skip2 FROM s_scored)"""


cte("s_shift", shifted("CAST(0.2 AS DOUBLE)", "CAST(0.15 AS DOUBLE)", "CAST(0.25 AS DOUBLE)"))
cte("s_project", """SELECT snapshot_month, sum(base) AS baseline_revenue, sum(saved) AS saved_revenue, sum(gain) AS incremental_upsell,
  sum(base) + sum(saved) + sum(gain) AS optimized_revenue, avg(hazard_ratio_proxy) AS baseline_avg_hazard, avg(h2) AS scenario_avg_hazard,
  avg(churn_probability) * 100 AS baseline_churn_prob_pct, avg(p2) * 100 AS scenario_churn_prob_pct FROM s_shift GROUP BY ALL""")
oracle("scenario_project", "SELECT snapshot_month, round(COLUMNS(* EXCLUDE snapshot_month), 4) FROM s_project")
oracle("hazard_histogram", """WITH v AS (SELECT snapshot_month, hazard_ratio_proxy AS v, 1 AS b, 0 AS s FROM s_shift UNION ALL SELECT snapshot_month, h2, 0, 1 FROM s_shift),
  r AS (SELECT snapshot_month, min(v) AS lo, CASE WHEN max(v) - min(v) < 1e-9 THEN min(v) + 1 ELSE max(v) END AS hi FROM v GROUP BY ALL),
  h AS (SELECT snapshot_month, least(CAST(floor((v - lo) / ((hi - lo) / 24)) AS INTEGER), 23) AS bin, sum(b) AS b, sum(s) AS s FROM v JOIN r USING (snapshot_month) GROUP BY ALL),
  t AS (SELECT snapshot_month, sum(b) AS tb, sum(s) AS ts FROM v GROUP BY ALL)
  SELECT snapshot_month, CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * ((hi - lo) / 24), 4) AS bin_start, round(lo + g.bin * ((hi - lo) / 24) + (hi - lo) / 24, 4) AS bin_end,
    round(coalesce(b, 0) / tb, 4) AS baseline_density, round(coalesce(s, 0) / ts, 4) AS scenario_density
  FROM r JOIN t USING (snapshot_month), range(24) g(bin) LEFT JOIN h ON h.snapshot_month = r.snapshot_month AND h.bin = g.bin""".replace("SELECT snapshot_month, CAST(g.bin", "SELECT r.snapshot_month, CAST(g.bin"))
_LEVERS = (("Auto-Renew Conversion", "0.01", "0", "0"), ("Upsell to Standard Plan", "0", "0.01", "0"), ("Reduce Skip Behavior", "0", "0", "0.01"))
oracle("sensitivity_1pct", " UNION ALL ".join(
    f"SELECT snapshot_month, '{n}' AS strategy, round(sum(base) + sum(saved) + sum(gain) - sum(base), 4) AS revenue_impact_per_1pct FROM ({shifted(f'CAST({a} AS DOUBLE)', f'CAST({u} AS DOUBLE)', f'CAST({s} AS DOUBLE)')}) GROUP BY ALL"
    for n, a, u, s in _LEVERS))
oracle("financial_waterfall", " UNION ALL ".join(
    f"SELECT snapshot_month, CAST({i} AS INTEGER) AS step, '{n}' AS name, round({c}, 4) AS value FROM s_project"
    for i, (n, c) in enumerate((("Current Baseline Revenue", "baseline_revenue"), ("Saved Revenue from Retention", "saved_revenue"),
                                ("Incremental Revenue from Upsell", "incremental_upsell"), ("Optimized Projected Revenue", "optimized_revenue")), 1)))
