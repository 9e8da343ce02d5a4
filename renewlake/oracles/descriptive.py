"""Twins of the descriptive, pulse and view queries."""

from renewlake.oracles.base import cte, label, mdate, oracle, prev_month

SEG = ("active_segment", "loyalty_segment", "price_segment")
P_CHURN = "(CASE WHEN churn_rate < 0 THEN 0.0 WHEN churn_rate > 1 THEN churn_rate / 100 ELSE churn_rate END)"

cte("s_tab1", f"""SELECT * REPLACE (least(greatest(skip_ratio, 0), 1) AS skip_ratio, least(greatest(discovery_ratio, 0), 1) AS discovery_ratio),
  {label('target_month')} AS month_label, CAST(greatest(membership_age_days, 1) AS INTEGER) AS survival_days_proxy,
  CASE WHEN historical_transaction_rows <= 0 THEN 'unknown' WHEN historical_transaction_rows <= 2 THEN 'low' WHEN historical_transaction_rows <= 6 THEN 'medium' ELSE 'high' END AS txn_freq_bucket,
  CASE WHEN skip_ratio < 0.2 THEN 'low_skip' WHEN skip_ratio < 0.5 THEN 'mid_skip' ELSE 'high_skip' END AS skip_ratio_bucket FROM s_features""")


def unpivot(source: str, kept: str) -> str:
    return " UNION ALL ".join(f"SELECT {kept}, '{c}' AS segment_type, {c} AS segment_value FROM {source}" for c in SEG)


oracle("segment_name_split", """SELECT name, users, coalesce(nullif(trim(p[1]), ''), 'Unknown') AS loyalty_segment, coalesce(nullif(trim(p[2]), ''), 'Unknown') AS renewal_segment,
  coalesce(nullif(trim(p[3]), ''), 'Unknown') AS price_segment, coalesce(nullif(trim(p[4]), ''), 'Unknown') AS discovery_segment FROM (
  SELECT *, string_split(name, '|') AS p FROM (SELECT CASE WHEN users % 2 = 0 THEN array_to_string(string_split(bi_segment_name, '|')[1:2], '|') ELSE bi_segment_name END AS name, users
  FROM (SELECT bi_segment_name, count(*) AS users FROM s_features GROUP BY ALL)))""")
cte("s_kpis", """SELECT target_month, month_label, count(*) AS total_expiring_users, avg(is_churn) AS historical_churn_rate,
  quantile_cont(survival_days_proxy, 0.5) AS median_survival_days_proxy, avg(is_auto_renew) AS auto_renew_rate,
  sum(expected_renewal_amount) AS total_expected_renewal_amount FROM s_tab1 GROUP BY ALL""")
oracle("rate_to_pct", """SELECT target_month, round(historical_churn_rate * 100, 4) AS from_share, round(historical_churn_rate * 100 + 1, 4) AS from_pct,
  round(CASE WHEN target_month > 202306 THEN auto_renew_rate * 100 ELSE 0.0 END, 4) AS with_gaps FROM s_kpis""")
oracle("normalized_churn_prob", """SELECT target_month, round(churn_rate, 4) AS churn_rate, round(CASE WHEN r < 0 THEN 0.0 WHEN r > 1 THEN r / 100 ELSE r END, 4) AS probability, users
  FROM (SELECT target_month, churn_rate, CASE WHEN target_month % 2 = 0 THEN churn_rate * 100 ELSE churn_rate END AS r, count(*) AS users FROM s_features GROUP BY ALL)""")
oracle("tab1_features", """SELECT msno, target_month, month_label, is_churn, is_auto_renew, survival_days_proxy, txn_freq_bucket, skip_ratio_bucket, round(skip_ratio, 6) AS skip_ratio,
  round(discovery_ratio, 6) AS discovery_ratio, round(expected_renewal_amount, 6) AS expected_renewal_amount, age_segment, gender_profile FROM s_tab1""")
oracle("tab1_monthly_kpis", """SELECT target_month, month_label, total_expiring_users, round(historical_churn_rate, 4) AS historical_churn_rate, median_survival_days_proxy,
  round(auto_renew_rate, 4) AS auto_renew_rate, round(total_expected_renewal_amount, 4) AS total_expected_renewal_amount FROM s_kpis""")
cte("s_km1_days", """SELECT target_month, month_label, dimension, dimension_value, survival_days_proxy AS day, CAST(sum(is_churn) AS BIGINT) AS events, count(*) AS n FROM (
  UNPIVOT (SELECT target_month, month_label, survival_days_proxy, is_churn, age_segment, gender_profile, txn_freq_bucket, skip_ratio_bucket FROM s_tab1)
  ON age_segment, gender_profile, txn_freq_bucket, skip_ratio_bucket INTO NAME dimension VALUE dimension_value) GROUP BY ALL""")
_K = "target_month, month_label, dimension, dimension_value"
cte("s_km1", f"""SELECT {_K}, CAST(day AS INTEGER) AS day, ROUND(product(1 - events / at_risk) OVER (PARTITION BY {_K} ORDER BY day) + 1e-10, 6) AS survival_prob, at_risk, events
  FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY {_K} ORDER BY day DESC) AS BIGINT) AS at_risk FROM s_km1_days)
  UNION ALL SELECT {_K}, 0, 1.0, CAST(sum(n) AS BIGINT), 0 FROM s_km1_days GROUP BY ALL""")
oracle("tab1_km_artifact", f"SELECT {_K}, day, round(survival_prob, 6) AS survival_prob, at_risk, events FROM s_km1")
oracle("tab1_segment_mix_artifact", f"""SELECT target_month, segment_type, segment_value, users, round(users / total, 6) AS user_share, {label('target_month')} AS month_label
  FROM (SELECT target_month, segment_type, segment_value, count(*) AS users FROM ({unpivot('s_tab1', 'target_month')}) GROUP BY ALL)
  JOIN (SELECT target_month, count(*) AS total FROM s_tab1 GROUP BY ALL) USING (target_month)""")


def rbin(c: str) -> str:
    return (f"CASE WHEN {c} BETWEEN 0 AND 0.2 THEN '0.0-0.2' WHEN {c} <= 0.4 THEN '0.2-0.4' WHEN {c} <= 0.6 THEN '0.4-0.6' "
            f"WHEN {c} <= 0.8 THEN '0.6-0.8' WHEN {c} <= 1.0 THEN '0.8-1.0' ELSE 'Unknown' END")


def lbin(c: str) -> str:
    return f"CASE WHEN {c} < 0.2 THEN '0-20%' WHEN {c} < 0.4 THEN '20-40%' WHEN {c} < 0.6 THEN '40-60%' WHEN {c} < 0.8 THEN '60-80%' ELSE '80-100%' END"


oracle("tab1_boredom_artifact", f"""SELECT target_month, {rbin('discovery_ratio')} AS discovery_bin, {rbin('skip_ratio')} AS skip_bin, count(*) AS users,
  round(avg(is_churn), 4) AS avg_churn_rate, round(avg(expected_renewal_amount), 4) AS avg_expected_renewal_amount, {label('target_month')} AS month_label FROM s_tab1 GROUP BY 1, 2, 3""")
oracle("tab1_latest_snapshot", """SELECT msno, target_month, month_label, survival_days_proxy, round(expected_renewal_amount, 4) AS expected_renewal_amount FROM s_tab1
  WHERE target_month = (SELECT max(target_month) FROM s_tab1)""")
cte("s_trend0", f"""SELECT target_month, {label('target_month')} AS month_label, {mdate('target_month')} AS analysis_month, count(*) AS subscribers, sum(expected_renewal_amount) AS revenue,
  sum(expected_renewal_amount) / count(*) AS apru, avg(is_churn) * 100 AS churn_rate, count(*) FILTER (loyalty_segment = 'New < 30d') AS new_paid_users,
  CAST(sum(is_churn) AS BIGINT) AS churned_users, -CAST(sum(is_churn) AS BIGINT) AS churned_users_diverging,
  count(*) FILTER (loyalty_segment = 'New < 30d') - CAST(sum(is_churn) AS BIGINT) AS net_movement, avg(is_auto_renew) * 100 AS auto_renew_rate,
  quantile_cont(CAST(greatest(membership_age_days, 1) AS DOUBLE), 0.5) AS overall_median_survival FROM s_features WHERE target_month < 202402 GROUP BY target_month""")
oracle("trend_monthly", """SELECT * REPLACE (round(revenue, 4) AS revenue, round(apru, 4) AS apru, round(churn_rate, 4) AS churn_rate, round(auto_renew_rate, 4) AS auto_renew_rate) FROM s_trend0""")
oracle("risk_source_merge", """SELECT target_month, price_segment, count(*) AS users, CAST(sum(free_trial_flag) AS BIGINT) AS trials, CAST(sum(deal_hunter_flag) AS BIGINT) AS deals,
  round(sum(churn_rate), 4) AS rates FROM s_features GROUP BY ALL""")
cte("s_heat", """SELECT m.target_month, v.value_tier, r.risk_segment, v.value_tier_order, r.risk_segment_order, coalesce(c.n, 0) AS users
  FROM (SELECT DISTINCT target_month FROM s_features) m, (VALUES ('Free Trial', 1), ('Deal Hunter', 2), ('Standard', 3)) v(value_tier, value_tier_order),
    (VALUES ('At Risk', 1), ('Watchlist', 2), ('Stable', 3)) r(risk_segment, risk_segment_order)
  LEFT JOIN (SELECT target_month, CASE WHEN free_trial_flag = 1 OR price_segment ILIKE '%free trial%' THEN 'Free Trial' WHEN deal_hunter_flag = 1 OR price_segment ILIKE '%deal hunter%' THEN 'Deal Hunter' ELSE 'Standard' END AS value_tier,
    CASE WHEN churn_rate >= 0.25 THEN 'At Risk' WHEN churn_rate > 0 THEN 'Watchlist' ELSE 'Stable' END AS risk_segment, count(*) AS n FROM s_features GROUP BY ALL) c
  ON c.target_month = m.target_month AND c.value_tier = v.value_tier AND c.risk_segment = r.risk_segment""")
oracle("risk_heatmap_all", f"""SELECT target_month, {label('target_month')} AS month_label, {mdate('target_month')} AS analysis_month, value_tier, risk_segment AS risk_customer_segment,
  users AS subscribers, value_tier_order, risk_segment_order FROM s_heat""")
oracle("risk_heatmap", "SELECT target_month, value_tier, risk_segment, users FROM s_heat")
oracle("risk_heatmap_normalised", "SELECT target_month, value_tier, risk_segment, users FROM s_heat")

KPI = f"""count(*) AS total_expiring_users, avg({P_CHURN}) * 100 AS historical_churn_rate, quantile_cont(survival_days_proxy, 0.5) AS overall_median_survival,
  avg(is_auto_renew) * 100 AS auto_renew_rate, sum(expected_renewal_amount) AS total_expected_renewal_amount, sum(expected_renewal_amount * {P_CHURN}) AS historical_revenue_at_risk"""
KPI_OUT = """total_expiring_users, round(historical_churn_rate, 4) AS historical_churn_rate, overall_median_survival, round(auto_renew_rate, 4) AS auto_renew_rate,
  round(total_expected_renewal_amount, 4) AS total_expected_renewal_amount, round(historical_revenue_at_risk, 4) AS historical_revenue_at_risk"""
cte("s_fkpis", f"SELECT target_month, {KPI} FROM s_tab1 GROUP BY target_month")
oracle("tab1_frame_kpis", f"SELECT target_month, {KPI_OUT} FROM s_fkpis")
oracle("payload_cube", f"""SELECT target_month, segment_type, segment_value, {KPI_OUT} FROM (SELECT target_month, segment_type, segment_value, {KPI} FROM (
  SELECT *, 'all' AS segment_type, 'all' AS segment_value FROM s_tab1 UNION ALL {unpivot('s_tab1', '*')}) GROUP BY 1, 2, 3)""")
cte("s_cells", f"""SELECT target_month, {lbin('discovery_ratio')} AS discovery_bin, {lbin('skip_ratio')} AS skip_bin, count(*) AS users, avg(expected_renewal_amount) AS amount,
  avg({P_CHURN}) * 100 AS churn_rate_pct, sum(expected_renewal_amount * {P_CHURN}) AS revenue_at_risk FROM s_tab1 GROUP BY 1, 2, 3""")
cte("s_clusters", """SELECT *, 'Kham pha ' || discovery_bin || ' • Bo qua ' || skip_bin AS cluster_label FROM s_cells
  QUALIFY row_number() OVER (PARTITION BY target_month ORDER BY revenue_at_risk DESC, users DESC, churn_rate_pct DESC, discovery_bin, skip_bin)
    <= greatest(5, ceil(count(*) OVER (PARTITION BY target_month) * 0.2))""")
_MID = "CASE {} WHEN '0-20%' THEN 0.1 WHEN '20-40%' THEN 0.3 WHEN '40-60%' THEN 0.5 WHEN '60-80%' THEN 0.7 ELSE 0.9 END"
oracle("behavior_clusters", f"""SELECT target_month, discovery_bin, skip_bin, users, round(amount, 4) AS avg_expected_renewal_amount, round(churn_rate_pct, 4) AS churn_rate_pct,
  round(revenue_at_risk, 4) AS revenue_at_risk, CAST({_MID.format('discovery_bin')} AS DOUBLE) AS discovery_ratio, CAST({_MID.format('skip_bin')} AS DOUBLE) AS skip_ratio, cluster_label FROM s_clusters""")
cte("s_trend", """SELECT t.target_month, t.month_label, subscribers AS total_expiring_users, churn_rate AS historical_churn_rate, k.median_survival_days_proxy AS overall_median_survival,
  t.auto_renew_rate, revenue AS total_expected_renewal_amount, revenue * churn_rate / 100 AS historical_revenue_at_risk, apru, new_paid_users, churned_users, net_movement
  FROM s_trend0 t JOIN s_kpis k USING (target_month)""")
TREND_OUT = """target_month, month_label, total_expiring_users, round(historical_churn_rate, 4) AS historical_churn_rate, overall_median_survival, round(auto_renew_rate, 4) AS auto_renew_rate,
  round(total_expected_renewal_amount, 4) AS total_expected_renewal_amount, round(historical_revenue_at_risk, 4) AS historical_revenue_at_risk, round(apru, 4) AS apru,
  new_paid_users, churned_users, net_movement"""
oracle("trend_from_features", f"SELECT {TREND_OUT} FROM s_trend")
oracle("trend_normalise", f"""SELECT {TREND_OUT} FROM (SELECT target_month, month_label, subscribers AS total_expiring_users, churn_rate AS historical_churn_rate, overall_median_survival, auto_renew_rate,
  revenue AS total_expected_renewal_amount, revenue * churn_rate / 100 AS historical_revenue_at_risk, revenue / subscribers AS apru, new_paid_users,
  CAST(round_even(subscribers * churn_rate / 100, 0) AS BIGINT) AS churned_users, new_paid_users - CAST(round_even(subscribers * churn_rate / 100, 0) AS BIGINT) AS net_movement FROM s_trend0)""")
oracle("trend_from_kpis", f"""SELECT {TREND_OUT} FROM (SELECT *, total_expected_renewal_amount * historical_churn_rate / 100 AS historical_revenue_at_risk, total_expected_renewal_amount / total_expiring_users AS apru,
  CAST(NULL AS BIGINT) AS new_paid_users, CAST(round_even(total_expiring_users * historical_churn_rate / 100, 0) AS BIGINT) AS churned_users, CAST(NULL AS BIGINT) AS net_movement
  FROM (SELECT target_month, month_label, total_expiring_users, CASE WHEN target_month = 202401 THEN (SELECT avg(churn_rate) * 100 FROM s_features WHERE target_month = 202401 AND churn_rate >= 0)
    ELSE historical_churn_rate * 100 END AS historical_churn_rate, median_survival_days_proxy AS overall_median_survival, auto_renew_rate * 100 AS auto_renew_rate, total_expected_renewal_amount
    FROM s_kpis WHERE target_month <> 202402))""")
cte("s_daily_rows", """SELECT make_date(2024, 2, expire_day) AS event_date, CASE WHEN expected_renewal_amount > 0 THEN expected_renewal_amount ELSE greatest(actual_amount_paid, 0) END AS proxy,
  greatest(total_secs_sum, 0) AS secs, least(greatest(0.45 * least(greatest(skip_ratio, 0), 1) + 0.25 * (1 - least(greatest(discovery_ratio, 0), 1)) + 0.15 * is_manual_renew + 0.10 * high_skip_flag
    + 0.03 * low_discovery_flag + 0.02 * content_fatigue_flag, 0), 1) AS risk, active_segment IN ('Light 1-5 logs', 'Active 6-15 logs', 'Heavy > 15 logs') AS listens
  FROM s_features WHERE target_month = 202402""")
cte("s_daily", """SELECT d.event_date, coalesce(total_revenue, 0.0) AS total_revenue, coalesce(total_transactions, 0) AS total_transactions, coalesce(high_risk_users, 0) AS high_risk_users,
  coalesce(avg_risk_score, 0.0) AS avg_risk_score, coalesce(active_users, 0) AS active_users, coalesce(total_listening_secs, 0.0) AS total_listening_secs
  FROM (SELECT CAST(unnest(generate_series(DATE '2024-02-01', DATE '2024-02-29', INTERVAL 1 DAY)) AS DATE) AS event_date) d LEFT JOIN (
  SELECT event_date, sum(proxy) AS total_revenue, count(*) AS total_transactions, count(*) FILTER (risk >= (SELECT least(greatest(quantile_cont(risk, 0.75), 0.4), 0.7) FROM s_daily_rows)) AS high_risk_users,
    avg(risk) * 100 AS avg_risk_score, count(*) FILTER (secs > 0 OR listens) AS active_users, sum(secs) AS total_listening_secs FROM s_daily_rows GROUP BY ALL) USING (event_date)""")
DAILY_OUT = """event_date, round(total_revenue, 4) AS total_revenue, total_transactions, high_risk_users, round(avg_risk_score, 4) AS avg_risk_score, active_users,
  round(total_listening_secs, 4) AS total_listening_secs"""
oracle("daily_snapshot_series", f"SELECT {DAILY_OUT} FROM s_daily")
_BREAK = """total_expiring_users - CAST(round_even(total_expiring_users * historical_churn_rate / 100, 0) AS BIGINT) AS renewed_users,
  CAST(round_even(total_expiring_users * historical_churn_rate / 100, 0) AS BIGINT) AS churned_users, round(100 - historical_churn_rate, 4) AS renewed_rate, round(historical_churn_rate, 4) AS churned_rate"""
oracle("churn_breakdown", f"SELECT target_month, {_BREAK} FROM s_fkpis")
oracle("chart_context_month", f"""SELECT target_month, value_tier, risk_segment, users, {_BREAK}, CAST(202402 AS INTEGER) AS requested_month FROM s_heat JOIN s_trend USING (target_month)
  WHERE target_month = (SELECT max(target_month) FROM s_trend WHERE target_month <= 202402)""")
oracle("segment_mix_payload", f"""SELECT target_month, segment_type, segment_value, count(*) AS users, round(coalesce(avg(churn_rate) FILTER (churn_rate >= 0) * 100, 0.0), 4) AS churn_rate_pct,
  round(100 - coalesce(avg(churn_rate) FILTER (churn_rate >= 0) * 100, 0.0), 4) AS retain_rate_pct FROM ({unpivot('s_features', 'target_month, churn_rate')}) GROUP BY 1, 2, 3""")
oracle("previous_month_kpis", f"""SELECT k.target_month, x.target_month AS previous_month, {KPI_OUT}, 'all months' AS given FROM (SELECT target_month FROM s_fkpis) k
  LEFT JOIN s_fkpis x ON x.target_month = {prev_month('k.target_month')}
  UNION ALL SELECT k.target_month, x.previous_month, {KPI_OUT}, 'one missing' AS given FROM (SELECT target_month FROM s_fkpis WHERE target_month <> 202309) k LEFT JOIN (
  SELECT target_month AS previous_month, total_expiring_users, historical_churn_rate, overall_median_survival, auto_renew_rate, total_expected_renewal_amount, historical_revenue_at_risk
    FROM s_fkpis WHERE target_month <> 202309
  UNION ALL SELECT target_month, total_expiring_users, historical_churn_rate, overall_median_survival, auto_renew_rate, total_expected_renewal_amount, historical_revenue_at_risk
    FROM s_trend WHERE target_month = 202309) x ON x.previous_month = {prev_month('k.target_month')}""")
oracle("km_lookup", """SELECT dimension_value, CAST(count(*) AS INTEGER) AS n, string_agg(day || ':' || at_risk || ':' || events, ',' ORDER BY day, survival_prob, at_risk, events) AS points
  FROM s_km1 WHERE target_month = 202402 AND dimension = 'age_segment' GROUP BY dimension_value""")
oracle("snapshot_metrics", """SELECT target_month, total_expiring_users, round(CASE WHEN target_month = 202309 THEN (SELECT avg(churn_rate) * 100 FROM s_features f WHERE f.target_month = 202309 AND churn_rate >= 0)
  ELSE historical_churn_rate * 100 END, 4) AS historical_churn_rate, median_survival_days_proxy AS median_survival_days, round(auto_renew_rate * 100, 4) AS auto_renew_rate, 'one missing' AS given FROM s_kpis
  UNION ALL SELECT target_month, total_expiring_users, round(historical_churn_rate * 100, 4), median_survival_days_proxy, round(auto_renew_rate * 100, 4), 'all months' FROM s_kpis""")
oracle("available_months", f"""SELECT {label('target_month')} AS month, 'all' AS mode FROM (SELECT DISTINCT target_month FROM s_features WHERE target_month >= 202401)
  UNION ALL SELECT month, 'any' FROM (SELECT {label('target_month')} AS month FROM s_features UNION SELECT strftime(snapshot_month, '%Y-%m') FROM s_snap)""")
oracle("filter_enumeration", f"""SELECT DISTINCT segment_type, segment_value FROM ({unpivot('s_features', '1 AS x')}) UNION ALL SELECT NULL, NULL""")

# pulse -------------------------------------------------------------------------------------
cte("s_pc", """SELECT msno, base_risk, least(base_risk + 0.18, 1.0) AS no_log_risk FROM (SELECT msno, least(greatest(0.25 * least(greatest(skip_ratio, 0), 1) + 0.15 * (1 - least(greatest(discovery_ratio, 0), 1))
  + 0.15 * is_manual_renew + 0.10 * high_skip_flag + 0.05 * low_discovery_flag + 0.05 * content_fatigue_flag, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS base_risk FROM s_features WHERE target_month = 202402)""")
oracle("pulse_cohort", "SELECT msno, round(base_risk, 6) AS base_risk, round(no_log_risk, 6) AS no_log_risk FROM s_pc")
cte("s_ptx", """SELECT transaction_date AS event_date, sum(actual_amount_paid) AS total_revenue, count(*) AS total_transactions FROM d_tx SEMI JOIN s_pc USING (msno)
  WHERE transaction_date >= DATE '2024-01-01' AND transaction_date < DATE '2024-02-01' GROUP BY ALL""")
oracle("pulse_tx_daily", "SELECT event_date, round(total_revenue, 4) AS total_revenue, total_transactions FROM s_ptx")
cte("s_pld", """SELECT *, base_risk + 0.15 * low_activity_flag + 0.07 * least(day_skip_ratio, 1) + 0.03 * (1 - least(day_discovery_ratio, 1)) AS risk_raw FROM (
  SELECT *, CASE WHEN play_num > 0 THEN skip_num / play_num ELSE 0.0 END AS day_skip_ratio, CASE WHEN play_num > 0 THEN disc_num / play_num ELSE 0.0 END AS day_discovery_ratio,
    CAST(total_secs < 1800 AS INTEGER) AS low_activity_flag FROM (SELECT msno, date AS event_date, sum(total_secs) AS total_secs, CAST(sum(num_25 + num_50) AS BIGINT) AS skip_num,
    CAST(sum(num_25 + num_50 + num_75 + num_985 + num_100) AS BIGINT) AS play_num, CAST(sum(num_unq) AS BIGINT) AS disc_num FROM d_logs
    WHERE date >= DATE '2024-01-01' AND date < DATE '2024-02-01' GROUP BY ALL) JOIN s_pc USING (msno))""")
cte("s_pl", "SELECT * EXCLUDE (risk_raw), least(greatest(risk_raw, 0.0), 1.0) AS risk_score FROM s_pld")
oracle("pulse_log_user_day", """SELECT * REPLACE (round(total_secs, 4) AS total_secs, round(base_risk, 4) AS base_risk, round(no_log_risk, 4) AS no_log_risk, round(day_skip_ratio, 4) AS day_skip_ratio,
  round(day_discovery_ratio, 4) AS day_discovery_ratio, round(risk_score, 4) AS risk_score) FROM s_pl""")
cte("s_pr", """SELECT event_date, count(*) AS active_users, sum(total_secs) AS total_listening_secs,
  (SELECT count(*) FROM s_pc WHERE no_log_risk >= 0.6) + count(*) FILTER (risk_score >= 0.6) - count(*) FILTER (no_log_risk >= 0.6) AS high_risk_users,
  ((SELECT sum(no_log_risk) FROM s_pc) + sum(risk_score) - sum(no_log_risk)) / (SELECT count(*) FROM s_pc) * 100 AS avg_risk_score FROM s_pl GROUP BY event_date""")
oracle("pulse_risk_daily", """SELECT event_date, active_users, round(total_listening_secs, 4) AS total_listening_secs, high_risk_users, round(avg_risk_score, 4) AS avg_risk_score FROM s_pr""")
cte("s_pulse", """SELECT event_date, coalesce(total_revenue, 0.0) AS total_revenue, coalesce(total_transactions, 0) AS total_transactions, coalesce(high_risk_users, 0) AS high_risk_users,
  coalesce(avg_risk_score, 0.0) AS avg_risk_score, coalesce(active_users, 0) AS active_users, coalesce(total_listening_secs, 0.0) AS total_listening_secs
  FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS event_date) LEFT JOIN s_ptx USING (event_date) LEFT JOIN s_pr USING (event_date)""")
oracle("pulse_daily", f"""SELECT {DAILY_OUT}, CAST(202402 AS INTEGER) AS target_month, '2024-02' AS target_month_label, CAST(202401 AS INTEGER) AS context_month, '2024-01' AS context_month_label,
  (SELECT count(*) FROM s_pc) AS cohort_size, 'pre_expiry_context' AS series_mode FROM s_pulse""")
oracle("pulse_overlay", f"SELECT {DAILY_OUT} FROM s_pulse")

# views ---------------------------------------------------------------------------------------
oracle("pulse_merge", """SELECT event_date, round(coalesce(total_revenue, 0.0), 4) AS total_revenue, coalesce(total_transactions, 0) AS total_transactions, coalesce(high_risk_users, 0) AS high_risk_users,
  round(coalesce(avg_risk_score, 0.0), 4) AS avg_risk_score, coalesce(active_users, 0) AS active_users, round(coalesce(total_listening_secs, 0.0), 4) AS total_listening_secs
  FROM s_kpi_rev FULL OUTER JOIN s_kpi_risk USING (event_date) FULL OUTER JOIN s_kpi_act USING (event_date)""")
oracle("km_pivot", "SELECT target_month, dimension, day, " + ", ".join(
    f"""round(min(survival_prob * 100) FILTER (lower(dimension_value) = '{v.lower()}'), 4) AS "{v}\""""
    for v in ("Unknown", "15-20", "21-25", "26-35", "36-50", "51-65", "Male", "Female", "low", "medium", "high",
              "low_skip", "mid_skip", "high_skip")) + " FROM s_km1 GROUP BY 1, 2, 3")
oracle("decay_pivot", """SELECT snapshot_month, CAST(m AS INTEGER) AS month_num, 'T+' || m AS timeline, """ + ", ".join(
    f"""round(pow(least(greatest(1 - (avg(churn_probability) FILTER (price_segment = '{k}')) * 0.85, 0.05), 0.99), m) * 100, 4) AS "{n}\""""
    for k, n in (("standard_4.5_8", "Standard"), ("deal_<4.5", "Deal Hunter"), ("premium_>=8", "Premium"))) + " FROM s_scored, range(1, 13) t(m) GROUP BY snapshot_month, m")
oracle("series_delta", """SELECT event_date, round(total_revenue, 4) AS total_revenue, total_transactions, round(total_revenue - coalesce(lag(total_revenue) OVER (ORDER BY event_date), 0.0), 4) AS total_revenue_delta,
  total_transactions - coalesce(lag(total_transactions) OVER (ORDER BY event_date), 0) AS total_transactions_delta FROM s_kpi_rev""")
cte("s_mix", f"""SELECT target_month, segment_type || ': ' || segment_value AS l, count(*) AS users, coalesce(avg(churn_rate) FILTER (churn_rate >= 0) * 100, 0.0) AS rate
  FROM ({unpivot('s_features', 'target_month, churn_rate')}) GROUP BY 1, 2""")
oracle("descriptive_highlights", """SELECT target_month, first(l ORDER BY rate DESC, l DESC) AS hottest_segment, round(max(rate), 4) AS hottest_churn_rate_pct,
  first(l ORDER BY users DESC, l DESC) AS biggest_segment, max(users) AS biggest_users FROM s_mix GROUP BY target_month""")
oracle("behavior_focus", """SELECT target_month, CAST(row_number() OVER w AS INTEGER) AS position, cluster_label, users, round(revenue_at_risk, 4) AS revenue_at_risk, round(churn_rate_pct, 4) AS churn_rate_pct FROM s_clusters
  WINDOW w AS (PARTITION BY target_month ORDER BY s_clusters.revenue_at_risk DESC, users DESC, cluster_label) QUALIFY row_number() OVER w <= 5""")
oracle("renewed_users", "SELECT target_month, total_expiring_users, churned_users, total_expiring_users - churned_users AS renewed_users FROM s_trend")
