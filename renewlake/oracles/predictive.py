"""Twins of the predictive, scenario and Monte Carlo queries."""

from renewlake import params as P
from renewlake.oracles.base import cte, oracle
from renewlake.oracles.feature_store import TEXT


def q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def case(c: str, mapping: dict[str, str], default: str | None = None) -> str:
    rest = f" ELSE {q(default)}" if default is not None else ""
    return f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + rest + " END"


def band(c: str) -> str:
    steps = ((0.8, "Very High"), (0.6, "High"), (0.4, "Medium"), (0.2, "Low"))
    return "CASE " + " ".join(f"WHEN CAST({c} AS FLOAT) >= CAST({v} AS FLOAT) THEN '{n}'" for v, n in steps) + " ELSE 'Very Low' END"


def tier(c: str) -> str:
    return f"CASE WHEN {c} IN ('Very High', 'High') THEN 'High' WHEN {c} IN ('Medium', 'Low') THEN 'Medium' WHEN {c} = 'Very Low' THEN 'Low' ELSE 'Unknown' END"


def driver(skip: bool) -> str:
    extra = "WHEN skip_segment = 'High >= 50%' THEN 'High Skip Ratio' " if skip else ""
    return f"""CASE WHEN renewal_segment = 'Pay_Manual' THEN 'Manual Renewal' {extra}WHEN discovery_segment = 'Habit < 20%' THEN 'Low Discovery'
  WHEN price_segment IN ('Deal Hunter < 4.5', 'Free Trial / Zero Pay') THEN 'Price Sensitivity' WHEN loyalty_segment IN ('New < 30d', 'Growing 30-179d') THEN 'Early Lifecycle' ELSE 'Mixed Behavioral Risk' END"""


def scored_of(month: int) -> str:
    return f"""SELECT *, rank_avg / n AS risk_percentile, CAST(least(greatest(ceil(rank_avg / n * 10), 1), 10) AS INTEGER) AS risk_decile, {band('p')} AS risk_band,
  p * expected_renewal_amount AS risk, (1 - p) * expected_renewal_amount AS kept, p AS churn_probability FROM (
  SELECT *, rank() OVER (ORDER BY CAST(p AS FLOAT)) + (count(*) OVER (PARTITION BY CAST(p AS FLOAT)) - 1) / 2 AS rank_avg, count(*) OVER () AS n FROM (
  SELECT *, least(greatest(CAST(0.05 AS DOUBLE) + CAST(0.30 AS DOUBLE) * CAST(is_auto_renew = 0 AS INTEGER) + CAST(0.25 AS DOUBLE) * CAST(secs_per_log < 1800 AS INTEGER) + CAST(0.15 AS DOUBLE) * CAST(skip_ratio > 0.5 AS INTEGER)
    + CAST(0.10 AS DOUBLE) * CAST(discovery_ratio < 0.15 AS INTEGER) + CAST(0.15 AS DOUBLE) * CAST(last_1_is_churn = 1 AS INTEGER), 0.01), 0.99) AS p FROM s_features WHERE target_month = {month}))"""


cte("s_sc", scored_of(202402))
cte("s_vs", scored_of(202401))
oracle("risk_band", f"SELECT round(churn_probability, 4) AS churn_probability, {band('churn_probability')} AS band, count(*) AS users FROM s_sc GROUP BY s_sc.churn_probability")
oracle("exec_risk_tier", f"SELECT risk_band, {tier('risk_band')} AS tier, {case(tier('risk_band'), P.RISK_TIER_LABELS)} AS label, count(*) AS users FROM s_sc GROUP BY ALL")
oracle("driver_from_segments", f"SELECT {driver(True)} AS driver, {driver(False)} AS summary_driver, count(*) AS users FROM s_sc GROUP BY ALL")
oracle("recommended_action", f"SELECT msno, driver, {case('driver', P.RECOMMENDED_ACTIONS)} AS action FROM (SELECT msno, {driver(True)} AS driver FROM s_sc)")
oracle("time_split", " UNION ALL ".join(
    f"SELECT '{n}' AS part, count(*) AS rows, min(target_month) AS first, max(target_month) AS last FROM s_features WHERE target_month {c}"
    for n, c in (("train", "< 202401"), ("valid", "= 202401"), ("full", "<= 202401"), ("score", "= 202402"))))
_NOT = ", ".join([*TEXT, "is_churn", "transaction_date", "expire_date", "target_month", "last_expire_month", "transaction_month", "expire_month"])
cte("s_long", f"""UNPIVOT (SELECT is_churn AS y, CAST(COLUMNS(* EXCLUDE ({_NOT})) AS DOUBLE) FROM s_features WHERE target_month < 202401)
  ON COLUMNS(* EXCLUDE (y)) INTO NAME feature VALUE x""")
oracle("feature_select", "SELECT feature, count(*) AS rows, round(avg(x), 4) AS mean FROM s_long GROUP BY ALL")
oracle("class_weight", """SELECT CAST(sum(is_churn) AS BIGINT) AS positives, CAST(count(*) - sum(is_churn) AS BIGINT) AS negatives,
  round(greatest((count(*) - sum(is_churn)) / greatest(sum(is_churn), 1), 1.0), 4) AS scale_pos_weight FROM s_features WHERE target_month < 202401""")
oracle("eval_metrics", """WITH g AS (SELECT p, count(*) AS n, sum(is_churn) AS pos FROM s_vs GROUP BY p),
  c AS (SELECT *, sum(n) OVER w AS above, sum(pos) OVER w AS hits, sum(n) OVER () AS total, sum(pos) OVER () AS positives FROM g WINDOW w AS (ORDER BY p DESC))
  SELECT (SELECT round(avg(-(is_churn * ln(p) + (1 - is_churn) * ln(1 - p))), 6) FROM s_vs) AS log_loss, round(sum(pos / positives * hits / above), 6) AS pr_auc,
    (SELECT round(avg(is_churn), 6) FROM s_vs) AS positive_rate, (SELECT round(avg(p), 6) FROM s_vs) AS prediction_mean,
    (SELECT round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END), 6) FROM s_vs a, s_vs b WHERE a.is_churn = 1 AND b.is_churn = 0) AS roc_auc FROM c""")
oracle("score_outputs", """SELECT msno, target_month, is_churn, round(expected_renewal_amount, 4) AS expected_renewal_amount, round(p, 4) AS churn_probability_raw, round(p, 4) AS churn_probability, price_segment,
  renewal_segment, loyalty_segment, active_segment, skip_segment, discovery_segment, rfm_segment, bi_segment_name, gender_profile, round(risk_percentile, 4) AS risk_percentile, risk_decile, risk_band,
  round(risk, 4) AS expected_revenue_at_risk_30d, round(kept, 4) AS expected_retained_revenue_30d FROM s_sc""")
cte("s_sum", """SELECT target_month, bi_segment_name, count(*) AS users, avg(p) AS avg_p, sum(risk) AS risk, sum(kept) AS kept, sum(expected_renewal_amount) AS amount,
  max(loyalty_segment) AS loyalty_segment, max(renewal_segment) AS renewal_segment, max(price_segment) AS price_segment, max(discovery_segment) AS discovery_segment FROM s_sc GROUP BY 1, 2""")
oracle("segment_risk_summary", """SELECT target_month, bi_segment_name, users, round(avg_p, 4) AS avg_churn_probability, round(risk, 4) AS total_expected_revenue_at_risk_30d,
  round(kept, 4) AS total_expected_retained_revenue_30d, round(amount, 4) AS total_expected_renewal_amount FROM s_sum""")
cte("s_mode2", f"""SELECT bi_segment_name, d FROM (SELECT bi_segment_name, {driver(True)} AS d, count(*) AS n FROM s_sc GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY bi_segment_name ORDER BY n DESC, d) = 1""")


def matrix(d: str, source: str) -> str:
    return f"""SELECT bi_segment_name AS strategic_segment, users AS user_count, avg_p AS avg_churn_prob, avg_p * 100 AS avg_churn_prob_pct, kept / users AS avg_future_cltv, kept AS total_future_cltv,
  risk AS revenue_at_risk, {d} AS primary_risk_driver, CASE WHEN avg_p * 100 >= (SELECT quantile_cont(avg_p * 100, 0.5) FROM s_sum) THEN
    CASE WHEN kept / users >= (SELECT quantile_cont(kept / users, 0.5) FROM s_sum) THEN 'Must Save' ELSE 'At Risk' END
    WHEN kept / users >= (SELECT quantile_cont(kept / users, 0.5) FROM s_sum) THEN 'Core Value' ELSE 'Monitor' END AS quadrant FROM {source}"""


cte("s_mx", matrix(driver(False), "s_sum"))
cte("s_mx_members", matrix("d", "s_sum JOIN s_mode2 USING (bi_segment_name)"))
MX = f"""strategic_segment, user_count, round(avg_churn_prob, 4) AS avg_churn_prob, round(avg_churn_prob_pct, 4) AS avg_churn_prob_pct, round(avg_future_cltv, 4) AS avg_future_cltv,
  round(total_future_cltv, 4) AS total_future_cltv, round(s.revenue_at_risk, 4) AS revenue_at_risk, primary_risk_driver, {case('primary_risk_driver', P.RECOMMENDED_ACTIONS)} AS recommended_action, quadrant"""
ORDER = "s.revenue_at_risk DESC, avg_churn_prob DESC, strategic_segment"
oracle("value_risk_matrix", f"SELECT {MX}, 'members' AS basis FROM s_mx_members s UNION ALL SELECT {MX}, 'summary' FROM s_mx s")
oracle("prescriptions_top", f"SELECT {MX} FROM s_mx s QUALIFY row_number() OVER (ORDER BY {ORDER}) <= 200")
cte("s_top", "SELECT strategic_segment, revenue_at_risk, user_count FROM s_mx ORDER BY revenue_at_risk DESC, avg_churn_prob DESC, strategic_segment DESC LIMIT 1")
TOP = "(SELECT strategic_segment FROM s_top) AS top_segment, (SELECT round(revenue_at_risk, 4) FROM s_top) AS top_segment_risk, (SELECT user_count FROM s_top) AS top_segment_user_count"
oracle("summary_kpis", f"""SELECT round(sum(avg_churn_prob * user_count) / sum(user_count) * 100, 4) AS forecasted_churn_rate, round(sum(m.revenue_at_risk), 4) AS predicted_revenue_at_risk,
  round(sum(total_future_cltv), 4) AS predicted_total_future_cltv, {TOP} FROM s_mx m""")
oracle("member_kpis", f"""SELECT round(avg(CAST(p >= 0.6 AS INTEGER)) * 100, 4) AS forecasted_churn_rate, count(*) FILTER (p >= 0.6) AS high_flight_risk_users, round(sum(risk), 4) AS predicted_revenue_at_risk,
  round(sum(kept), 4) AS predicted_total_future_cltv, round(sum(kept), 4) AS safe_revenue, {TOP} FROM s_sc""")
cte("s_leak", f"SELECT {driver(True)} AS risk_driver, count(*) AS user_count, sum(risk) AS revenue_at_risk FROM s_sc GROUP BY 1")
oracle("leakage_by_driver", """SELECT risk_driver, user_count, round(l.revenue_at_risk, 4) AS revenue_at_risk, 'members' AS basis FROM s_leak l
  UNION ALL SELECT primary_risk_driver, CAST(sum(user_count) AS BIGINT), round(sum(m.revenue_at_risk), 4), 'summary' FROM s_mx m GROUP BY 1""")
cte("s_bands", f"SELECT {tier('risk_band')} AS band, count(*) AS user_count, sum(risk) AS revenue_at_risk FROM s_sc GROUP BY 1")
oracle("risk_band_mix", """SELECT band, user_count, round(b.revenue_at_risk, 4) AS revenue_at_risk, round(b.revenue_at_risk / (SELECT sum(revenue_at_risk) FROM s_bands) * 100, 4) AS revenue_share_pct,
  CAST(CASE band WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END AS INTEGER) AS sort_order FROM s_bands b""")
_GROUP = "CASE " + " ".join(f"WHEN feature IN ({', '.join(q(n) for n in names)}) THEN '{g}'" for g, names in P.FEATURE_GROUPS.items()) + " ELSE 'other' END"
cte("s_gain", f"""SELECT {_GROUP} AS feature_group, sum(gain) AS gain, CAST(sum(split) AS BIGINT) AS split, count(*) AS n FROM (SELECT feature, abs(avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0)) / (1 + stddev_pop(x)) AS gain,
  count(*) FILTER (x <> 0) AS split FROM s_long GROUP BY feature) GROUP BY 1""")
cte("s_wf", f"""SELECT feature_group, {case('feature_group', P.FEATURE_GROUP_LABELS)} AS display_name, gain, split, n, share * t AS contribution, share * 100 AS pct, CAST(row_number() OVER (ORDER BY o, gain DESC, feature_group) AS INTEGER) AS position
  FROM (SELECT feature_group, gain, split, n, 0.7 * gain / sum(gain) OVER () AS share, 1 AS o FROM s_gain WHERE gain > 0 UNION ALL SELECT 'base_risk', 0.0, 0, 0, 0.3, 0), (SELECT sum(risk) AS t FROM s_sc)""")
oracle("feature_waterfall", """SELECT feature_group, display_name, round(gain, 4) AS importance_gain, split AS importance_split, n AS feature_count, round(contribution, 4) AS contribution,
  round(pct, 4) AS contribution_pct, position FROM s_wf""")
oracle("waterfall_running", """SELECT position, display_name AS name, round(contribution, 4) AS amount, round(pct, 4) AS contribution_pct, n AS feature_count, round(sum(contribution) OVER (ORDER BY position), 4) AS total,
  round(sum(contribution) OVER (ORDER BY position) - contribution, 4) AS start FROM s_wf""")
cte("s_exec", f"""SELECT target_month, '2024-02' AS month_label, round_even(p * 10, 0) / 10 AS prob_bin, expected_renewal_amount, risk_band, {tier('risk_band')} AS risk_tier, count(*) AS user_count, sum(risk) AS r,
  FROM s_sc GROUP BY ALL""")
_EXEC = """SELECT target_month, month_label, round(prob_bin, 4) AS prob_bin, round(expected_renewal_amount, 4) AS expected_renewal_amount, risk_band, risk_tier, user_count, round(r, 4) AS revenue_at_risk,
  round(sqrt(user_count), 4) AS display_size, CASE WHEN prob_bin >= 0.5 THEN CASE WHEN expected_renewal_amount >= 100 THEN 'VIP Rescue' ELSE 'Price Sensitive' END
  WHEN expected_renewal_amount >= 100 THEN 'Core Loyal' ELSE 'Casual' END AS priority_quadrant FROM s_exec"""
oracle("exec_value_risk_matrix", f"{_EXEC} WHERE expected_renewal_amount <= 250 AND user_count >= 10")
oracle("exec_value_risk_matrix_all", _EXEC)
_NODES = [*P.SANKEY_RENEWAL.values(), *P.SANKEY_RFM.values(), *P.SANKEY_PRICE.values(), *(P.RISK_TIER_LABELS[t] for t in ("High", "Medium", "Low"))]
_INDEX = "CASE {} " + " ".join(f"WHEN {q(n)} THEN {i}" for i, n in enumerate(_NODES)) + " END"
cte("s_flow", f"""SELECT {case('renewal_segment', P.SANKEY_RENEWAL)} AS a, {case('rfm_segment', P.SANKEY_RFM)} AS b, {case('price_segment', P.SANKEY_PRICE)} AS c,
  {case(tier('risk_band'), P.RISK_TIER_LABELS)} AS t, risk FROM s_sc""")
oracle("revenue_sankey", f"""SELECT CAST(level AS INTEGER) AS level, s AS source_name, d AS target_name, t AS risk_tier, round(sum(risk), 4) AS value, {_INDEX.format('s')} AS source, {_INDEX.format('d')} AS target FROM (
  SELECT 1 AS level, a AS s, b AS d, t, risk FROM s_flow WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL
  UNION ALL SELECT 2, b, c, t, risk FROM s_flow WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL
  UNION ALL SELECT 3, c, t, t, risk FROM s_flow WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL) GROUP BY level, s, d, t HAVING sum(risk) > 0""")
_PAR = list(P.PARADOX_PRICE.values())
oracle("price_paradox", f"""SELECT price_bucket, count(*) AS user_count, round(sum(risk), 4) AS revenue_at_risk, round(avg(p) * 100, 4) AS churn_rate_pct,
  CAST(CASE price_bucket {' '.join(f'WHEN {q(v)} THEN {i}' for i, v in enumerate(_PAR))} END AS INTEGER) AS sort_order
  FROM (SELECT *, {case('price_segment', P.PARADOX_PRICE)} AS price_bucket FROM s_sc) WHERE price_bucket IS NOT NULL GROUP BY 1""")
cte("s_habit", f"SELECT {case('active_segment', P.HABIT_STAGES)} AS habit_stage, count(*) AS user_count, sum(risk) AS revenue_at_risk FROM s_sc GROUP BY 1")
oracle("habit_funnel", """SELECT habit_stage, user_count, round(h.revenue_at_risk, 4) AS revenue_at_risk, round(user_count / max(user_count) OVER () * 100, 4) AS share_of_top_pct FROM s_habit h WHERE habit_stage IS NOT NULL""")


def decay(source: str, name: str) -> str:
    return f"""SELECT segment, CAST(m AS INTEGER) AS month_num, 'T+' || m AS timeline, round(pow(least(greatest(1 - p, 0.05), 0.99), m) * 100, 4) AS retention_pct, '{name}' AS basis FROM ({source}), range(1, 13) t(m)"""


oracle("decay_by_segment", decay("SELECT price_segment AS segment, avg(churn_probability) AS p FROM s_sc WHERE price_segment IN ('Deal Hunter < 4.5', 'Standard 4.5-6.5', 'Premium >= 6.5') GROUP BY 1", "members")
       + " UNION ALL " + decay(f"SELECT strategic_segment AS segment, avg_churn_prob AS p FROM s_mx s ORDER BY {ORDER} LIMIT 4", "summary"))
oracle("loss_outlook", """SELECT CAST(h AS INTEGER) AS horizon_months, h || ' tháng' AS horizon_label, round(sum(expected_renewal_amount * (1 - pow(1 - p, h))), 4) AS projected_revenue_loss,
  round(sum(expected_renewal_amount * (1 - pow(1 - p, h))) / sum(expected_renewal_amount) * 100, 4) AS projected_loss_share_pct FROM s_sc, (VALUES (3), (6), (12)) t(h) GROUP BY h""")
oracle("kpis_with_previous", """SELECT round(c, 4) AS forecasted_churn_rate, n AS high_flight_risk_users, round(b, 4) AS previous_forecasted_churn_rate, round(c - b, 4) AS forecasted_churn_delta_pp_vs_prev_month
  FROM (SELECT avg(CAST(p >= 0.6 AS INTEGER)) * 100 AS c, count(*) FILTER (p >= 0.6) AS n, (SELECT avg(p) * 100 FROM s_vs) AS b FROM s_sc)""")
oracle("must_save_rollup", """SELECT CAST(coalesce(sum(user_count), 0) AS BIGINT) AS user_count, round(coalesce(sum(m.revenue_at_risk), 0.0), 4) AS revenue_at_risk FROM s_mx m WHERE quadrant = 'Must Save'""")
oracle("priority_rows", f"""SELECT strategic_segment, quadrant, user_count, CAST(floor(s.revenue_at_risk + 0.5) AS BIGINT) AS revenue_at_risk, CAST(floor(avg_future_cltv + 0.5) AS BIGINT) AS avg_future_cltv,
  primary_risk_driver, {case('primary_risk_driver', P.RECOMMENDED_ACTIONS)} AS recommended_action FROM s_mx s QUALIFY row_number() OVER (ORDER BY {ORDER}) <= 6""")
oracle("top_by_risk", " UNION ALL ".join(
    f"(SELECT '{kind}' AS kind, {n} AS name, round(x.revenue_at_risk, 4) AS revenue_at_risk FROM {t} x WHERE {n} IS NOT NULL ORDER BY x.revenue_at_risk DESC, {n} DESC LIMIT 1)"
    for kind, n, t in (("band", "band", "s_bands"), ("driver", "risk_driver", "s_leak"), ("stage", "habit_stage", "s_habit"))))

# scenarios ---------------------------------------------------------------------------------
cte("s_base", """SELECT *, least(greatest(p, 1e-4), 1 - 1e-4) AS bp, CAST(is_manual_renew = 1 AS INTEGER) AS eligible_auto, CAST(deal_hunter_flag = 1 OR free_trial_flag = 1 AS INTEGER) AS eligible_upsell,
  CAST(high_skip_flag = 1 OR low_discovery_flag = 1 OR content_fatigue_flag = 1 AS INTEGER) AS eligible_engagement, expected_renewal_amount AS amt, p * expected_renewal_amount AS b_risk, (1 - p) * expected_renewal_amount AS b_kept FROM s_sc""")
_R = "round({0}, 6) AS {1}"
oracle("scenario_baseline", """SELECT msno, target_month, round(bp, 6) AS baseline_churn_probability, round(amt, 6) AS expected_renewal_amount, risk_band, bi_segment_name, round(least(greatest(skip_ratio, 0), 1), 6) AS skip_ratio,
  round(least(greatest(discovery_ratio, 0), 1), 6) AS discovery_ratio, is_manual_renew, deal_hunter_flag, free_trial_flag, high_skip_flag, low_discovery_flag, content_fatigue_flag, eligible_auto, eligible_upsell,
  eligible_engagement, round(b_risk, 6) AS baseline_revenue_at_risk_30d, round(b_kept, 6) AS baseline_retained_revenue_30d, rfm_total_score FROM s_base""")
oracle("scenario_baseline_derived", """SELECT msno, is_manual_renew, deal_hunter_flag, free_trial_flag, high_skip_flag, low_discovery_flag, CAST(high_skip_flag = 1 AND low_discovery_flag = 1 AS INTEGER) AS content_fatigue_flag,
  is_manual_renew AS eligible_auto, CAST(deal_hunter_flag = 1 OR free_trial_flag = 1 AS INTEGER) AS eligible_upsell, CAST(high_skip_flag = 1 OR low_discovery_flag = 1 AS INTEGER) AS eligible_engagement
  FROM (SELECT msno, CAST(renewal_segment = 'Pay_Manual' AS INTEGER) AS is_manual_renew, CAST(price_segment = 'Deal Hunter < 4.5' AS INTEGER) AS deal_hunter_flag,
    CAST(price_segment = 'Free Trial / Zero Pay' OR expected_renewal_amount <= 0 AS INTEGER) AS free_trial_flag, CAST(skip_ratio >= 0.5 AS INTEGER) AS high_skip_flag, CAST(discovery_ratio < 0.2 AS INTEGER) AS low_discovery_flag FROM s_sc)""")
cte("s_means", """SELECT coalesce(avg(bp) FILTER (eligible_auto = 1), avg(bp)) AS manual_mean_probability, coalesce(avg(bp) FILTER (renewal_segment = 'Pay_Auto-Renew'), avg(bp)) AS auto_mean_probability,
  coalesce(avg(bp) FILTER (eligible_engagement = 1), avg(bp)) AS fatigue_mean_probability, coalesce(avg(bp) FILTER (eligible_engagement = 0), avg(bp)) AS healthy_mean_probability,
  coalesce(avg(bp) FILTER (eligible_upsell = 1), avg(bp)) AS deal_mean_probability, coalesce(avg(bp) FILTER (eligible_upsell = 0), avg(bp)) AS paid_stable_mean_probability,
  coalesce(quantile_cont(amt, 0.5) FILTER (price_segment = 'Standard 4.5-6.5'), quantile_cont(amt, 0.5) FILTER (amt > 0), 0.0) AS st,
  coalesce(quantile_cont(amt, 0.5) FILTER (price_segment = 'Premium >= 6.5'), quantile_cont(amt, 0.5) FILTER (amt > 0)) AS pr FROM s_base""")
cte("s_lp", """SELECT 0.0 - least(greatest(manual_mean_probability - auto_mean_probability, 0), 0.15) AS auto_prob_delta_if_treated, 0.0 - least(greatest(fatigue_mean_probability - healthy_mean_probability, 0), 0.18) AS engagement_prob_delta_if_treated,
  least(greatest(paid_stable_mean_probability - deal_mean_probability, -0.15), 0.12) AS upsell_group_gap, st AS standard_target_amount, greatest(coalesce(pr, st), st) AS premium_target_amount, * EXCLUDE (st, pr) FROM s_means""")
oracle("lever_parameters", "SELECT round(COLUMNS(*), 6) FROM s_lp")
cte("s_target", """SELECT b.*, l.*, CASE WHEN rfm_segment = 'High Value' OR rfm_total_score >= 7 THEN greatest(t, premium_target_amount) ELSE t END AS target
  FROM (SELECT b.*, CASE WHEN free_trial_flag = 1 THEN standard_target_amount ELSE greatest(amt, standard_target_amount) END AS t FROM s_base b, s_lp) b, s_lp l""")
oracle("upsell_target", "SELECT msno, free_trial_flag, rfm_segment, round(amt, 4) AS expected_renewal_amount, round(target, 4) AS target_amount FROM s_target")


def simulate(configs: str, labels: str) -> str:
    """configs: rows (labels..., sa, su, se, ca, cu, ce)"""
    return f"""SELECT *, sp * sim_amt AS s_risk, (1 - sp) * sim_amt AS s_kept, (1 - bp) * sim_amt AS po, {band('sp')} AS sim_band FROM (
  SELECT *, amt + wu * up_amt AS sim_amt, least(greatest(bp + wa * auto_prob_delta_if_treated + we * engagement_prob_delta_if_treated + wu * up_prob, 1e-4), 1 - 1e-4) AS sp, wa * ca + wu * cu + we * ce AS cost FROM (
  SELECT *, least(greatest(upsell_group_gap + least(greatest(0.08 * up_amt / greatest(target, 1.0), 0), 0.1), -0.15), 0.12) AS up_prob FROM (
  SELECT t.*, {labels} ca, cu, ce, eligible_auto * sa AS wa, eligible_upsell * su AS wu, eligible_engagement * se AS we, greatest(target - amt, 0) AS up_amt
  FROM s_target t, ({configs}) c)))"""


def row(labels: dict, c) -> str:
    head = "".join(f"{v!r} AS {k}, " for k, v in labels.items())
    c = c.normalized()
    nums = zip(("sa", "su", "se", "ca", "cu", "ce"), (c.manual_to_auto_share, c.upsell_share, c.engagement_share, c.manual_to_auto_cost_per_user, c.upsell_cost_per_user, c.engagement_cost_per_user))
    return "SELECT " + head + ", ".join(f"CAST({v!r} AS DOUBLE) AS {k}" for k, v in nums)


CFG = P.ScenarioConfig(0.20, 0.15, 0.25, 2.0, 1.5, 1.0)
cte("s_sim", simulate(row({}, CFG), ""))
oracle("scenario_member_level", """SELECT msno, round(wa, 6) AS auto_treatment_weight, round(we, 6) AS engagement_treatment_weight, round(wu, 6) AS upsell_treatment_weight, round(target, 6) AS upsell_target_amount_if_treated,
  round(up_amt, 6) AS upsell_amount_delta_if_treated, round(up_prob, 6) AS upsell_prob_delta_if_treated, round(sim_amt, 6) AS simulated_expected_renewal_amount, round(sp, 6) AS simulated_churn_probability,
  round(s_risk, 6) AS simulated_revenue_at_risk_30d, round(po, 6) AS price_only_retained_revenue_30d, round(s_kept, 6) AS simulated_retained_revenue_30d, round(s_kept - po, 6) AS risk_effect_revenue_delta_30d,
  round(po - b_kept, 6) AS upsell_effect_revenue_delta_30d, round(s_kept - b_kept, 6) AS total_retained_revenue_delta_30d, sim_band AS simulated_risk_band, round(cost, 6) AS campaign_cost FROM s_sim""")
SUMS = """count(*) AS population_users, CAST(sum(eligible_auto) AS BIGINT) AS eligible_auto_users, CAST(sum(eligible_upsell) AS BIGINT) AS eligible_upsell_users, CAST(sum(eligible_engagement) AS BIGINT) AS eligible_engagement_users,
  round(sum(wa), 4) AS impacted_auto_user_equivalent, round(sum(wu), 4) AS impacted_upsell_user_equivalent, round(sum(we), 4) AS impacted_engagement_user_equivalent,
  round(avg(bp), 4) AS baseline_avg_churn_probability, round(avg(sp), 4) AS simulated_avg_churn_probability, round(sum(b_risk), 4) AS baseline_revenue_at_risk_30d, round(sum(s_risk), 4) AS simulated_revenue_at_risk_30d,
  round(sum(b_kept), 4) AS baseline_retained_revenue_30d, round(sum(s_kept), 4) AS simulated_retained_revenue_30d, round(sum(greatest(s_kept - po, 0)), 4) AS saved_revenue_from_risk_reduction_30d,
  round(sum(greatest(po - s_kept, 0)), 4) AS revenue_loss_from_risk_increase_30d, round(sum(po - b_kept), 4) AS incremental_upsell_revenue_30d, round(sum(cost), 4) AS campaign_cost_30d,
  round(sum(s_risk) - sum(b_risk), 4) AS revenue_at_risk_delta_30d, round(sum(s_kept) - sum(b_kept), 4) AS retained_revenue_delta_30d, round(sum(s_kept) - sum(b_kept) - sum(cost), 4) AS net_value_after_cost_30d"""
oracle("scenario_summary", f"SELECT target_month, {SUMS} FROM s_sim GROUP BY target_month")
D = P.ScenarioConfig()


def levers(isolate: int) -> str:
    o = P.ScenarioConfig(0, 0, 0) if isolate else D
    each = (("combined", 0.25, CFG),
            ("manual_to_auto", max(0.20, o.upsell_share, o.engagement_share), P.ScenarioConfig(0.20, o.upsell_share, o.engagement_share, 2.0, 0, 0)),
            ("upsell", max(0.15, o.manual_to_auto_share, o.engagement_share), P.ScenarioConfig(o.manual_to_auto_share, 0.15, o.engagement_share, 0, 1.5, 0)),
            ("engagement", max(0.25, o.manual_to_auto_share, o.upsell_share), P.ScenarioConfig(o.manual_to_auto_share, o.upsell_share, 0.25, 0, 0, 1.0)))
    return " UNION ALL ".join(row({"lever_name": n, "share": s, "isolate": isolate}, c) for n, s, c in each)


oracle("lever_summary", f"""SELECT lever_name, CAST(share AS DOUBLE) AS share, CAST(isolate AS INTEGER) AS isolate, x.* EXCLUDE (lever_name, share, isolate, eligible_auto_users, eligible_upsell_users, eligible_engagement_users,
  impacted_auto_user_equivalent, impacted_upsell_user_equivalent, impacted_engagement_user_equivalent, revenue_loss_from_risk_increase_30d)
  FROM (SELECT lever_name, share, isolate, {SUMS} FROM ({simulate(levers(0) + ' UNION ALL ' + levers(1), 'lever_name, share, isolate,')}) GROUP BY 1, 2, 3) x""")
_SENS = " UNION ALL ".join(row({"lever_name": n, "share": s}, c(s)) for n, c in (
    ("manual_to_auto", lambda s: P.ScenarioConfig(s, D.upsell_share, D.engagement_share)), ("upsell", lambda s: P.ScenarioConfig(D.manual_to_auto_share, s, D.engagement_share)),
    ("engagement", lambda s: P.ScenarioConfig(D.manual_to_auto_share, D.upsell_share, s))) for s in P.SENSITIVITY_SHARES)
cte("s_sens", simulate(_SENS, "lever_name, share,"))
oracle("sensitivity_table", f"""SELECT lever_name, CAST(share AS DOUBLE) AS share, simulated_avg_churn_probability, revenue_at_risk_delta_30d, retained_revenue_delta_30d, saved_revenue_from_risk_reduction_30d,
  incremental_upsell_revenue_30d, campaign_cost_30d, net_value_after_cost_30d FROM (SELECT lever_name, share, {SUMS} FROM s_sens GROUP BY 1, 2)""")
oracle("sensitivity_per_pct", f"""SELECT {case('lever_name', P.LEVER_NAMES)} AS strategy, round(quantile_cont(d, 0.5), 4) AS revenue_impact_per_1pct
  FROM (SELECT lever_name, (sum(s_kept) - sum(b_kept)) / (CAST(share AS DOUBLE) * 100) AS d FROM s_sens GROUP BY lever_name, share) GROUP BY lever_name""")
oracle("segment_impact", """SELECT target_month, bi_segment_name AS segment_name, count(*) AS users, round(avg(bp), 4) AS baseline_avg_churn_probability, round(avg(sp), 4) AS simulated_avg_churn_probability,
  round(sum(b_risk), 4) AS baseline_revenue_at_risk_30d, round(sum(s_risk), 4) AS simulated_revenue_at_risk_30d, round(sum(b_kept), 4) AS baseline_retained_revenue_30d, round(sum(s_kept), 4) AS simulated_retained_revenue_30d,
  round(sum(cost), 4) AS campaign_cost_30d, round(sum(s_risk) - sum(b_risk), 4) AS revenue_at_risk_delta_30d, round(sum(s_kept) - sum(b_kept), 4) AS retained_revenue_delta_30d FROM s_sim GROUP BY 1, 2""")
_EDGES = [i / 10 for i in range(11)]


def tenth(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} <= {hi} THEN '{lo:.1f}-{hi:.1f}'" for lo, hi in zip(_EDGES[:-1], _EDGES[1:])) + " END"


cte("s_shift2", f"""SELECT state, bin, n FROM (SELECT 'baseline' AS state, {tenth('bp')} AS bin, count(*) AS n FROM s_sim GROUP BY 2 UNION ALL SELECT 'simulated', {tenth('sp')}, count(*) FROM s_sim GROUP BY 2)""")
cte("s_bins", "SELECT state, bin FROM (VALUES ('baseline'), ('simulated')) s(state), (VALUES " + ", ".join(f"('{lo:.1f}-{hi:.1f}')" for lo, hi in zip(_EDGES[:-1], _EDGES[1:])) + ") b(bin)")
oracle("population_risk_shift", """SELECT CAST(202402 AS INTEGER) AS target_month, state, 'probability_bin' AS bin_type, bin AS probability_bin, coalesce(n, 0) AS users FROM s_bins LEFT JOIN s_shift2 USING (state, bin)
  UNION ALL SELECT 202402, 'baseline', 'risk_band', risk_band, count(*) FROM s_sim GROUP BY risk_band UNION ALL SELECT 202402, 'simulated', 'risk_band', sim_band, count(*) FROM s_sim GROUP BY sim_band""")
oracle("risk_hist_density", """SELECT CAST(202402 AS INTEGER) AS target_month, CAST(split_part(bin, '-', 1) AS DOUBLE) AS bin_start, CAST(split_part(bin, '-', 2) AS DOUBLE) AS bin_end,
  round(coalesce(max(n) FILTER (state = 'baseline'), 0) / (SELECT count(*) FROM s_sim), 6) AS baseline_density, round(coalesce(max(n) FILTER (state = 'simulated'), 0) / (SELECT count(*) FROM s_sim), 6) AS scenario_density
  FROM s_bins LEFT JOIN s_shift2 USING (state, bin) GROUP BY bin""")
_PRESETS = " UNION ALL ".join(row({
    "scenario_id": p.scenario_id, "label": p.label, "is_default": int(p.scenario_id == P.DEFAULT_PRESET), "a": p.config.manual_to_auto_share * 100,
    "u": p.config.upsell_share * 100, "s": p.config.engagement_share * 100}, p.config) for p in P.PRESETS)
cte("s_cat", f"""SELECT scenario_id, label, CAST(is_default AS INTEGER) AS is_default, round(a, 4) AS auto_shift_pct, round(u, 4) AS upsell_shift_pct, round(s, 4) AS skip_shift_pct, {SUMS}
  FROM ({simulate(_PRESETS, 'scenario_id, label, is_default, CAST(c.a AS DOUBLE) AS a, CAST(c.u AS DOUBLE) AS u, CAST(c.s AS DOUBLE) AS s,')}) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY scenario_id, label, is_default, a, u, s"))
oracle("scenario_catalog", "SELECT *, CAST(0 AS INTEGER) AS picked FROM s_cat UNION ALL SELECT *, 1 FROM s_cat WHERE scenario_id = 'balanced-demo'")
oracle("six_month_value", """SELECT bi_segment_name, count(*) AS users, round(sum(bp * (1 - pow(bp, 6)) / (1 - bp + 1e-9) * amt), 4) AS six_month_value FROM s_base GROUP BY 1""")
oracle("scenario_waterfall", " UNION ALL ".join(
    f"SELECT CAST(202402 AS INTEGER) AS target_month, CAST({i} AS INTEGER) AS step, '{n}' AS name, round({c}, 4) AS value FROM s_sim"
    for i, (n, c) in enumerate((("Current Baseline Revenue", "sum(b_kept)"), ("Saved Revenue from Retention", "sum(greatest(s_kept - po, 0))"), ("Incremental Revenue from Upsell", "sum(po - b_kept)"),
                                ("Scenario Revenue", "sum(s_kept)"), ("Campaign Cost", "-sum(cost)"), ("Net Value After Cost", "sum(s_kept) - sum(b_kept) - sum(cost)")), 1)))
oracle("simulation_units", """SELECT bi_segment_name, risk_band, renewal_segment, price_segment, eligible_auto, eligible_upsell, eligible_engagement, count(*) AS users, round(avg(bp), 6) AS baseline_churn_probability,
  round(avg(wa * auto_prob_delta_if_treated), 6) AS auto_probability_delta, round(avg(we * engagement_prob_delta_if_treated), 6) AS engagement_probability_delta, round(avg(wu * up_prob), 6) AS upsell_probability_delta,
  round(avg(amt), 6) AS expected_renewal_amount, round(avg(wu * up_amt), 6) AS upsell_amount_delta, round(sum(cost), 6) AS campaign_cost, round(sum(b_risk), 6) AS baseline_revenue_at_risk_30d,
  round(sum(b_kept), 6) AS baseline_retained_revenue_30d, round(sum(s_risk), 6) AS simulated_revenue_at_risk_30d, round(sum(s_kept), 6) AS simulated_retained_revenue_30d FROM s_sim GROUP BY 1, 2, 3, 4, 5, 6, 7""")
cte("s_runs", """SELECT expire_day, city, sum(b_kept) AS baseline_retained_revenue_30d, sum(s_kept) AS scenario_retained_revenue_30d, sum(po - b_kept) AS incremental_upsell_revenue_30d,
  sum(s_kept - po) AS saved_revenue_from_risk_reduction_30d, sum(cost) AS campaign_cost_30d, sum(s_kept - b_kept) - sum(cost) AS net_value_after_cost_30d, avg(bp) * 100 AS baseline_churn_prob_pct,
  avg(sp) * 100 AS scenario_churn_prob_pct FROM s_sim GROUP BY 1, 2""")
oracle("monte_carlo_percentiles", " UNION ALL ".join(
    f"SELECT '{n}' AS metric, '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, " + ", ".join(f"round(quantile_cont({c}, {p / 100}), 4) AS p{p:02d}" for p in (5, 25, 50, 75, 95)) + " FROM s_runs"
    for c, n in P.MONTE_CARLO_METRICS.items()))
oracle("monte_carlo_win_shares", """SELECT count(*) AS n_iterations, round(avg(CAST(scenario_retained_revenue_30d > baseline_retained_revenue_30d AS INTEGER)), 4) AS probability_scenario_beats_baseline,
  round(avg(CAST(net_value_after_cost_30d > 0 AS INTEGER)), 4) AS probability_net_positive FROM s_runs""")
oracle("mc_histogram", """WITH r AS (SELECT min(net_value_after_cost_30d) AS lo, max(net_value_after_cost_30d) AS hi, count(*) AS n, CAST(least(greatest(floor(sqrt(count(*))), 10), 20) AS INTEGER) AS bins FROM s_runs),
  h AS (SELECT least(CAST(floor((net_value_after_cost_30d - lo) / ((hi - lo) / bins)) AS INTEGER), bins - 1) AS bin, count(*) AS c FROM s_runs, r GROUP BY 1)
  SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * ((hi - lo) / bins), 4) AS bucket_start, round(lo + (g.bin + 1) * ((hi - lo) / bins), 4) AS bucket_end,
  round(lo + (g.bin + 0.5) * ((hi - lo) / bins), 4) AS bucket_mid, coalesce(c, 0) AS run_count, round(coalesce(c, 0) / n * 100, 4) AS share_pct
  FROM r, LATERAL (SELECT unnest(range(bins)) AS bin) g LEFT JOIN h ON h.bin = g.bin""")

# What must be found of any 1,000 runs; the draws themselves SQL cannot repeat.
oracle("monte_carlo_invariants", """SELECT unnest(['run_number', 'parts_of_revenue', 'net_value', 'campaign_cost', 'multipliers',
  'percentages', 'full_renewal', 'percentiles', 'mean_and_deviation', 'histogram', 'all_runs']) AS invariant,
  unnest([1000, 1000, 1000, 1000, 1000, 1000, 1000, 8, 8, 1, 1])::BIGINT AS checked, 0::BIGINT AS violations""")
