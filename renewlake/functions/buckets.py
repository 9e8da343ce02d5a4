"""First-match bucket rules. A NULL input falls to the rule's default."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from renewlake import params as P
from renewlake.functions.cols import clip, col, filled


def first_match(rules: Sequence[tuple[Column, object]], default) -> Column:
    head, *rest = rules
    out = F.when(head[0], F.lit(head[1]))
    for condition, value in rest:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def below(c, limits: Sequence[tuple[float, object]], default) -> Column:
    """value < limit -> label, first limit that holds."""
    x = col(c)
    return first_match([(x < limit, label) for limit, label in limits], default)


# --- serving taxonomy ----------------------------------------------------------

def age_bucket(c) -> Column:
    x = col(c)
    return first_match(
        [
            (x.between(10, 20), "15_20"),
            (x.between(10, 30), "21_30"),
            (x.between(10, 40), "31_40"),
            (x.between(10, 100), "41_plus"),
        ],
        "unknown",
    )


def gender_bucket(c) -> Column:
    g = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return F.when(g.isin("male", "female"), g).otherwise(F.lit("unknown"))


def txn_freq_bucket(c) -> Column:
    x = col(c)
    return first_match([(x <= 2, "low"), (x <= 6, "medium")], "high")


def txn_freq_bucket_or_unknown(c) -> Column:
    x = F.coalesce(col(c), F.lit(-1))
    return first_match([(x <= 0, "unknown"), (x <= 2, "low"), (x <= 6, "medium")], "high")


def skip_bucket(c) -> Column:
    return below(c, [(0.2, "low_skip"), (0.5, "mid_skip")], "high_skip")


def price_bucket(c) -> Column:
    return below(F.coalesce(col(c), F.lit(0.0)), [(4.5, "deal_<4.5"), (8.0, "standard_4.5_8")], "premium_>=8")


def loyalty_bucket(c) -> Column:
    return below(c, [(90, "new_<90d"), (365, "growing_90_365d")], "loyal_>=365d")


def activity_bucket(c) -> Column:
    return below(c, [(900, "inactive_<15m"), (3600, "casual_15m_1h")], "engaged_>=1h")


# --- bands and bins --------------------------------------------------------------

def risk_band(probability) -> Column:
    """Bands compare in single precision, so 0.6 reached by a sum of weights counts as 0.6."""
    p = clip(col(probability), 0.0, 1.0).cast("float")
    return first_match([(p >= F.lit(limit).cast("float"), label) for limit, label in P.RISK_BANDS], "Very Low")


def risk_tier(band) -> Column:
    b = col(band)
    return first_match(
        [(b.isin("Very High", "High"), "High"), (b.isin("Medium", "Low"), "Medium"), (b == "Very Low", "Low")],
        "Unknown",
    )


def mapped(c, mapping: dict[str, str], default=None) -> Column:
    """Label map as a CASE; anything else -> default (NULL when not given)."""
    x = col(c)
    out = None
    for key, value in mapping.items():
        out = F.when(x == key, F.lit(value)) if out is None else out.when(x == key, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def risk_tier_label(band) -> Column:
    return mapped(risk_tier(band), P.RISK_TIER_LABELS, P.RISK_TIER_LABELS["Unknown"])


def right_closed_bin(c, edges: Sequence[float], labels: Sequence[str], default="Unknown") -> Column:
    """(a, b] bins, the first one closed on both sides."""
    x = col(c)
    rules = [(x.between(edges[0], edges[1]), labels[0])]
    rules += [((x > lo) & (x <= hi), label) for lo, hi, label in zip(edges[1:-1], edges[2:], labels[1:])]
    return first_match(rules, default)


def left_closed_bin(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """[a, b) bins; outside -> NULL."""
    x = col(c)
    return first_match([((x >= lo) & (x < hi), label) for lo, hi, label in zip(edges[:-1], edges[1:], labels)], None)


def numbered_label(code, labels: Sequence[str]) -> Column:
    """Label of a small integer code (position in the list)."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), col(code) + 1)


def split_segment_name(c) -> list[Column]:
    """'a | b | c | d' -> loyalty, renewal, price, discovery; missing parts -> Unknown."""
    parts = F.split(F.coalesce(col(c), F.lit("Unknown")), r"\|")
    names = ("loyalty_segment", "renewal_segment", "price_segment", "discovery_segment")
    return [
        F.coalesce(F.nullif(F.trim(F.try_element_at(parts, F.lit(i + 1))), F.lit("")), F.lit("Unknown")).alias(name)
        for i, name in enumerate(names)
    ]


def value_tier(price_segment, free_trial_flag, deal_hunter_flag) -> Column:
    price = F.lower(F.coalesce(col(price_segment), F.lit("")))
    return first_match(
        [
            ((filled(free_trial_flag) >= 0.5) | price.contains("free trial"), P.VALUE_TIERS[0]),
            ((filled(deal_hunter_flag) >= 0.5) | price.contains("deal hunter"), P.VALUE_TIERS[1]),
        ],
        P.VALUE_TIERS[2],
    )


def risk_segment(churn_rate) -> Column:
    x = filled(churn_rate, -1.0)
    return first_match([(x >= 0.25, P.RISK_SEGMENTS[0]), (x > 0.0, P.RISK_SEGMENTS[1])], P.RISK_SEGMENTS[2])
