"""Renewal-based churn labels per member and month.

A member belongs to the cohort of month m when the last payment day before m holds
a row whose expiry falls into m. The label looks at the payments after that day.

Raw rows are reduced twice before any window runs: first to one row per member,
day and offer (list price, plan days, payment method), then to one row per member
and day. A member that owns a third of all rows is at most one row per calendar
day in the windows, and the map side of the first aggregate has merged most of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from renewlake import params as P
from renewlake.functions.cols import flag, safe_divide, yyyymm, yyyymmdd

OFFER = ("plan_list_price", "payment_plan_days", "payment_method_id")
LAGS = 5


def fix_expiry(tx: DataFrame) -> DataFrame:
    """Expiry before payment is flagged and moved to the payment date; unparseable dates are dropped."""
    return (
        tx.where(F.col("transaction_date").isNotNull() & F.col("membership_expire_date").isNotNull())
        .withColumn("invalid_expire_before_txn", flag(F.col("membership_expire_date") < F.col("transaction_date")))
        .withColumn("membership_expire_date", F.greatest("membership_expire_date", "transaction_date"))
        .withColumn("transaction_month", yyyymm("transaction_date"))
        .withColumn("expire_month", yyyymm("membership_expire_date"))
    )


def _expiry_order() -> Column:
    days = F.unix_date("membership_expire_date")
    return F.when(F.col("is_cancel") == 1, -days).otherwise(days)


def same_day_rank(tx: DataFrame) -> DataFrame:
    """Position of each row among the rows of its member and day; the last one is in effect."""
    order = Window.partitionBy("msno", "transaction_date").orderBy(
        F.col("plan_list_price").desc(), F.col("payment_plan_days").desc(), F.col("payment_method_id").desc(),
        "is_cancel", _expiry_order(), "rid",
    )
    return tx.withColumn("day_rank", F.row_number().over(order))


def _offers(tx: DataFrame) -> DataFrame:
    """One row per member, day and offer. Within an offer, payments come before cancels."""
    cancel = F.col("is_cancel") == 1
    row = F.struct(
        "membership_expire_date", "is_cancel", "is_auto_renew", "actual_amount_paid", "invalid_expire_before_txn", "rid")
    return tx.groupBy("msno", "transaction_date", *OFFER).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(flag(cancel)).alias("cancels"),
        F.sum("is_auto_renew").alias("autos"),
        F.sum("actual_amount_paid").alias("paid"),
        F.sum("plan_list_price").alias("listed"),
        F.max(flag(~cancel)).alias("has_payment"),
        F.min(F.when(cancel, F.col("membership_expire_date"))).alias("cancel_expire"),
        F.max_by(row, F.struct("is_cancel", _expiry_order(), "rid")).alias("last_row"),
        F.min(F.struct("membership_expire_date", "rid")).alias("first_by_expiry"),
    )


def _days(offers: DataFrame) -> DataFrame:
    """One row per member and day, all of a member in one partition from here on."""
    offers = offers.repartition("msno")
    in_day = Window.partitionBy("msno", "transaction_date").orderBy(*[F.col(c).desc() for c in OFFER])
    # Cancels count against the running expiry only until the day's first payment.
    offers = offers.withColumn("_paid_yet", F.max("has_payment").over(in_day))
    leading = F.when(F.col("_paid_yet") == 0, F.col("cancel_expire"))
    return offers.groupBy("msno", "transaction_date").agg(
        *[F.sum(c).alias(c) for c in ("rows", "cancels", "autos", "paid", "listed")],
        F.max("has_payment").alias("has_payment"),
        F.min(leading).alias("leading_cancel"),
        F.max_by(F.struct(*OFFER, "last_row"), F.struct(*[-F.col(c) for c in OFFER])).alias("eff"),
        F.min("first_by_expiry").alias("first_by_expiry"),
    )


def effective_days(tx: DataFrame) -> DataFrame:
    """Per member and payment day: the row in effect, running totals, next payment and its gap."""
    days = _days(_offers(tx)).withColumn("transaction_month", yyyymm("transaction_date"))
    forward = Window.partitionBy("msno").orderBy("transaction_date")
    backward = Window.partitionBy("msno").orderBy(F.col("transaction_date").desc())
    upto = forward.rowsBetween(Window.unboundedPreceding, 0)
    # Nearest payment day on or after each day, seen from the end.
    days = days.withColumn(
        "_pay_day",
        F.last(F.when(F.col("has_payment") == 1, F.col("transaction_date")), ignorenulls=True).over(
            backward.rowsBetween(Window.unboundedPreceding, 0)),
    )
    # Lowest cancel expiry between a day and its payment day.
    to_payment = (
        Window.partitionBy("msno", "_pay_day").orderBy(F.col("transaction_date").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    days = days.withColumn("_cancel_to", F.min("leading_cancel").over(to_payment))
    days = days.withColumns({
        "next_month": F.lead("transaction_month").over(forward),
        "next_payment": F.lead("_pay_day").over(forward),
        "cancel_before_payment": F.lead("_cancel_to").over(forward),
        "previous_day": F.lag("transaction_date").over(forward),
        **{f"to_date_{c}": F.sum(c).over(upto) for c in ("rows", "cancels", "autos", "paid", "listed")},
    })
    last = F.col("eff.last_row")
    return days.select(
        "msno",
        "transaction_date",
        "transaction_month",
        "next_month",
        last["membership_expire_date"].alias("expire_date"),
        yyyymm(last["membership_expire_date"]).alias("expire_month"),
        *[F.col(f"eff.{c}").alias(c) for c in OFFER],
        last["actual_amount_paid"].alias("actual_amount_paid"),
        last["is_auto_renew"].alias("is_auto_renew"),
        last["is_cancel"].alias("is_cancel"),
        last["invalid_expire_before_txn"].alias("invalid_expire_before_txn"),
        last["rid"].alias("rid"),
        F.datediff("next_payment", F.least(last["membership_expire_date"], F.col("cancel_before_payment")))
        .alias("renewal_gap_days"),
        F.when(F.struct(last["membership_expire_date"].alias("membership_expire_date"), last["rid"].alias("rid"))
               > F.col("first_by_expiry"), F.lit(0))
        .otherwise(F.coalesce(F.datediff("transaction_date", "previous_day"), F.lit(-1)))
        .alias("days_since_previous_transaction"),
        *[f"to_date_{c}" for c in ("rows", "cancels", "autos", "paid", "listed")],
    )


def cohort(days: DataFrame, first_month: int, last_month: int) -> DataFrame:
    """Member-months: no payment day lies between the day in effect and the month of its expiry.

    The first month of the history has no predecessor and gives no cohort.
    """
    in_force = (F.col("transaction_month") < F.col("expire_month")) & (
        F.col("next_month").isNull() | (F.col("next_month") >= F.col("expire_month")))
    return days.where(in_force).withColumn("target_month", F.col("expire_month")).where(
        (F.col("target_month") > first_month) & (F.col("target_month") <= last_month))


def add_label(rows: DataFrame, gap_days: int = P.CHURN_GAP_DAYS) -> DataFrame:
    gap = F.col("renewal_gap_days")
    return rows.withColumn("is_churn", flag(gap.isNull() | (gap >= gap_days)))


def add_churn_history(labelled: DataFrame) -> DataFrame:
    """Labels of the member's earlier cohort months; -1 where there is none."""
    order = Window.partitionBy("msno").orderBy("target_month")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def known(c: Column) -> Column:
        return F.coalesce(c, F.lit(-1))

    return labelled.withColumns({
        **{f"last_{k}_is_churn": known(F.lag("is_churn", k).over(order)) for k in range(1, LAGS + 1)},
        "churn_rate": F.coalesce(F.avg("is_churn").over(before), F.lit(-1.0)),
        "churn_count": known(F.sum("is_churn").over(before).cast("int")),
        "transaction_count": known(F.nullif(F.count("is_churn").over(before), F.lit(0)).cast("int")),
    })


def add_history_aggregates(rows: DataFrame) -> DataFrame:
    """Totals over all transactions before the month."""
    n = F.col("to_date_rows")
    return rows.withColumns({
        "historical_transaction_rows": n.cast("int"),
        "historical_paid_total": F.col("to_date_paid"),
        "historical_paid_mean": F.col("to_date_paid") / n,
        "historical_list_price_mean": F.col("to_date_listed") / n,
        "historical_cancel_count": F.col("to_date_cancels").cast("int"),
        "historical_cancel_rate": F.col("to_date_cancels") / n,
        "historical_auto_renew_rate": F.col("to_date_autos") / n,
    })


def add_point_features(rows: DataFrame) -> DataFrame:
    discount = F.col("plan_list_price") - F.col("actual_amount_paid")
    days = F.col("payment_plan_days")
    return rows.withColumns({
        "discount": discount,
        "is_discount": flag(discount > 0),
        "amt_per_day": F.when(days.isin(0, -1), F.lit(-1.0)).otherwise(safe_divide("actual_amount_paid", days)),
    })


LABEL_COLUMNS = (
    "msno", "target_month", "is_churn", "expire_date", "transaction_date", "payment_method_id", "payment_plan_days",
    "plan_list_price", "actual_amount_paid", "is_auto_renew", "invalid_expire_before_txn",
    *[f"last_{k}_is_churn" for k in range(1, LAGS + 1)],
    "churn_rate", "churn_count", "transaction_count", "discount", "is_discount", "amt_per_day",
    "historical_transaction_rows", "historical_paid_total", "historical_paid_mean", "historical_list_price_mean",
    "historical_cancel_count", "historical_cancel_rate", "historical_auto_renew_rate", "days_since_previous_transaction",
)


def month_labels(tx: DataFrame, first_month: int, last_month: int, output_from: int | None = None) -> DataFrame:
    """All label columns for the cohort months; dates as yyyymmdd numbers.

    `output_from` drops earlier months from the result, after they have served as history.
    """
    rows = cohort(effective_days(fix_expiry(tx)), first_month, last_month)
    rows = add_churn_history(add_label(rows))
    if output_from is not None:
        rows = rows.where(F.col("target_month") >= output_from)
    rows = add_point_features(add_history_aggregates(rows))
    return rows.withColumns({
        "expire_date": yyyymmdd("expire_date"),
        "transaction_date": yyyymmdd("transaction_date"),
    }).select(*LABEL_COLUMNS)
