"""Credit-history aggregates: discounted risk and activity, instalments, ledgers, audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmart.functions.scalars import ratio
from featmart.operators.ordering import occurrence_index


def status_number(status: str | Column) -> Column:
    """Numeric status; a closed month counts as 0."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s == "C", F.lit(0)).otherwise(s.cast("int"))


def discount(month: str, alpha: float) -> Column:
    return F.lit(1.0) / (1 + F.lit(float(alpha)) * F.col(month))


def log_risk(
    df: DataFrame, keys: Sequence[str], status: Column, alpha: float = 1, decimals: int = 2,
    month: str = "month", name: str = "log_risk",
) -> DataFrame:
    """log of the mean exponential status, each month discounted by its age."""
    weighted = F.exp(status) * discount(month, alpha)
    return df.groupBy(*keys).agg(F.round(F.ln(F.sum(weighted) / F.count(status)), decimals).alias(name))


def activity(
    df: DataFrame, keys: Sequence[str], active: Column, alpha: float = 1, decimals: int | None = 2,
    month: str = "month", name: str = "activity",
) -> DataFrame:
    """Mean discounted activity."""
    mean = F.avg(active * discount(month, alpha))
    return df.groupBy(*keys).agg((mean if decimals is None else F.round(mean, decimals)).alias(name))


def is_active(status: str = "status") -> Column:
    return (F.col(status) != "C").cast("int")


def risk_by_client_month(df: DataFrame, decimals: int = 2) -> DataFrame:
    return log_risk(df, ["client_id", "month"], status_number("status"), 0, decimals, name="risk")


def risk_by_client(df: DataFrame, alpha: float = 1, decimals: int = 2) -> DataFrame:
    """Discounted log-risk of the rounded monthly log-risks, decimals kept."""
    return log_risk(risk_by_client_month(df, decimals), ["client_id"], F.col("risk"), alpha, decimals, name="risk")


def active_loans(df: DataFrame) -> DataFrame:
    """Number of active loans per client and month."""
    return df.groupBy("client_id", "month").agg(F.sum(is_active()).alias("active_loans"))


def mean_activity_by_client(df: DataFrame, alpha: float = 1, decimals: int | None = None) -> DataFrame:
    return activity(active_loans(df), ["client_id"], F.col("active_loans"), alpha, decimals)


INSTALMENT = ["client_id", "loan_id", "number"]
# Fragments of one version in payment order; amounts break ties.
FRAGMENT_ORDER = ("paid_day", "due_day", "due", "paid")


def installment_versions(df: DataFrame) -> DataFrame:
    """Payments of each version of each instalment.

    Days count back, so the first payment is the largest day. The due day and amount are
    those of the earliest entry in sorted order, ties broken by value.
    """
    grouped = df.groupBy(*INSTALMENT, "version").agg(
        F.min(F.struct(*FRAGMENT_ORDER)).alias("first"),
        F.count("paid_day").alias("payments"),
        F.max("paid_day").alias("paid_start"),
        F.min("paid_day").alias("paid_end"),
        F.round(F.coalesce(F.sum("paid"), F.lit(0.0)), 4).alias("paid"),
    )
    return grouped.select(
        *INSTALMENT, "version", "first.due_day", "first.due", "payments", "paid_start", "paid_end", "paid"
    )


def by_installment(versions: DataFrame) -> DataFrame:
    """One row per instalment over its versions; `paid` is that of the last version."""
    return versions.groupBy(*INSTALMENT).agg(
        F.min("version").alias("version_min"),
        F.max("version").alias("version_max"),
        F.count("version").alias("versions"),
        F.round(F.sum("due"), 4).alias("due"),
        F.max_by("paid", "version").alias("paid"),
        F.max("due_day").alias("due_start"),
        F.min("due_day").alias("due_end"),
        F.sum("payments").alias("payments"),
        F.max("paid_start").alias("paid_start"),
        F.min("paid_end").alias("paid_end"),
    )


def loan_amount(df: DataFrame, decimals: int = 2) -> DataFrame:
    return df.groupBy("client_id", "loan_id").agg(F.round(F.sum("due"), decimals).alias("loan_amount"))


def loaned_amount(amounts: DataFrame, decimals: int = 2) -> DataFrame:
    return amounts.groupBy("client_id").agg(F.round(F.sum("loan_amount"), decimals).alias("loaned_amount"))


def keep_last_version(df: DataFrame) -> DataFrame:
    """All payment fragments of the last version of every instalment.

    The last version is aggregated and joined back; an instalment with very many
    fragments is then split by the adaptive skew join instead of filling one window task.
    """
    last = df.groupBy(*INSTALMENT).agg(F.max("version").alias("version"))
    return df.join(last, [*INSTALMENT, "version"], "left_semi")


def last_version(df: DataFrame) -> DataFrame:
    """Fragments of the last version with their ordinal in payment order."""
    order = [F.col("paid_day").desc(), F.col("due_day"), F.col("due"), F.col("paid")]
    return occurrence_index(keep_last_version(df), INSTALMENT, order, "fragment")


def days_past_due(due_day: str = "due_day", paid_day: str = "paid_day") -> Column:
    """Days late, positive = late; both days count back from now."""
    return F.col(due_day) - F.col(paid_day)


def repaid_last_version(df: DataFrame, late: Column, name: str) -> DataFrame:
    """Amount repaid for each lateness of the last version of every instalment.

    Payments are summed per version and lateness first. What remains of an instalment is
    at most one row per version and day, so the last version is picked by a window over
    few rows, without reading the payments twice.
    """
    sums = df.withColumn(name, late).groupBy(*INSTALMENT, "version", name).agg(F.sum("paid").alias("_paid"))
    last = F.max("version").over(Window.partitionBy(*INSTALMENT))
    return (
        sums.withColumn("_last", last)
        .filter(F.col("version") == F.col("_last"))
        .select(*INSTALMENT, "version", name, F.round(F.coalesce("_paid", F.lit(0.0)), 4).alias("repaid"))
    )


def expected_delay(repaid: DataFrame, totals: DataFrame, keys: Sequence[str], late: str, total: str,
                   decimals: int = 6) -> DataFrame:
    """Repaid-share-weighted mean delay per key, with the repaid and total amounts.

    The totals carry one row per key, so they are attached after grouping: the share is
    the grouped sum over the total, and no payment row is joined.
    """
    sums = repaid.groupBy(*keys).agg(
        F.sum("repaid").alias("repaid"), F.sum(F.col("repaid") * F.col(late)).alias("_weighted")
    )
    return sums.join(totals, list(keys), "left").select(
        *keys,
        F.round("repaid", 4).alias("repaid"),
        total,
        F.round(ratio("repaid", total), decimals).alias("share_repaid"),
        F.round(ratio("_weighted", total), decimals).alias(f"expected_{late}"),
    )


def varying_versions(df: DataFrame, column: str = "due") -> DataFrame:
    """Instalment versions in which the amount is not constant, with its span."""
    return df.groupBy(*INSTALMENT, "version").agg(
        F.min(column).alias("low"), F.max(column).alias("high")
    ).filter("high > low")


def inconsistent_installments(versions: DataFrame, column: str = "paid") -> DataFrame:
    """Instalments whose versions disagree on an amount."""
    return versions.groupBy(*INSTALMENT).agg(
        F.min(column).alias("low"), F.max(column).alias("high"), F.max("version").alias("last_version")
    ).filter("high > low")


def repair_versions(versions: DataFrame, column: str = "paid") -> DataFrame:
    """Drop all but the last version of the instalments whose versions disagree."""
    outliers = inconsistent_installments(versions, column).select(*INSTALMENT, "last_version")
    joined = versions.join(outliers, INSTALMENT, "left")
    return joined.filter(F.col("last_version").isNull() | (F.col("version") == F.col("last_version"))).drop("last_version")


def outstanding_share(df: DataFrame, above: float = 0.1, below: float = 0.5) -> DataFrame:
    """Shares of instalments left open or overpaid beyond the tolerances."""
    gap = F.round(F.col("due") - F.col("paid"), 2)
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(gap >= above).alias("n_open"),
        F.count_if(gap <= -below).alias("n_overpaid"),
        (F.count_if(gap >= above) / F.count("*")).alias("share_open"),
        (F.count_if(gap <= -below) / F.count("*")).alias("share_overpaid"),
    )


def delay_thresholds(df: DataFrame, delay: Column, limits: Sequence[int] = (0, 30, 60, 90, 120)) -> DataFrame:
    return df.agg(
        F.max(delay).alias("max_delay"), *[F.count_if(delay > d).alias(f"over_{d}") for d in limits]
    )


def account_ledger(df: DataFrame, decimals: int = 4) -> DataFrame:
    """Per account and month: movements, interest and its rate on the previous receivable.

    An account has one row per month, which bounds the window of a single account.
    """
    series = Window.partitionBy("loan_id").orderBy(F.col("month").desc())
    before = F.lag("receivable").over(series)
    interest = F.col("receivable") - F.col("balance")
    return df.select(
        "loan_id", "month",
        F.round(F.col("balance") - F.lag("balance").over(series), decimals).alias("balance_diff"),
        F.round(interest, decimals).alias("interest"),
        before.alias("receivable_before"),
        F.round(ratio(interest, before), 6).alias("rate"),
        F.round(F.col("drawn") - F.col("payment"), decimals).alias("drawn_minus_paid"),
    )


def relation_audit(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, holds, fails, unknown, percent) for any number of rules in one pass."""
    row = df.agg(
        F.count("*").alias("_rows"),
        *[
            F.struct(
                F.count_if(rule).alias("holds"),
                F.count_if(~rule).alias("fails"),
                F.count_if(rule.isNull()).alias("unknown"),
            ).alias(name)
            for name, rule in rules.items()
        ],
    )
    return row.unpivot(["_rows"], list(rules), "rule", "s").select(
        "rule", "s.*", F.round(100 * F.col("s.holds") / F.col("_rows"), 6).alias("percent")
    )
