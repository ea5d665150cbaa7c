"""Discounted risk and activity, instalment chains, ledgers and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmart.functions.scalars import month_of_days
from featmart.operators import cleaning, credit, keys
from featmart.plans import roles
from featmart.plans.registry import query

KNOWN = "known AS (SELECT client_id, loan_id, month, status FROM monthly WHERE status <> 'X')"
NUMBER = "CASE WHEN status = 'C' THEN 0 ELSE CAST(status AS INTEGER) END"


def known(spark, sf):
    """The series without its unknown months."""
    return cleaning.nullify(roles.monthly(spark, sf), "X", ["status"]).dropna(subset=["status"])


def risk_sql(name="log_risk", alpha=1):
    return f"round(ln(sum(exp({NUMBER}) / (1 + {alpha} * month)) / count(*)), 2) AS {name}"


@query("discounted_log_risk", f"""
WITH {KNOWN}, r AS (SELECT loan_id, {risk_sql()} FROM known GROUP BY loan_id)
SELECT r.loan_id, r.log_risk, x.client_id, coalesce(c.target, -1) AS target
FROM r JOIN loan_map x ON r.loan_id = x.loan_id LEFT JOIN client c ON x.client_id = c.client_id""")
def discounted_log_risk(spark, sf):
    risk = credit.log_risk(known(spark, sf), ["loan_id"], credit.status_number("status"))
    owned = keys.attach_client(risk, roles.loan_map(spark, sf))
    return keys.attach_target(owned, roles.client(spark, sf))


@query("discounted_activity", f"""
WITH {KNOWN} SELECT loan_id, round(sum((CASE WHEN status <> 'C' THEN 1 ELSE 0 END) / (1 + 0.5 * month)) / count(*), 3) AS activity
FROM known GROUP BY loan_id""")
def discounted_activity(spark, sf):
    return credit.activity(known(spark, sf), ["loan_id"], credit.is_active(), alpha=0.5, decimals=3)


@query("status_by_month", f"WITH {KNOWN} SELECT loan_id, month, {NUMBER} AS status FROM known")
def status_by_month(spark, sf):
    return known(spark, sf).select("loan_id", "month", credit.status_number("status").alias("status"))


@query("activity_by_month", f"""
WITH {KNOWN} SELECT client_id, loan_id, month, CASE WHEN status <> 'C' THEN 1 ELSE 0 END AS activity FROM known""")
def activity_by_month(spark, sf):
    return known(spark, sf).select("client_id", "loan_id", "month", credit.is_active().alias("activity"))


@query("risk_client_month", f"WITH {KNOWN} SELECT client_id, month, {risk_sql('risk', 0)} FROM known GROUP BY 1, 2")
def risk_client_month(spark, sf):
    return credit.risk_by_client_month(known(spark, sf))


@query("risk_by_client", f"""
WITH {KNOWN}, m AS (SELECT client_id, month, {risk_sql('risk', 0)} FROM known GROUP BY 1, 2)
SELECT client_id, round(ln(sum(exp(risk) / (1 + month)) / count(*)), 2) AS risk FROM m GROUP BY client_id""")
def risk_by_client(spark, sf):
    return credit.risk_by_client(known(spark, sf))


@query("risk_by_loan", f"WITH {KNOWN} SELECT loan_id, {risk_sql('risk')} FROM known GROUP BY loan_id")
def risk_by_loan(spark, sf):
    return credit.log_risk(known(spark, sf), ["loan_id"], credit.status_number("status"), name="risk")


@query("activity_by_loan", f"""
WITH {KNOWN} SELECT loan_id, round(avg((CASE WHEN status <> 'C' THEN 1 ELSE 0 END) / (1 + month)), 2) AS activity FROM known GROUP BY 1""")
def activity_by_loan(spark, sf):
    return credit.activity(known(spark, sf), ["loan_id"], credit.is_active())


@query("active_loans_client_month", f"""
WITH {KNOWN} SELECT client_id, month, CAST(sum(CASE WHEN status <> 'C' THEN 1 ELSE 0 END) AS BIGINT) AS active_loans FROM known GROUP BY 1, 2""")
def active_loans_client_month(spark, sf):
    return credit.active_loans(known(spark, sf))


@query("mean_activity_by_loan", f"""
WITH {KNOWN} SELECT loan_id, round(avg((CASE WHEN status <> 'C' THEN 1 ELSE 0 END) / (1 + month)), 8) AS activity FROM known GROUP BY 1""")
def mean_activity_by_loan(spark, sf):
    return credit.activity(known(spark, sf), ["loan_id"], credit.is_active(), decimals=8)


@query("mean_activity_by_client", f"""
WITH {KNOWN}, a AS (SELECT client_id, month, sum(CASE WHEN status <> 'C' THEN 1 ELSE 0 END) AS n FROM known GROUP BY 1, 2)
SELECT client_id, round(avg(n / (1 + month)), 8) AS activity FROM a GROUP BY 1""")
def mean_activity_by_client(spark, sf):
    return credit.mean_activity_by_client(known(spark, sf), decimals=8)


VERSIONS = """versions AS (
  SELECT client_id, loan_id, number, version,
         first(due_day ORDER BY paid_day, due_day, due, paid NULLS FIRST) AS due_day,
         first(due ORDER BY paid_day, due_day, due, paid NULLS FIRST) AS due,
         count(paid_day) AS payments, max(paid_day) AS paid_start, min(paid_day) AS paid_end,
         round(coalesce(sum(paid), 0), 4) AS paid
  FROM installment GROUP BY client_id, loan_id, number, version)"""


@query("installment_versions", f"WITH {VERSIONS} SELECT * FROM versions")
def installment_versions(spark, sf):
    return credit.installment_versions(roles.installment(spark, sf))


@query("by_installment", f"""
WITH {VERSIONS}
SELECT client_id, loan_id, number, min(version) AS version_min, max(version) AS version_max, count(version) AS versions,
       round(sum(due), 4) AS due, max_by(paid, version) AS paid, max(due_day) AS due_start, min(due_day) AS due_end,
       CAST(sum(payments) AS BIGINT) AS payments, max(paid_start) AS paid_start, min(paid_end) AS paid_end
FROM versions GROUP BY 1, 2, 3""")
def by_installment(spark, sf):
    return credit.by_installment(credit.installment_versions(roles.installment(spark, sf)))


LOAN_AMOUNT = "amounts AS (SELECT client_id, loan_id, round(sum(due), 2) AS loan_amount FROM installment GROUP BY 1, 2)"


@query("loan_amount", f"WITH {LOAN_AMOUNT} SELECT * FROM amounts")
def loan_amount(spark, sf):
    return credit.loan_amount(roles.installment(spark, sf))


@query("loaned_amount", f"WITH {LOAN_AMOUNT} SELECT client_id, round(sum(loan_amount), 2) AS loaned_amount FROM amounts GROUP BY 1")
def loaned_amount(spark, sf):
    return credit.loaned_amount(credit.loan_amount(roles.installment(spark, sf)))


LAST = """last_rows AS (SELECT i.* FROM installment i JOIN (
  SELECT client_id, loan_id, number, max(version) AS v FROM installment GROUP BY 1, 2, 3) m
  ON i.client_id = m.client_id AND i.loan_id = m.loan_id AND i.number = m.number AND i.version = m.v)"""


@query("last_version", f"""
WITH {LAST} SELECT *, row_number() OVER (PARTITION BY client_id, loan_id, number
  ORDER BY paid_day DESC, due_day, due, paid NULLS FIRST) - 1 AS fragment FROM last_rows""")
def last_version(spark, sf):
    return credit.last_version(roles.installment(spark, sf))


REPAID = f"""{LAST}, repaid_dpd AS (
  SELECT client_id, loan_id, number, version, due_day - paid_day AS dpd, round(coalesce(sum(paid), 0), 4) AS repaid
  FROM last_rows GROUP BY 1, 2, 3, 4, 5)"""


def repaid_dpd(spark, sf):
    return credit.repaid_last_version(roles.installment(spark, sf), credit.days_past_due(), "dpd")


@query("repaid_by_dpd", f"WITH {REPAID} SELECT * FROM repaid_dpd")
def repaid_by_dpd(spark, sf):
    return repaid_dpd(spark, sf)


def expected_sql(keys_, total, late, source):
    on = " AND ".join(f"r.{k} = a.{k}" for k in keys_)
    cols = ", ".join(f"r.{k}" for k in keys_)
    return f"""SELECT {cols}, round(sum(r.repaid), 4) AS repaid, max(a.{total}) AS {total},
    round(sum(r.repaid) / nullif(max(a.{total}), 0), 6) AS share_repaid,
    round(sum(r.repaid * r.{late}) / nullif(max(a.{total}), 0), 6) AS expected_{late}
    FROM {source} r LEFT JOIN amounts a ON {on} GROUP BY {cols}"""


@query("expected_dpd_loan", f"WITH {REPAID}, {LOAN_AMOUNT} {expected_sql(['client_id', 'loan_id'], 'loan_amount', 'dpd', 'repaid_dpd')}")
def expected_dpd_loan(spark, sf):
    amounts = credit.loan_amount(roles.installment(spark, sf))
    return credit.expected_delay(repaid_dpd(spark, sf), amounts, ["client_id", "loan_id"], "dpd", "loan_amount")


@query("expected_dpd_client", f"""
WITH {REPAID}, amounts AS (SELECT client_id, round(sum(la), 2) AS loaned_amount FROM (
  SELECT client_id, loan_id, round(sum(due), 2) AS la FROM installment GROUP BY 1, 2) q GROUP BY 1)
{expected_sql(['client_id'], 'loaned_amount', 'dpd', 'repaid_dpd')}""")
def expected_dpd_client(spark, sf):
    amounts = credit.loaned_amount(credit.loan_amount(roles.installment(spark, sf)))
    return credit.expected_delay(repaid_dpd(spark, sf), amounts, ["client_id"], "dpd", "loaned_amount")


MPD = f"""{LAST}, repaid_mpd AS (
  SELECT client_id, loan_id, CAST(floor((due_day - paid_day) / 30.436875) AS BIGINT) AS mpd, round(coalesce(sum(paid), 0), 4) AS repaid
  FROM last_rows GROUP BY 1, 2, 3)"""


def repaid_mpd(spark, sf):
    repaid = credit.repaid_last_version(roles.installment(spark, sf), month_of_days(credit.days_past_due()), "mpd")
    return repaid.groupBy("client_id", "loan_id", "mpd").agg(F.round(F.sum("repaid"), 4).alias("repaid"))


@query("expected_mpd_loan", f"WITH {MPD}, {LOAN_AMOUNT} {expected_sql(['client_id', 'loan_id'], 'loan_amount', 'mpd', 'repaid_mpd')}")
def expected_mpd_loan(spark, sf):
    amounts = credit.loan_amount(roles.installment(spark, sf))
    return credit.expected_delay(repaid_mpd(spark, sf), amounts, ["client_id", "loan_id"], "mpd", "loan_amount")


@query("repaid_by_month_past_due", f"WITH {MPD} SELECT mpd, count(*) AS n, round(sum(repaid), 2) AS repaid FROM repaid_mpd GROUP BY 1")
def repaid_by_month_past_due(spark, sf):
    return repaid_mpd(spark, sf).groupBy("mpd").agg(
        F.count("*").alias("n"), F.round(F.sum("repaid"), 2).alias("repaid")
    )


@query("varying_versions", """
SELECT client_id, loan_id, number, version, min(due) AS low, max(due) AS high FROM installment
GROUP BY 1, 2, 3, 4 HAVING max(due) > min(due)""")
def varying_versions(spark, sf):
    return credit.varying_versions(roles.installment(spark, sf))


OUTLIERS = """outliers AS (SELECT client_id, loan_id, number, min(paid) AS low, max(paid) AS high, max(version) AS last_version
  FROM versions GROUP BY 1, 2, 3 HAVING max(paid) > min(paid))"""


@query("inconsistent_versions", f"WITH {VERSIONS}, {OUTLIERS} SELECT * FROM outliers")
def inconsistent_versions(spark, sf):
    return credit.inconsistent_installments(credit.installment_versions(roles.installment(spark, sf)))


@query("versions_repaired", f"""
WITH {VERSIONS}, {OUTLIERS} SELECT v.* FROM versions v LEFT JOIN outliers o
ON v.client_id = o.client_id AND v.loan_id = o.loan_id AND v.number = o.number
WHERE o.last_version IS NULL OR o.last_version = v.version""")
def versions_repaired(spark, sf):
    return credit.repair_versions(credit.installment_versions(roles.installment(spark, sf)))


@query("outstanding_share", f"""
WITH {VERSIONS}, g AS (SELECT round(due - paid, 2) AS gap FROM (
  SELECT round(sum(due), 4) AS due, max_by(paid, version) AS paid FROM versions GROUP BY client_id, loan_id, number) b)
SELECT count(*) AS n, count(*) FILTER (gap >= 0.1) AS n_open, count(*) FILTER (gap <= -0.5) AS n_overpaid,
       count(*) FILTER (gap >= 0.1) / count(*) AS share_open, count(*) FILTER (gap <= -0.5) / count(*) AS share_overpaid FROM g""")
def outstanding_share(spark, sf):
    base = credit.by_installment(credit.installment_versions(roles.installment(spark, sf)))
    return credit.outstanding_share(base)


@query("dpd_thresholds", "SELECT max(due_day - paid_day) AS max_delay, " + ", ".join(
    f"count(*) FILTER (due_day - paid_day > {d}) AS over_{d}" for d in (0, 30, 60, 90, 120)) + " FROM installment")
def dpd_thresholds(spark, sf):
    return credit.delay_thresholds(roles.installment(spark, sf), credit.days_past_due())


@query("account_ledger", """
SELECT loan_id, month, round(balance - lag(balance) OVER w, 4) AS balance_diff, round(receivable - balance, 4) AS interest,
       lag(receivable) OVER w AS receivable_before,
       round((receivable - balance) / nullif(lag(receivable) OVER w, 0), 6) AS rate, round(drawn - payment, 4) AS drawn_minus_paid
FROM account WINDOW w AS (PARTITION BY loan_id ORDER BY month DESC)""")
def account_ledger(spark, sf):
    return credit.account_ledger(roles.account(spark, sf))


AUDIT = {
    "total_is_sum": "abs(drawn - (drawn_atm + drawn_pos + drawn_other)) < 0.01",
    "receivable_covers_balance": "receivable >= balance",
    "counts_agree": "cnt_drawn = cnt_atm + cnt_pos + cnt_other",
    "no_atm_no_count": "drawn_atm IS NOT NULL OR cnt_atm = 0",
    "unpaid_if_small": "payment > 0 OR drawn > 0",
}


@query("relation_audit", " UNION ALL ".join(
    f"""SELECT '{name}' AS rule, count(*) FILTER ({rule}) AS holds, count(*) FILTER (NOT ({rule})) AS fails,
    count(*) FILTER (({rule}) IS NULL) AS unknown, round(100 * (count(*) FILTER ({rule})) / count(*), 6) AS percent FROM account"""
    for name, rule in AUDIT.items()))
def relation_audit(spark, sf):
    return credit.relation_audit(roles.account(spark, sf), {n: F.expr(r) for n, r in AUDIT.items()})
