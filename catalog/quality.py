"""Data-quality queries: suite, cells, duplicates, request rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SNAP, query, rounded
from ebbtide.operators import checks, rules, shaping
from ebbtide.schema import CATEGORIES, CONTRACT_OPEN_RANGES, CONTRACT_RANGES, REQUEST, SNAPSHOT, SUITE_RANGES
from ebbtide.sources.snapshot import snapshot, table

# A variant of the snapshot in which checks fail: a few cells missing, out of range,
# outside their category, and every seventh id repeated.
FAULTY = """
faulty AS (
  SELECT CASE WHEN Tenure % 7 = 3 THEN 'CUST-' || CAST(Age AS VARCHAR) ELSE CustomerID END AS CustomerID,
         CASE WHEN Tenure = 5 THEN 'Other' ELSE Gender END AS Gender,
         CASE WHEN Tenure % 11 = 2 THEN NULL ELSE Age END AS Age, Tenure,
         CASE WHEN Age = 40 THEN NULL ELSE ContractType END AS ContractType, InternetService,
         CASE WHEN Age = 41 THEN -MonthlyCharges ELSE MonthlyCharges END AS MonthlyCharges, TotalCharges,
         CASE WHEN Age = 42 THEN CallMinutes - 500.0::DOUBLE ELSE CallMinutes END AS CallMinutes, DataUsage, Complaints,
         RecentSupportTickets, PaymentMethod, LatePayments, Engagement, ChurnProbability, Churn
  FROM snap)"""


def faulty(spark, folder):
    tenure, age = F.col("Tenure"), F.col("Age")
    return snapshot(spark, folder).select(*[{
        "CustomerID": F.when(tenure % 7 == 3, F.concat(F.lit("CUST-"), age.cast("string"))).otherwise(F.col("CustomerID")),
        "Gender": F.when(tenure == 5, "Other").otherwise(F.col("Gender")),
        "Age": F.when(tenure % 11 != 2, age),
        "ContractType": F.when(age != 40, F.col("ContractType")),
        "MonthlyCharges": F.when(age == 41, -F.col("MonthlyCharges")).otherwise(F.col("MonthlyCharges")),
        "CallMinutes": F.when(age == 42, F.col("CallMinutes") - 500.0).otherwise(F.col("CallMinutes")),
    }.get(c, F.col(c)).alias(c) for c in SNAPSHOT.names])


def _suite_sql(source: str) -> str:
    rows, numeric = [], [f.name for f in SNAPSHOT.fields if f.dataType.typeName() != "string"]

    def add(kind, column, success, elements, unexpected, observed):
        name = f"'{column}'" if column else "NULL"
        rows.append(f"SELECT {len(rows)} AS check_id, '{kind}' AS kind, CAST({name} AS VARCHAR) AS \"column\", 'critical' AS severity, "
                    f"{success} AS success, CAST({elements} AS BIGINT) AS element_count, CAST({unexpected} AS BIGINT) AS unexpected_count, "
                    f"round(CAST({observed} AS DOUBLE), 6) AS observed FROM {source}")

    add("columns", None, "any_value(true)", "NULL", "NULL", "17")
    for c in numeric:
        add("type", c, "any_value(true)", "count(*)", "0", "NULL")
    for c in SNAPSHOT.names:
        add("not_null", c, f"count(*) = count({c})", "count(*)", f"count(*) - count({c})", "NULL")
    unique = len(rows)
    rows.append(f"SELECT {unique}, 'unique', 'CustomerID', 'critical', coalesce(sum(CASE WHEN n > 1 THEN n END), 0) = 0, "
                f"CAST(sum(n) AS BIGINT), CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT), NULL "
                f"FROM (SELECT count(*) AS n FROM {source} GROUP BY CustomerID)")
    for c, (lo, hi) in SUITE_RANGES.items():
        bad = f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi})"
        add("between", c, f"{bad} = 0", "count(*)", bad, "NULL")
    for c, values in CATEGORIES.items():
        listed = ", ".join(f"'{v}'" for v in values)
        bad = f"count(*) FILTER (WHERE {c} NOT IN ({listed}))"
        add("in_set", c, f"{bad} = 0", "count(*)", bad, "NULL")
    add("mean_between", "ChurnProbability", "avg(ChurnProbability) BETWEEN 0.6 AND 0.7", "count(*)", "NULL", "avg(ChurnProbability)")
    add("row_count", None, "count(*) BETWEEN 45000 AND 55000", "count(*)", "NULL", "count(*)")
    return " UNION ALL ".join(rows)


@query("suite_results", f"WITH {SNAP} {_suite_sql('snap')}")
def suite_results(spark, folder):
    return rounded(checks.run_suite(snapshot(spark, folder), checks.raw_data_suite()))


@query("suite_results_on_faulty_data", f"WITH {SNAP}, {FAULTY} {_suite_sql('faulty')}")
def suite_results_on_faulty_data(spark, folder):
    return rounded(checks.run_suite(faulty(spark, folder), checks.raw_data_suite()))


@query("suite_summary", f"""WITH {SNAP}, {FAULTY}, results AS ({_suite_sql('faulty')})
SELECT count(*) AS evaluated, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS unsuccessful,
       round(count(*) FILTER (WHERE success) * 100.0::DOUBLE / count(*), 6) AS success_percent, bool_and(success) AS success
FROM results""")
def suite_summary(spark, folder):
    return rounded(checks.summarize(checks.run_suite(faulty(spark, folder), checks.raw_data_suite())))


@query("suite_first_failures", f"""WITH {SNAP}, {FAULTY}, results AS ({_suite_sql('faulty')})
SELECT check_id, kind, "column", unexpected_count, CAST(count(*) OVER () - 5 AS BIGINT) AS n_more
FROM results WHERE NOT success ORDER BY check_id LIMIT 5""")
def suite_first_failures(spark, folder):
    results = checks.run_suite(faulty(spark, folder), checks.raw_data_suite())
    return checks.first_failures(results, 5).select("check_id", "kind", "column", "unexpected_count", "n_more")


@query("contract_severities", f"""WITH {SNAP}, {FAULTY}
SELECT 'Churn' AS "column", 'warning' AS severity, avg(CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END) BETWEEN 0.6 AND 0.7 AS success,
       round(avg(CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END), 6) AS observed FROM faulty
UNION ALL SELECT NULL, 'warning', count(*) BETWEEN 45000 AND 55000, count(*) FROM faulty""")
def contract_severities(spark, folder):
    results = checks.run_suite(faulty(spark, folder), checks.contract_suite())
    return rounded(results.filter("severity = 'warning'").select("column", "severity", "success", "observed"))


def _contract_ranges_sql() -> str:
    rows = []
    for c, (lo, hi) in CONTRACT_RANGES.items():
        rows.append((c, f"{c} < {lo}" + (f" OR {c} > {hi}" if hi is not None else "")))
    for c, (lo, hi) in CONTRACT_OPEN_RANGES.items():
        rows.append((c, f"{c} <= {lo} OR {c} >= {hi}"))
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {bad}) = 0 AS success, count(*) FILTER (WHERE {bad}) AS unexpected_count FROM faulty"
        for c, bad in rows)


@query("contract_ranges", f"WITH {SNAP}, {FAULTY} {_contract_ranges_sql()}")
def contract_ranges(spark, folder):
    """The contract's ranges, which differ from those of the suite and of the requests."""
    results = checks.run_suite(faulty(spark, folder), checks.contract_suite())
    return results.filter("kind = 'between'").select("column", "success", "unexpected_count")


@query("missing_cells", f"WITH {SNAP}, {FAULTY} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, CAST(0 AS BIGINT) AS infinite, "
    f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_percent FROM faulty" for c in SNAPSHOT.names))
def missing_cells(spark, folder):
    return rounded(checks.missing_cells(faulty(spark, folder)))


# 1 / (l_discount) is infinite where the discount is zero.
@query("infinite_cells", """
SELECT 'ratio' AS "column", count(*) - count(ratio) AS missing, count(*) FILTER (WHERE isinf(ratio)) AS infinite
FROM (SELECT CASE WHEN l_discount = 0 THEN CAST('inf' AS DOUBLE) ELSE 1 / l_discount END AS ratio FROM lineitem)""")
def infinite_cells(spark, folder):
    lines = table(spark, folder, "lineitem")
    ratio = F.when(F.col("l_discount") == 0, float("inf")).otherwise(1 / F.col("l_discount"))
    return checks.missing_cells(lines.select(ratio.alias("ratio"))).drop("missing_percent")


DUPLICATED = "l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"


@query("duplicate_rows", f"""
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {DUPLICATED} FROM lineitem)) AS BIGINT) AS duplicate_rows FROM lineitem""")
def duplicate_rows(spark, folder):
    return checks.duplicate_rows(table(spark, folder, "lineitem").select(*DUPLICATED.split(", ")))


@query("quality_totals", f"""WITH {SNAP}, {FAULTY}
SELECT CAST(sum({" + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in SNAPSHOT.names)}) AS BIGINT) AS missing,
       CAST(0 AS BIGINT) AS infinite,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM faulty)) AS duplicate_rows FROM faulty""")
def quality_totals(spark, folder):
    return checks.quality_totals(faulty(spark, folder))


@query("null_pattern", f"WITH {SNAP}, {FAULTY} SELECT Age IS NULL AS is_null, count(*) AS \"rows\" FROM faulty GROUP BY 1")
def null_pattern(spark, folder):
    return checks.null_pattern(faulty(spark, folder), "Age")


# Scoring requests made from the snapshot, some of them broken on purpose.
REQUESTS = """
requests AS (
  SELECT CustomerID AS customer_id,
         CASE WHEN Age = 30 THEN 'Unknown' ELSE Gender END AS gender,
         CASE WHEN Age % 19 = 4 THEN NULL WHEN Age > 70 THEN Age + 40 ELSE Age END AS age,
         CASE WHEN Age = 31 THEN -Tenure - 1 ELSE Tenure END AS tenure,
         ContractType AS contract_type, InternetService AS internet_service,
         CASE WHEN Age = 32 THEN 0.0::DOUBLE ELSE MonthlyCharges END AS monthly_charges,
         CASE Tenure % 4 WHEN 0 THEN TotalCharges * 0.25::DOUBLE WHEN 1 THEN TotalCharges * 2.5::DOUBLE ELSE TotalCharges END AS total_charges,
         CallMinutes AS call_minutes, DataUsage AS data_usage, Complaints AS complaints,
         RecentSupportTickets AS recent_support_tickets, PaymentMethod AS payment_method, LatePayments AS late_payments,
         Engagement AS engagement
  FROM snap),
field_errors AS (
  SELECT *,
    CASE WHEN gender NOT IN ('Male', 'Female') THEN 'type_error.enum' END AS e_gender,
    CASE WHEN age IS NULL THEN 'value_error.missing' WHEN age < 18 THEN 'value_error.number.not_ge' WHEN age > 100 THEN 'value_error.number.not_le' END AS e_age,
    CASE WHEN tenure < 0 THEN 'value_error.number.not_ge' WHEN tenure > 100 THEN 'value_error.number.not_le' END AS e_tenure,
    CASE WHEN monthly_charges IS NULL THEN 'value_error.missing' WHEN monthly_charges < 0 THEN 'value_error.number.not_ge' WHEN monthly_charges > 200 THEN 'value_error.number.not_le' WHEN monthly_charges <= 0 THEN 'value_error' END AS e_monthly_charges,
    CASE WHEN total_charges IS NULL THEN 'value_error.missing' WHEN total_charges < 0 THEN 'value_error.number.not_ge' WHEN total_charges > 10000 THEN 'value_error.number.not_le' END AS f_total,
    CASE WHEN engagement > 2 THEN 'value_error.number.not_le' END AS e_engagement,
    CASE WHEN data_usage > 1000 THEN 'value_error.number.not_le' END AS e_data_usage
  FROM requests),
judged AS (
  SELECT *,
    CASE WHEN f_total IS NOT NULL THEN f_total
         WHEN e_tenure IS NOT NULL OR e_monthly_charges IS NOT NULL THEN NULL
         WHEN tenure = 0 THEN CASE WHEN total_charges > 2 * monthly_charges THEN 'value_error' END
         WHEN total_charges < tenure * monthly_charges * 0.5::DOUBLE THEN 'value_error'
         WHEN total_charges > tenure * monthly_charges * 1.5::DOUBLE THEN 'value_error' END AS e_total_charges,
    CASE WHEN internet_service = 'No Service' AND e_data_usage IS NULL AND data_usage > 0 THEN 'value_error' END AS e_root
  FROM field_errors),
errors AS (
  SELECT customer_id, 'gender' AS field, e_gender AS type FROM judged WHERE e_gender IS NOT NULL
  UNION ALL SELECT customer_id, 'age', e_age FROM judged WHERE e_age IS NOT NULL
  UNION ALL SELECT customer_id, 'tenure', e_tenure FROM judged WHERE e_tenure IS NOT NULL
  UNION ALL SELECT customer_id, 'monthly_charges', e_monthly_charges FROM judged WHERE e_monthly_charges IS NOT NULL
  UNION ALL SELECT customer_id, 'total_charges', e_total_charges FROM judged WHERE e_total_charges IS NOT NULL
  UNION ALL SELECT customer_id, 'data_usage', e_data_usage FROM judged WHERE e_data_usage IS NOT NULL
  UNION ALL SELECT customer_id, 'engagement', e_engagement FROM judged WHERE e_engagement IS NOT NULL
  UNION ALL SELECT customer_id, '__root__', e_root FROM judged WHERE e_root IS NOT NULL),
accepted AS (SELECT * FROM requests WHERE customer_id NOT IN (SELECT customer_id FROM errors))"""


def requests(spark, folder):
    age, tenure, total = F.col("age"), F.col("tenure"), F.col("total_charges")
    plain = shaping.snapshot_to_requests(snapshot(spark, folder))
    return plain.select(*[{
        "gender": F.when(age == 30, "Unknown").otherwise(F.col("gender")),
        "age": F.when(age % 19 == 4, None).when(age > 70, age + 40).otherwise(age),
        "tenure": F.when(age == 31, -tenure - 1).otherwise(tenure),
        "monthly_charges": F.when(age == 32, 0.0).otherwise(F.col("monthly_charges")),
        "total_charges": F.when(tenure % 4 == 0, total * 0.25).when(tenure % 4 == 1, total * 2.5).otherwise(total),
    }.get(c, F.col(c)).alias(c) for c in REQUEST.names])


@query("request_rejects", f"""WITH {SNAP}, {REQUESTS}
SELECT customer_id, CAST(count(*) OVER (PARTITION BY customer_id) AS INTEGER) AS error_count, field, type FROM errors""")
def request_rejects(spark, folder):
    return rules.rejects(rules.check_requests(requests(spark, folder))).select("customer_id", "error_count", "field", "type")


@query("request_accepted", f"WITH {SNAP}, {REQUESTS} SELECT * FROM accepted")
def request_accepted(spark, folder):
    return rules.accept(rules.check_requests(requests(spark, folder)))[0]


@query("request_error_summary", f"WITH {SNAP}, {REQUESTS} SELECT field, type, count(*) AS errors FROM errors GROUP BY 1, 2")
def request_error_summary(spark, folder):
    return rules.error_summary(rules.check_requests(requests(spark, folder)))


@query("request_soft_signals", f"""WITH {SNAP}, {REQUESTS}
SELECT customer_id, contract_type = 'Two Year' AND tenure < 3 AS new_two_year,
       contract_type = 'Month-to-Month' AND tenure > 60 AS long_monthly,
       monthly_charges > 80 AND engagement < 0.5 AS pays_much_uses_little,
       call_minutes = 0 AND data_usage = 0 AND engagement > 1.5 AS engaged_without_usage
FROM accepted""")
def request_soft_signals(spark, folder):
    valid = rules.valid_rows(rules.check_requests(requests(spark, folder)))
    return rules.soft_signals(valid).select(
        "customer_id", "new_two_year", "long_monthly", "pays_much_uses_little", "engaged_without_usage")


@query("request_batches_refused", f"""WITH {SNAP}, {REQUESTS}
SELECT CASE WHEN r.customer_id LIKE '%0_' THEN 'large' ELSE right(r.customer_id, 2) END AS batch, CAST(count(DISTINCT r.customer_id) AS BIGINT) AS records,
       CAST(count(DISTINCT e.customer_id) AS BIGINT) AS invalid,
       count(DISTINCT e.customer_id) = 0 AND count(DISTINCT r.customer_id) <= 100 AS accepted
FROM requests r LEFT JOIN errors e ON r.customer_id = e.customer_id GROUP BY 1""")
def request_batches_refused(spark, folder):
    """All or nothing: a batch with any invalid record, or with too many, is refused."""
    checked = rules.check_requests(requests(spark, folder))
    batch = F.when(F.col("customer_id").like("%0_"), "large").otherwise(F.right("customer_id", F.lit(2)))
    return rules.judge_batches(checked.withColumn("batch", batch), "batch", 100)
