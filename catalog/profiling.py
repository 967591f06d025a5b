"""Profiling queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.base import LINES, SNAP, engineered_sql, query, rounded
from ebbtide.operators import profile
from ebbtide.operators.transformers import FeatureEngineer
from ebbtide.schema import FEATURES
from ebbtide.session import work_path
from ebbtide.sources import sinks
from ebbtide.sources.snapshot import scored_customers, snapshot, table

NUMERIC = ["Age", "Tenure", "MonthlyCharges", "TotalCharges", "CallMinutes", "DataUsage", "Complaints",
           "RecentSupportTickets", "LatePayments", "Engagement", "ChurnProbability"]
LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("value_counts_of_churn", f"""WITH {SNAP}
SELECT Churn AS value, count(*) AS "rows", round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM snap GROUP BY Churn""")
def value_counts_of_churn(spark, folder):
    return rounded(profile.value_counts(snapshot(spark, folder), "Churn"))


@query("value_counts_of_parts", """
SELECT l_partkey AS value, count(*) AS "rows", round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM lineitem GROUP BY 1""")
def value_counts_of_parts(spark, folder):
    return rounded(profile.value_counts(table(spark, folder, "lineitem"), "l_partkey"))


def _describe_sql(source, columns, by=""):
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {head}'{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
        f"round(quantile_cont({c}, 0.75), 6) AS p75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {source} {group}" for c in columns)


@query("describe_customers", f"WITH {SNAP} {_describe_sql('snap', NUMERIC)}")
def describe_customers(spark, folder):
    return rounded(profile.describe(snapshot(spark, folder), NUMERIC))


@query("describe_by_churn", f"WITH {SNAP} {_describe_sql('snap', NUMERIC, 'Churn')}")
def describe_by_churn(spark, folder):
    return rounded(profile.describe(snapshot(spark, folder), NUMERIC, ("Churn",)))


@query("describe_lines", _describe_sql("lineitem", LINE_MEASURES))
def describe_lines(spark, folder):
    return rounded(profile.describe(table(spark, folder, "lineitem"), LINE_MEASURES))


@query("cross_tab_contract", f"""WITH {SNAP}
SELECT ContractType, round(count(*) FILTER (WHERE Churn = 'No') / CAST(count(*) AS DOUBLE), 6) AS No,
       round(count(*) FILTER (WHERE Churn = 'Yes') / CAST(count(*) AS DOUBLE), 6) AS Yes FROM snap GROUP BY 1""")
def cross_tab_contract(spark, folder):
    return rounded(profile.cross_tab(snapshot(spark, folder), "ContractType", "Churn", ["No", "Yes"]))


@query("churn_rate_by_category", f"WITH {SNAP} " + " UNION ALL ".join(
    f"SELECT '{c}' AS category, {c} AS value, count(*) AS \"rows\", round(avg(CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END) * 100, 6) AS rate FROM snap GROUP BY {c}"
    for c in ("ContractType", "InternetService", "PaymentMethod")))
def churn_rate_by_category(spark, folder):
    df = snapshot(spark, folder)
    parts = [profile.rate_by(df, c).withColumn("category", F.lit(c)) for c in ("ContractType", "InternetService", "PaymentMethod")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _correlations_sql(source, pairs, digits=6):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN isnan(corr(CAST(\"{a}\" AS DOUBLE), CAST(\"{b}\" AS DOUBLE))) THEN NULL ELSE corr(CAST(\"{a}\" AS DOUBLE), CAST(\"{b}\" AS DOUBLE)) END, {digits}) + 0.0 AS correlation FROM {source}"
        for a, b in pairs)


@query("correlation_matrix", f"WITH {SNAP} {_correlations_sql('snap', [(a, b) for a in NUMERIC for b in NUMERIC])}")
def correlation_matrix(spark, folder):
    return rounded(profile.correlation_matrix(snapshot(spark, folder), NUMERIC))


@query("target_correlation", f"""WITH {SNAP}, {engineered_sql('snap', 'snap')},
pairs AS ({_correlations_sql('feat', [(f, 'Churn') for f in FEATURES])})
SELECT a AS feature, correlation FROM pairs""")
def target_correlation(spark, folder):
    df = snapshot(spark, folder)
    features = FeatureEngineer().fit(df).transform(df)
    return rounded(profile.target_correlation(features, FEATURES, "Churn"))


@query("target_correlation_top", f"""WITH {SNAP}, pairs AS ({_correlations_sql('scored', [(c, 'label') for c in NUMERIC])})
SELECT a AS feature, correlation FROM pairs ORDER BY abs(correlation) DESC, a LIMIT 5""")
def target_correlation_top(spark, folder):
    return rounded(profile.target_correlation(scored_customers(spark, folder), NUMERIC, "label", 5))


@query("correlation_written", f"WITH {SNAP}, pairs AS ({_correlations_sql('scored', [(c, 'label') for c in NUMERIC])}) SELECT a AS feature, correlation FROM pairs")
def correlation_written(spark, folder):
    """The correlation table as its sink leaves it."""
    path = work_path(spark, "correlations")
    sinks.write_table(profile.target_correlation(scored_customers(spark, folder), NUMERIC, "label"), path)
    return rounded(spark.read.parquet(path))


@query("feature_redundancy", f"""WITH {SNAP}, pairs AS ({_correlations_sql('snap', list(combinations(NUMERIC, 2)), 15)})
SELECT a, b, round(1 - abs(correlation), 6) AS distance FROM pairs""")
def feature_redundancy(spark, folder):
    return rounded(profile.redundancy(snapshot(spark, folder), NUMERIC))


@query("column_extremes", f"WITH {SNAP} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM snap" for c in NUMERIC))
def column_extremes(spark, folder):
    return profile.extremes(snapshot(spark, folder), NUMERIC)


def _bounds_sql(source, columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lower, "
        f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS upper FROM {source}" for c in columns)


OUTLIER_COLUMNS = ["MonthlyCharges", "TotalCharges", "CallMinutes"]


@query("outlier_counts", f"WITH {SNAP}, bounds AS ({_bounds_sql('snap', OUTLIER_COLUMNS)}) " + " UNION ALL ".join(
    f"SELECT \"column\", round(lower, 6) AS lower, round(upper, 6) AS upper, "
    f"(SELECT count(*) FROM snap WHERE {c} < lower OR {c} > upper) AS outliers, "
    f"round((SELECT count(*) FROM snap WHERE {c} < lower OR {c} > upper) * 100.0::DOUBLE / (SELECT count(*) FROM snap), 6) AS percent "
    f"FROM bounds WHERE \"column\" = '{c}'" for c in OUTLIER_COLUMNS))
def outlier_counts(spark, folder):
    return rounded(profile.outlier_counts(snapshot(spark, folder), OUTLIER_COLUMNS))


@query("outlier_rows", f"""WITH {SNAP}, bounds AS ({_bounds_sql('snap', ['MonthlyCharges'])})
SELECT CustomerID, MonthlyCharges FROM snap, bounds WHERE MonthlyCharges < lower OR MonthlyCharges > upper""")
def outlier_rows(spark, folder):
    return profile.outliers(snapshot(spark, folder), "MonthlyCharges").select("CustomerID", "MonthlyCharges")


def _bin_sql(x, lo, hi, n):
    guess = f"greatest(0, least(floor(({x} - {lo}) / (({hi} - {lo}) / {n}.0::DOUBLE)), {n - 1}))"
    step = f"(({hi} - {lo}) / {n}.0::DOUBLE)"
    return (f"CAST({guess} - CASE WHEN {x} < {lo} + {guess} * {step} THEN 1 ELSE 0 END "
            f"+ CASE WHEN {x} >= {lo} + ({guess} + 1) * {step} AND {guess} < {n - 1} THEN 1 ELSE 0 END AS BIGINT)")


def _histogram_sql(source, columns, n, by=""):
    head, group = (f"{by}, ", f", {by}") if by else ("", "")
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return " UNION ALL ".join(
        f"SELECT {head}'{c}' AS \"column\", {_bin_sql('x', 'lo', 'hi', n)} AS bin, count(*) AS \"rows\" "
        f"FROM (SELECT {head}CAST({c} AS DOUBLE) AS x, CAST(min({c}) {over} AS DOUBLE) AS lo, CAST(max({c}) {over} AS DOUBLE) AS hi FROM {source}) "
        f"GROUP BY bin{group}" for c in columns)


@query("histograms", f"WITH {SNAP} {_histogram_sql('snap', NUMERIC, 50)}")
def histograms(spark, folder):
    return profile.histogram(snapshot(spark, folder), NUMERIC, 50)


@query("histograms_by_churn", f"WITH {SNAP} {_histogram_sql('snap', ['MonthlyCharges', 'Tenure'], 30, 'Churn')}")
def histograms_by_churn(spark, folder):
    return profile.histogram(snapshot(spark, folder), ["MonthlyCharges", "Tenure"], 30, ("Churn",))


@query("histograms_of_lines", _histogram_sql("lineitem", LINE_MEASURES, 50))
def histograms_of_lines(spark, folder):
    return profile.histogram(table(spark, folder, "lineitem"), LINE_MEASURES, 50)


def _five_sql(source, columns, by=""):
    head, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(
        f"SELECT {head}'{c}' AS \"column\", round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, "
        f"round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {source} {group}"
        for c in columns)


@query("five_number_summary", f"WITH {SNAP} {_five_sql('snap', NUMERIC)}")
def five_number_summary(spark, folder):
    return rounded(profile.five_numbers(snapshot(spark, folder), NUMERIC))


@query("five_numbers_by_churn", f"WITH {SNAP} {_five_sql('snap', ['MonthlyCharges', 'Tenure'], 'Churn')}")
def five_numbers_by_churn(spark, folder):
    return rounded(profile.five_numbers(snapshot(spark, folder), ["MonthlyCharges", "Tenure"], ("Churn",)))


@query("class_balance", f"""WITH {SNAP}, {LINES}, labelled AS (SELECT 'customers' AS source, label FROM scored UNION ALL SELECT 'lines', label FROM lines)
SELECT source, count(*) FILTER (WHERE label = 0) AS negatives, count(*) FILTER (WHERE label = 1) AS positives,
       round(count(*) FILTER (WHERE label = 0) / CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE), 6) AS ratio, round(avg(label), 6) AS positive_share
FROM labelled GROUP BY source""")
def class_balance(spark, folder):
    from ebbtide.sources.snapshot import scored_lines
    parts = [profile.class_balance(df).withColumn("source", F.lit(n))
             for n, df in (("customers", scored_customers(spark, folder)), ("lines", scored_lines(spark, folder)))]
    return rounded(parts[0].unionByName(parts[1]))


@query("feature_table_shape", f"WITH {SNAP} SELECT count(*) AS \"rows\", any_value(n) AS columns FROM snap, "
       f"(SELECT CAST(count(*) AS INTEGER) AS n FROM (DESCRIBE WITH {SNAP}, {engineered_sql('snap', 'snap')} SELECT * FROM feat))")
def feature_table_shape(spark, folder):
    df = snapshot(spark, folder)
    return profile.shape(FeatureEngineer().fit(df).transform(df))


def _profile_sql(source):
    numbers = [f"SELECT '{c}' AS \"column\", 'mean' AS statistic, CAST(avg({c}) AS DOUBLE) AS value FROM {source} "
               f"UNION ALL SELECT '{c}', 'std', stddev_samp({c}) FROM {source}" for c in ("Age", "MonthlyCharges")]
    shares = [f"SELECT '{c}', 'share:' || {c}, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) FROM {source} GROUP BY {c}"
              for c in ("ContractType", "PaymentMethod")]
    return " UNION ALL ".join(numbers + shares)


@query("feature_profile", f"WITH {SNAP}, p AS ({_profile_sql('snap')}) SELECT \"column\", statistic, round(value, 6) AS value FROM p")
def feature_profile(spark, folder):
    return rounded(profile.feature_profile(snapshot(spark, folder), ["Age", "MonthlyCharges"], ["ContractType", "PaymentMethod"]))


@query("profile_drift", f"""WITH {SNAP}, early AS (SELECT * FROM snap WHERE Tenure < 36), late AS (SELECT * FROM snap WHERE Tenure >= 36),
a AS ({_profile_sql('early')}), b AS ({_profile_sql('late')})
SELECT "column", statistic, round(a.value, 6) AS baseline, round(b.value, 6) AS current, round(b.value - a.value, 6) + 0.0 AS change
FROM a FULL JOIN b USING ("column", statistic)""")
def profile_drift(spark, folder):
    df = snapshot(spark, folder)
    columns = (["Age", "MonthlyCharges"], ["ContractType", "PaymentMethod"])
    old, new = (profile.feature_profile(df.filter(c), *columns) for c in ("Tenure < 36", "Tenure >= 36"))
    return rounded(profile.profile_drift(old, new))
