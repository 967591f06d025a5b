"""Sources, shaping and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SNAP, SPLIT, engineered_sql, query, rounded
from ebbtide.functions import features as fx
from ebbtide.functions import scorecard
from ebbtide.operators import impute, shaping, split
from ebbtide.operators import transformers as tf
from ebbtide.operators.transformers import FeatureEngineer, FeatureEngineerModel
from ebbtide.plans import jobs
from ebbtide.schema import ID, REQUEST_TO_SNAPSHOT, SNAPSHOT, numeric_columns, text_columns
from ebbtide.session import work_path
from ebbtide.sources import files, sinks
from ebbtide.sources.snapshot import snapshot


@query("customer_snapshot", f"WITH {SNAP} SELECT * FROM snap")
def customer_snapshot(spark, folder):
    return snapshot(spark, folder)


@query("snapshot_csv_round_trip", f"WITH {SNAP} SELECT * FROM snap")
def snapshot_csv_round_trip(spark, folder):
    path = work_path(spark, "snapshot-csv")
    sinks.write_table(snapshot(spark, folder), path, "csv")
    return files.read_snapshot(spark, path)


@query("snapshot_text_casts", f"WITH {SNAP} SELECT * FROM snap")
def snapshot_text_casts(spark, folder):
    path = work_path(spark, "snapshot-text")
    sinks.write_table(snapshot(spark, folder), path, "csv")
    return files.cast_columns(files.read_text_snapshot(spark, path))


@query("asset_batches", f"""WITH {SNAP}
SELECT CAST(3 AS BIGINT) AS assets, count(*) AS "rows" FROM snap""")
def asset_batches(spark, folder):
    """Three files as three assets, every row tagged with the asset it came from."""
    path = work_path(spark, "assets")
    snapshot(spark, folder).repartition(3).write.option("header", True).csv(path)
    listed = files.list_assets(spark, path)
    tagged = files.with_batch_id(files.read_snapshot(spark, path))
    known = tagged.join(listed.select(F.col("asset").alias("batch_id")), "batch_id", "left_semi")
    return known.agg(F.countDistinct("batch_id").alias("assets"), F.count("*").alias("rows"))


THIRD = "CAST('0x' || substr(md5(CustomerID), 1, 6) AS INTEGER) % 3"


@query("latest_asset_rows", f"WITH {SNAP} SELECT * FROM snap WHERE {THIRD} = 2")
def latest_asset_rows(spark, folder):
    """Three files by a hash of the id; the last one is read."""
    path = work_path(spark, "assets")
    third = (F.conv(F.substring(F.md5(F.col(ID).cast("binary")), 1, 6), 16, 10).cast("int") % 3).alias("third")
    rows = snapshot(spark, folder).select("*", third)
    # With more ranges than values each value has a range, and so a file, of its own.
    rows.repartitionByRange(12, "third").drop("third").write.option("header", True).csv(path)
    return files.read_snapshot(spark, files.latest_asset(spark, path))


RENAMED = ", ".join(f"{c} AS {f}" for f, c in REQUEST_TO_SNAPSHOT.items())


@query("request_rename", f"WITH {SNAP} SELECT {', '.join(REQUEST_TO_SNAPSHOT.values())} FROM snap")
def request_rename(spark, folder):
    return shaping.requests_to_snapshot(shaping.snapshot_to_requests(snapshot(spark, folder)))


@query("snapshot_as_requests", f"""WITH {SNAP}
SELECT CustomerID AS customer_id, Gender AS gender, Age AS age, Tenure AS tenure, ContractType AS contract_type,
       InternetService AS internet_service, MonthlyCharges AS monthly_charges, TotalCharges AS total_charges, CallMinutes AS call_minutes,
       DataUsage AS data_usage, Complaints AS complaints, RecentSupportTickets AS recent_support_tickets, PaymentMethod AS payment_method,
       LatePayments AS late_payments, Engagement AS engagement FROM snap""")
def snapshot_as_requests(spark, folder):
    """The names of request fields, each with its values."""
    return shaping.snapshot_to_requests(snapshot(spark, folder))


@query("request_batches_exploded", f"""WITH {SNAP}
SELECT customer_id, CAST(right(customer_id, 6) AS BIGINT) // 50 AS batch, age, contract_type, monthly_charges
FROM (SELECT {RENAMED} FROM snap)""")
def request_batches_exploded(spark, folder):
    """Requests packed into JSON bodies of 50 records, then unpacked and typed again."""
    plain = shaping.snapshot_to_requests(snapshot(spark, folder))
    number = F.regexp_extract("customer_id", r"(\d+)$", 1).cast("long")
    bodies = plain.withColumn("batch", F.floor(number / 50)).groupBy("batch").agg(
        F.to_json(F.struct(F.collect_list(F.struct(*plain.columns)).alias("customers"))).alias("body"))
    rows = files.explode_batches(bodies)
    return rows.select("customer_id", "batch", F.col("age").cast("long").alias("age"), "contract_type",
                       F.col("monthly_charges").cast("double").alias("monthly_charges"))


@query("columns_by_type", f"WITH {SNAP} SELECT CAST(sum(Age + Tenure + Complaints) AS BIGINT) AS whole_numbers, "
       f"CAST(any_value(numbers) AS INTEGER) AS numeric_columns, CAST(any_value(texts) AS INTEGER) AS text_columns FROM snap, "
       f"(SELECT count(*) FILTER (WHERE column_type <> 'VARCHAR') AS numbers, count(*) FILTER (WHERE column_type = 'VARCHAR') AS texts "
       f"FROM (DESCRIBE WITH {SNAP} SELECT * FROM snap))")
def columns_by_type(spark, folder):
    df = snapshot(spark, folder)
    return df.agg(F.sum(F.col("Age") + F.col("Tenure") + F.col("Complaints")).alias("whole_numbers"),
                  F.lit(len(numeric_columns(df))).alias("numeric_columns"), F.lit(len(text_columns(df))).alias("text_columns"))


@query("columns_dropped", f"WITH {SNAP} SELECT * EXCLUDE (CallMinutes, DataUsage, ChurnProbability) FROM snap")
def columns_dropped(spark, folder):
    return tf.ColumnDropper(["CallMinutes", "DataUsage", "ChurnProbability", "NotThere"]).transform(snapshot(spark, folder))


@query("target_split_off", f"WITH {SNAP} SELECT * EXCLUDE (Churn), Churn AS target FROM snap")
def target_split_off(spark, folder):
    df = snapshot(spark, folder)
    columns, target = shaping.split_target(df)
    return df.select(*columns, F.col(target).alias("target"))


@query("columns_wrapped", f"WITH {SNAP} SELECT * REPLACE (MonthlyCharges * 2 AS MonthlyCharges) FROM snap")
def columns_wrapped(spark, folder):
    return tf.ColumnExpressions({"MonthlyCharges": "MonthlyCharges * 2"}).transform(snapshot(spark, folder))


@query("negative_usage_rows", f"WITH {SNAP} SELECT CustomerID, usage_change FROM (SELECT CustomerID, DataUsage - 1.0::DOUBLE AS usage_change FROM snap) WHERE usage_change < 0")
def negative_usage_rows(spark, folder):
    return snapshot(spark, folder).select("CustomerID", (F.col("DataUsage") - 1.0).alias("usage_change")).filter(F.col("usage_change") < 0)


BUCKET = """CASE WHEN Tenure >= 0 AND Tenure <= 6 THEN 'New' WHEN Tenure > 6 AND Tenure <= 12 THEN 'Growing'
WHEN Tenure > 12 AND Tenure <= 24 THEN 'Established' WHEN Tenure > 24 AND Tenure <= 60 THEN 'Loyal'
WHEN Tenure > 60 AND Tenure <= 100 THEN 'Veteran' END"""


@query("tenure_buckets", f"WITH {SNAP} SELECT CustomerID, {BUCKET} AS TenureBucket FROM snap")
def tenure_buckets(spark, folder):
    return tf.TenureBucketer(encode_onehot=False).transform(snapshot(spark, folder)).select("CustomerID", "TenureBucket")


@query("engineered_flags", f"""WITH {SNAP}
SELECT CustomerID, round(MonthlyCharges / CASE InternetService WHEN 'No Service' THEN 2 ELSE 3 END, 6) AS PricePerService,
       CASE WHEN Tenure < 12 AND MonthlyCharges > (SELECT quantile_cont(MonthlyCharges, 0.5) FROM snap) AND RecentSupportTickets = 1 THEN 1 ELSE 0 END AS IsHighRisk,
       CASE WHEN ContractType = 'Month-to-Month' AND Tenure > 24 THEN 1 ELSE 0 END AS ContractTenureMismatch,
       LatePayments + 0.5::DOUBLE * Complaints AS FinancialStress
FROM snap""")
def engineered_flags(spark, folder):
    df = snapshot(spark, folder)
    risk = tf.HighRisk().fit(df)
    for stage in (tf.PricePerService(), risk, tf.ContractTenureMismatch(), tf.FinancialStress()):
        df = stage.transform(df)
    return rounded(df.select("CustomerID", "PricePerService", "IsHighRisk", "ContractTenureMismatch", "FinancialStress"))


@query("encoded_categories", f"""WITH {SNAP}
SELECT CustomerID, CASE Gender WHEN 'Female' THEN 0 ELSE 1 END AS Gender,
       CASE WHEN ContractType = 'One Year' THEN 1 ELSE 0 END AS "ContractType_One Year",
       CASE WHEN ContractType = 'Two Year' THEN 1 ELSE 0 END AS "ContractType_Two Year",
       CASE WHEN PaymentMethod = 'Credit Card' THEN 1 ELSE 0 END AS "PaymentMethod_Credit Card",
       CASE WHEN PaymentMethod = 'Debit Card' THEN 1 ELSE 0 END AS "PaymentMethod_Debit Card",
       CASE WHEN PaymentMethod = 'UPI' THEN 1 ELSE 0 END AS "PaymentMethod_UPI"
FROM snap""")
def encoded_categories(spark, folder):
    """PaymentMethod has no declared list here, so its categories come from the rows."""
    df = snapshot(spark, folder).select("CustomerID", "Gender", "ContractType", "PaymentMethod")
    one_hot = {"ContractType": {"categories": ["Month-to-Month", "One Year", "Two Year"]}, "PaymentMethod": {}}
    return tf.CategoricalEncoder({"Gender": {}}, one_hot).fit(df).transform(df)


@query("encoded_by_mapping", f"WITH {SNAP} SELECT CustomerID, CASE Gender WHEN 'Male' THEN 0 ELSE 1 END AS Gender FROM snap")
def encoded_by_mapping(spark, folder):
    df = snapshot(spark, folder).select("CustomerID", "Gender")
    spec = {"Gender": {"mapping": {"Male": 0, "Female": 1}, "use_mapping": True}}
    return tf.CategoricalEncoder(spec).fit(df).transform(df)


@query("many_labels_encoded", f"WITH {SNAP} SELECT CAST(row_number() OVER (ORDER BY CustomerID) - 1 AS INTEGER) AS CustomerID, Age FROM snap")
def many_labels_encoded(spark, folder):
    """A label for every customer: as many codes as rows."""
    df = snapshot(spark, folder).select("CustomerID", "Age")
    return tf.CategoricalEncoder({"CustomerID": {}}).fit(df).transform(df)


SCALED = ["Age", "Tenure", "MonthlyCharges", "Engagement"]


def _scaled(spark, folder, method):
    df = snapshot(spark, folder).select("CustomerID", *SCALED)
    return rounded(tf.NumericScaler(SCALED, method).fit(df).transform(df))


def _scaled_sql(center, scale):
    return f"WITH {SNAP} SELECT CustomerID, " + ", ".join(
        f"round(({c} - (SELECT {center.format(c=c)} FROM snap)) / (SELECT {scale.format(c=c)} FROM snap), 6) + 0.0 AS {c}"
        for c in SCALED) + " FROM snap"


@query("scaled_standard", _scaled_sql("avg({c})", "stddev_pop({c})"))
def scaled_standard(spark, folder):
    return _scaled(spark, folder, "standard")


@query("scaled_minmax", _scaled_sql("min({c})", "(max({c}) - min({c}))"))
def scaled_minmax(spark, folder):
    return _scaled(spark, folder, "minmax")


@query("scaled_robust", _scaled_sql("quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def scaled_robust(spark, folder):
    return _scaled(spark, folder, "robust")


@query("target_encoded", f"WITH {SNAP} SELECT CustomerID, CASE Churn WHEN 'Yes' THEN 1 ELSE 0 END AS Churn FROM snap")
def target_encoded(spark, folder):
    df = snapshot(spark, folder).select("CustomerID", "Churn")
    return tf.TargetEncoder().fit(df).transform(df)


@query("stratified_split", f"WITH {SNAP}, {SPLIT} SELECT CustomerID, Churn, split FROM parted")
def stratified_split(spark, folder):
    return split.stratified_split(snapshot(spark, folder), ID, "Churn").select("CustomerID", "Churn", "split")


@query("feature_table", f"WITH {SNAP}, {engineered_sql('snap', 'snap')} SELECT * FROM feat")
def feature_table(spark, folder):
    df = snapshot(spark, folder)
    return rounded(FeatureEngineer().fit(df).transform(df))


@query("features_fitted_on_train", f"""WITH {SNAP}, {SPLIT}, {engineered_sql('parted', "parted WHERE split = 'train'")}
SELECT feat.*, split FROM feat JOIN (SELECT CustomerID, split FROM parted) USING (CustomerID)""")
def features_fitted_on_train(spark, folder):
    """Fit on the training part only, apply to both, written as one table partitioned by split."""
    path = work_path(spark, "features")
    jobs.build_features(snapshot(spark, folder), path)
    return rounded(spark.read.parquet(path))


@query("feature_pipeline_reloaded", f"WITH {SNAP}, {engineered_sql('snap', 'snap')} SELECT * FROM feat")
def feature_pipeline_reloaded(spark, folder):
    df = snapshot(spark, folder)
    path = work_path(spark, "feature-pipeline")
    FeatureEngineer().fit(df).write().overwrite().save(path)
    return rounded(FeatureEngineerModel.load(path).transform(df))


@query("categories_overlaid", f"""WITH {SNAP}
SELECT CustomerID, CASE WHEN InternetService = 'Fiber' THEN 1 ELSE 0 END AS InternetService_Fiber,
       CASE WHEN InternetService = 'No Service' THEN 1 ELSE 0 END AS "InternetService_No Service", 0 AS InternetService_Satellite
FROM snap""")
def categories_overlaid(spark, folder):
    """A declared category list replaces the one saved with the pipeline."""
    df = snapshot(spark, folder)
    model = FeatureEngineer().fit(df)
    declared = {"InternetService": {"categories": ["Satellite", "DSL", "Fiber", "No Service"]}}
    pipeline, _ = tf.overlay_categories(model.pipeline, declared)
    return pipeline.transform(df).select(
        "CustomerID", "InternetService_Fiber", F.col("InternetService_No Service"), "InternetService_Satellite")


@query("scorecard_probability", f"""WITH {SNAP}
SELECT CustomerID, round(logit, 6) + 0.0 AS logit, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)), 6) AS probability FROM logits""")
def scorecard_probability(spark, folder):
    return rounded(snapshot(spark, folder).select(
        "CustomerID", scorecard.logit().alias("logit"), scorecard.probability().alias("probability")))


@query("derived_measures", f"""WITH {SNAP}
SELECT CustomerID, round(MonthlyCharges * greatest(1, Tenure), 2) AS TotalCharges,
       round(greatest(CallMinutes - 300, 0) / 1000.0::DOUBLE + greatest(DataUsage - 5, 0) / 10.0::DOUBLE, 2) AS Engagement,
       greatest(CallMinutes - 300, 0) AS CallMinutes
FROM snap""")
def derived_measures(spark, folder):
    minutes, gigabytes = F.col("CallMinutes") - 300, F.col("DataUsage") - 5
    return snapshot(spark, folder).select(
        "CustomerID", fx.total_charges(F.col("MonthlyCharges"), F.col("Tenure")).alias("TotalCharges"),
        fx.engagement(minutes, gigabytes).alias("Engagement"), fx.clip(minutes, 0).alias("CallMinutes"))


@query("interaction_features", f"""WITH {SNAP}
SELECT CustomerID, CASE WHEN ContractType = 'Month-to-Month' THEN Tenure ELSE 0 END AS MonthlyContractTenure,
       RecentSupportTickets * Complaints AS SupportIntensity,
       CASE WHEN Engagement < 1 AND MonthlyCharges > 70 THEN 1 ELSE 0 END AS EngagementDrop,
       round(Tenure * MonthlyCharges, 6) AS TenureCharges
FROM snap""")
def interaction_features(spark, folder):
    return rounded(tf.Interactions().transform(snapshot(spark, folder)).select(
        "CustomerID", "MonthlyContractTenure", "SupportIntensity", "EngagementDrop", "TenureCharges"))


GAPS = """
gaps AS (
  SELECT CustomerID, CASE WHEN Tenure % 13 <> 1 THEN Age END AS Age, CASE WHEN Age % 5 <> 2 THEN MonthlyCharges END AS MonthlyCharges,
         CASE WHEN Age % 7 <> 3 THEN Complaints END AS Complaints, CASE WHEN Tenure % 3 <> 2 THEN PaymentMethod END AS PaymentMethod,
         CASE WHEN Age % 11 <> 5 THEN InternetService END AS InternetService
  FROM snap)"""


def gaps(spark, folder):
    age, tenure = F.col("Age"), F.col("Tenure")
    return snapshot(spark, folder).select(
        "CustomerID", F.when(tenure % 13 != 1, age).alias("Age"),
        F.when(age % 5 != 2, F.col("MonthlyCharges")).alias("MonthlyCharges"),
        F.when(age % 7 != 3, F.col("Complaints")).alias("Complaints"),
        F.when(tenure % 3 != 2, F.col("PaymentMethod")).alias("PaymentMethod"),
        F.when(age % 11 != 5, F.col("InternetService")).alias("InternetService"))


@query("missing_values_filled", f"""WITH {SNAP}, {GAPS}, kept AS (SELECT * FROM gaps WHERE Age IS NOT NULL)
SELECT CustomerID, Age, round(coalesce(MonthlyCharges, (SELECT quantile_cont(MonthlyCharges, 0.5) FROM kept)), 6) AS MonthlyCharges,
       coalesce(Complaints, 0) AS Complaints,
       coalesce(PaymentMethod, (SELECT PaymentMethod FROM kept WHERE PaymentMethod IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS PaymentMethod,
       coalesce(InternetService, 'No Service') AS InternetService,
       CASE WHEN MonthlyCharges IS NULL THEN 1 ELSE 0 END AS MonthlyCharges_was_missing,
       CASE WHEN Complaints IS NULL THEN 1 ELSE 0 END AS Complaints_was_missing,
       CASE WHEN PaymentMethod IS NULL THEN 1 ELSE 0 END AS PaymentMethod_was_missing,
       CASE WHEN InternetService IS NULL THEN 1 ELSE 0 END AS InternetService_was_missing
FROM kept""")
def missing_values_filled(spark, folder):
    df = gaps(spark, folder)
    return rounded(impute.Imputer().fit(df).transform(df))


NARROW = ("IsHighRisk", "PaymentMethod_UPI", "ContractTenureMismatch", "Age", "Gender")
LEAST_VARIANCES = (0.001, 0.1, 0.24)


@query("low_variance_removed", f"""WITH {SNAP}, {engineered_sql('snap', 'snap')}
SELECT least, "column", n FROM (""" + " UNION ALL ".join(
    f"SELECT {t}::DOUBLE AS least, '{c}' AS \"column\", count(\"{c}\") AS n, var_pop(\"{c}\") AS spread FROM feat" for t in LEAST_VARIANCES for c in NARROW)
    + f""" UNION ALL SELECT least, 'Constant', count(*), 0 FROM feat, (VALUES {', '.join(f"({t}::DOUBLE)" for t in LEAST_VARIANCES)}) AS t(least) GROUP BY 1)
WHERE spread > least""")
def low_variance_removed(spark, folder):
    """The columns that are left at each of three limits, with their values counted."""
    df = snapshot(spark, folder)
    table = FeatureEngineer().fit(df).transform(df).withColumn("Constant", F.lit(1.0))
    columns, out = [*NARROW, "Constant"], None
    for least in LEAST_VARIANCES:
        left = tf.VarianceFilter(columns, least).fit(table).transform(table)
        cells = [F.struct(F.lit(c).alias("column"), F.count(f"`{c}`").alias("n")) for c in columns if c in left.columns]
        one = left.agg(F.array(*cells).alias("cells")).select(F.lit(least).alias("least"), F.inline("cells"))
        out = one if out is None else out.unionByName(one)
    return out


@query("sampled_rows", f"WITH {SNAP} SELECT * FROM snap ORDER BY md5('42:' || CustomerID), CustomerID LIMIT 100")
def sampled_rows(spark, folder):
    return split.sample_rows(snapshot(spark, folder), 100, ID)


@query("sample_members", f"""WITH {SNAP}, chosen AS (SELECT CustomerID FROM snap ORDER BY md5('42:' || CustomerID), CustomerID LIMIT 100)
SELECT CustomerID, Churn FROM snap WHERE CustomerID IN (SELECT CustomerID FROM chosen)""")
def sample_members(spark, folder):
    df = snapshot(spark, folder)
    return shaping.members(df, split.sample_rows(df.select(ID), 100, ID), ID).select("CustomerID", "Churn")


@query("risk_by_contract", f"""WITH {SNAP}
SELECT ContractType, CASE WHEN probability >= 0.8 THEN 'Critical' WHEN probability >= 0.65 THEN 'High' WHEN probability >= 0.45 THEN 'Medium' ELSE 'Low' END AS risk_level,
       count(*) AS customers, round(avg(probability), 6) AS mean_probability, round(avg(label), 6) AS churn_rate,
       CAST(sum(CASE WHEN Tenure < 12 AND MonthlyCharges > (SELECT quantile_cont(MonthlyCharges, 0.5) FROM snap) AND RecentSupportTickets = 1 THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_customers,
       CAST(sum(CASE WHEN ContractType = 'Month-to-Month' AND Tenure > 24 THEN 1 ELSE 0 END) AS BIGINT) AS mismatched,
       round(avg(LatePayments + 0.5::DOUBLE * Complaints), 6) AS mean_stress
FROM scored GROUP BY 1, 2""")
def risk_by_contract(spark, folder):
    return rounded(jobs.risk_report(snapshot(spark, folder)))
