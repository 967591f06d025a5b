"""Scoring, streaming, run and version queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SNAP, query, rounded
from catalog.evaluating import _ratio
from catalog.quality import REQUESTS, requests
from ebbtide.functions import scalars
from ebbtide.operators import curves, evaluation, runs, scoring, shaping
from ebbtide.schema import ID
from ebbtide.session import work_path
from ebbtide.sources import sinks
from ebbtide.sources.snapshot import scored_customers, snapshot, table
from ebbtide.streaming import scoring as streaming

TIER = "CASE WHEN p >= 0.8 THEN 'Critical' WHEN p >= 0.65 THEN 'High' WHEN p >= 0.45 THEN 'Medium' ELSE 'Low' END"


def _answers_sql(source, yes):
    return f"""SELECT {source}.CustomerID AS customer_id, CASE WHEN {yes} THEN 'Yes' ELSE 'No' END AS churn_prediction, round(p, 4) AS churn_probability,
       {TIER} AS risk_level, round(CASE WHEN {yes} THEN p ELSE 1 - p END, 4) AS confidence, 'v3' AS model_version
FROM (SELECT CustomerID, 1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)) AS p FROM logits) AS {source}"""


@query("scored_responses", f"WITH {SNAP} {_answers_sql('s', 'p > 0.5')}")
def scored_responses(spark, folder):
    return scoring.responses(scoring.score_with_rules(snapshot(spark, folder)), 3).drop("prediction_date")


@query("scored_responses_own_threshold", f"WITH {SNAP} {_answers_sql('s', 'p >= 0.85')}")
def scored_responses_own_threshold(spark, folder):
    return scoring.responses(scoring.score_with_rules(snapshot(spark, folder)), 3, threshold=0.85).drop("prediction_date")


@query("scoring_summary", f"""WITH {SNAP}, answers AS ({_answers_sql('s', 'p > 0.5')})
SELECT count(*) AS total_predictions, count(*) FILTER (WHERE risk_level IN ('High', 'Critical')) AS high_risk_count FROM answers""")
def scoring_summary(spark, folder):
    return scoring.batch_summary(scoring.responses(scoring.score_with_rules(snapshot(spark, folder)), 3))


def _stream(spark, folder):
    """Write the requests as JSON files, score them as a stream, give back the sink."""
    source, out, checkpoint = (work_path(spark, f"stream-{n}") for n in ("in", "out", "checkpoint"))
    requests(spark, folder).write.json(source)
    streaming.start_scoring(
        streaming.read_request_stream(spark, source, files_per_batch=64), scoring.score_with_rules, out, checkpoint, 3,
    ).awaitTermination()
    return out


@query("streamed_responses", f"""WITH {SNAP}, {REQUESTS}, answers AS ({_answers_sql('s', 'p > 0.5')})
SELECT answers.* FROM answers JOIN accepted USING (customer_id)""")
def streamed_responses(spark, folder):
    return spark.read.parquet(_stream(spark, folder) + "/valid").drop("prediction_date", "batch_id")


@query("streamed_rejects", f"""WITH {SNAP}, {REQUESTS}
SELECT customer_id, CAST(count(*) OVER (PARTITION BY customer_id) AS INTEGER) AS error_count, field, type FROM errors""")
def streamed_rejects(spark, folder):
    return spark.read.parquet(_stream(spark, folder) + "/rejects").select("customer_id", "error_count", "field", "type")


# Each order is a version of one of five models, so every model holds a large share of the rows.
# The run of a version measures its order lines.
VERSIONS = """
versions AS (
  SELECT 'model-' || o_orderpriority AS name, o_orderkey + 1 AS version,
         CASE o_orderstatus WHEN 'F' THEN 'Archived' WHEN 'O' THEN 'Staging' ELSE 'Production' END AS stage,
         'run-' || CAST(o_orderkey AS VARCHAR) AS run_id, o_orderdate AS created,
         CASE WHEN o_orderkey % 2 = 0 THEN repeat(o_orderpriority || ' ', 8) ELSE o_orderpriority END AS description
  FROM orders),
runs AS (
  SELECT 'run-' || CAST(l_orderkey AS VARCHAR) AS run_id, 'lines-' || CAST(count(*) AS VARCHAR) AS run_name,
         round(avg(l_discount) * 10, 6) AS roc_auc, round(avg(l_tax) * 10, 6) AS accuracy
  FROM lineitem GROUP BY l_orderkey),
listed AS (
  SELECT name, version, stage, versions.run_id, coalesce(run_name, 'unknown') AS run_name, roc_auc, accuracy, created,
         CASE WHEN length(description) > 50 THEN substr(description, 1, 50) || '...' ELSE description END AS description
  FROM versions LEFT JOIN runs USING (run_id))"""


def order_versions(spark, folder):
    key, text = F.col("o_orderkey"), F.col("o_orderpriority")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("model-"), text).alias("name"), (key + 1).alias("version"),
        F.when(F.col("o_orderstatus") == "F", "Archived").when(F.col("o_orderstatus") == "O", "Staging").otherwise("Production").alias("stage"),
        F.concat(F.lit("run-"), key.cast("string")).alias("run_id"), F.col("o_orderdate").alias("created"),
        F.when(key % 2 == 0, F.repeat(F.concat(text, F.lit(" ")), F.lit(8))).otherwise(text).alias("description"),
        F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("tags"))


def order_runs(spark, folder):
    measured = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.round(F.avg("l_discount") * 10, 6).alias("d"), F.round(F.avg("l_tax") * 10, 6).alias("t"))
    return measured.select(
        F.concat(F.lit("run-"), F.col("l_orderkey").cast("string")).alias("run_id"),
        F.concat(F.lit("lines-"), F.col("n").cast("string")).alias("run_name"),
        F.create_map(F.lit("roc_auc"), F.col("d"), F.lit("accuracy"), F.col("t")).alias("metrics"),
        F.create_map(F.lit("model_type"), F.when(F.col("n") > 4, "forest")).alias("params"))


@query("version_list", f"WITH {VERSIONS} SELECT * FROM listed")
def version_list(spark, folder):
    return runs.list_versions(order_versions(spark, folder), order_runs(spark, folder))


@query("version_list_of_one", f"WITH {VERSIONS} SELECT * FROM listed WHERE name = 'model-2-HIGH'")
def version_list_of_one(spark, folder):
    return runs.list_versions(order_versions(spark, folder), order_runs(spark, folder), "model-2-HIGH")


@query("latest_versions", f"""WITH {VERSIONS}
SELECT name, stage, max(version) AS version, arg_max(run_id, version) AS run_id, arg_max(created, version) AS created,
       arg_max(description, version) AS description FROM versions GROUP BY 1, 2""")
def latest_versions(spark, folder):
    return runs.latest_per_stage(order_versions(spark, folder))


@query("staging_versions", f"WITH {VERSIONS} SELECT name, max(version) AS version FROM versions WHERE stage = 'Staging' GROUP BY name")
def staging_versions(spark, folder):
    """The version in Staging of every model."""
    versions, out = order_versions(spark, folder), None
    for name in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        one = runs.version_in_stage(versions, f"model-{name}", "Staging").withColumn("name", F.lit(f"model-{name}"))
        out = one if out is None else out.unionByName(one)
    return out.filter("version is not null")


@query("production_version", f"WITH {VERSIONS} SELECT max(version) AS version FROM versions WHERE name = 'model-2-HIGH' AND stage = 'Production'")
def production_version(spark, folder):
    return runs.version_in_stage(order_versions(spark, folder), "model-2-HIGH", "Production")


FIRST_VERSIONS = "(SELECT min(version) FROM versions WHERE name = 'model-2-HIGH'), (SELECT max(version) FROM versions WHERE name = 'model-2-HIGH')"


@query("version_comparison", f"""WITH {VERSIONS}
SELECT version, stage, run_name, roc_auc, accuracy FROM listed WHERE name = 'model-2-HIGH' AND version IN ({FIRST_VERSIONS})""")
def version_comparison(spark, folder):
    versions = order_versions(spark, folder)
    ends = versions.filter("name = 'model-2-HIGH'").agg(F.min("version"), F.max("version")).first()
    return runs.compare_versions(versions, order_runs(spark, folder), "model-2-HIGH", list(ends), ("roc_auc", "accuracy"))


@query("version_metadata", f"""WITH {VERSIONS}
SELECT name AS model_name, version, stage, versions.run_id, run_name, description, created AS created_timestamp, roc_auc, accuracy,
       (SELECT o_orderstatus FROM orders WHERE 'run-' || CAST(o_orderkey AS VARCHAR) = versions.run_id) AS status_tag,
       (SELECT CASE WHEN count(*) > 4 THEN 'forest' END FROM lineitem WHERE 'run-' || CAST(l_orderkey AS VARCHAR) = versions.run_id) AS model_type,
       CASE WHEN roc_auc IS NULL THEN NULL ELSE 2 END AS n_metrics
FROM versions LEFT JOIN runs USING (run_id) WHERE name = 'model-2-HIGH' AND version = (SELECT max(version) FROM versions WHERE name = 'model-2-HIGH')""")
def version_metadata(spark, folder):
    versions = order_versions(spark, folder)
    newest = versions.filter("name = 'model-2-HIGH'").agg(F.max("version")).first()[0]
    record = runs.version_record(versions, order_runs(spark, folder), "model-2-HIGH", newest)
    return record.withColumns({
        "roc_auc": scalars.lookup(F.col("metrics"), "roc_auc"), "accuracy": scalars.lookup(F.col("metrics"), "accuracy"),
        "status_tag": F.col("tags")["status"], "model_type": F.col("parameters")["model_type"],
        "n_metrics": F.when(F.col("metrics").isNotNull(), F.size("metrics")),
    }).drop("metrics", "parameters", "tags")


@query("champion_tag_entries", f"""WITH {VERSIONS}, sized AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), entries AS (
  SELECT run_id, 'data_version' AS key, 'v3.1' AS value, CAST(NULL AS DOUBLE) AS number FROM runs
  UNION ALL SELECT run_id, 'run_name', run_name, NULL FROM runs UNION ALL SELECT run_id, 'champion', 'true', NULL FROM runs
  UNION ALL SELECT 'run-' || CAST(l_orderkey AS VARCHAR), 'model_type', CASE WHEN n > 4 THEN 'forest' ELSE 'XGBoost' END, NULL FROM sized
  UNION ALL SELECT run_id, 'metric_roc_auc', NULL, roc_auc FROM runs UNION ALL SELECT run_id, 'metric_accuracy', NULL, accuracy FROM runs)
SELECT * FROM entries""")
def champion_tag_entries(spark, folder):
    tagged = runs.champion_tags(order_runs(spark, folder)).select("run_id", F.explode("champion_tags").alias("key", "value"))
    # Engines write numbers as text in different ways, so metric entries are compared as numbers.
    metric = F.col("key").startswith("metric_")
    return tagged.select("run_id", "key", F.when(~metric, F.col("value")).alias("value"), F.when(metric, F.col("value").try_cast("double")).alias("number"))


# Stage log: every order moves its version to a stage; the larger order key is the later event.
EVENTS = """
log AS (
  SELECT 'model-' || CAST(o_custkey % 50 AS VARCHAR) AS name, o_orderkey % 7 AS version,
         CASE o_orderstatus WHEN 'F' THEN 'Archived' WHEN 'O' THEN 'Staging' ELSE 'Production' END AS stage, o_orderkey AS moment
  FROM orders),
last AS (SELECT name, version, arg_max(stage, moment) AS stage, max(moment) AS moment FROM log GROUP BY 1, 2),
taken AS (SELECT name, max(moment) AS taken_at FROM log WHERE stage = 'Production' GROUP BY 1)"""


@query("current_stages", f"""WITH {EVENTS}
SELECT name, version, CASE WHEN stage = 'Production' AND moment < taken_at THEN 'Archived' ELSE stage END AS stage
FROM last LEFT JOIN taken USING (name)""")
def current_stages(spark, folder):
    events = table(spark, folder, "orders").select(
        F.concat(F.lit("model-"), (F.col("o_custkey") % 50).cast("string")).alias("name"), (F.col("o_orderkey") % 7).alias("version"),
        F.when(F.col("o_orderstatus") == "F", "Archived").when(F.col("o_orderstatus") == "O", "Staging").otherwise("Production").alias("stage"),
        F.lit(True).alias("archive_existing"), F.col("o_orderkey").alias("at"))
    return runs.current_stages(events)


@query("current_stages_in_sequence", f"""WITH {EVENTS.replace("o_orderkey AS moment", "row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS moment")}
SELECT name, version, CASE WHEN stage = 'Production' AND moment < taken_at THEN 'Archived' ELSE stage END AS stage
FROM last LEFT JOIN taken USING (name)""")
def current_stages_in_sequence(spark, folder):
    """Many events share a day; the order key is the sequence in which they were written."""
    events = table(spark, folder, "orders").select(
        F.concat(F.lit("model-"), (F.col("o_custkey") % 50).cast("string")).alias("name"), (F.col("o_orderkey") % 7).alias("version"),
        F.when(F.col("o_orderstatus") == "F", "Archived").when(F.col("o_orderstatus") == "O", "Staging").otherwise("Production").alias("stage"),
        F.lit(True).alias("archive_existing"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("sequence"))
    return runs.current_stages(events)


SEGMENTS = f"""
parts AS (SELECT ContractType || '/' || PaymentMethod AS run_name, label, prediction, probability FROM scored),
cells AS (SELECT run_name, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                 count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp
          FROM parts GROUP BY 1),
segments AS (SELECT run_name, {_ratio('tp + tn', '(tn + fp + fn + tp)')} AS accuracy, {_ratio('tp', '(tp + fp)')} AS precision,
                    {_ratio('tp', '(tp + fn)')} AS recall, {_ratio('2 * tp', '(2 * tp + fp + fn)')} AS f1 FROM cells)"""


def segments(spark, folder):
    """Twelve segments measured as if each were a run."""
    df = scored_customers(spark, folder).withColumn("run_name", F.concat_ws("/", "ContractType", "PaymentMethod"))
    return evaluation.rates(df.groupBy("run_name").agg(*evaluation.cells())).drop("tn", "fp", "fn", "tp")


@query("leaderboard", f"""WITH {SNAP}, {SEGMENTS}
SELECT run_name, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(row_number() OVER (ORDER BY accuracy DESC, run_name) AS INTEGER) AS rank FROM segments""")
def leaderboard(spark, folder):
    return rounded(runs.leaderboard(segments(spark, folder), "accuracy"))


@query("best_against_champion", f"""WITH {SNAP}, {SEGMENTS}
SELECT arg_max(run_name, f1) AS run_name, round(max(f1), 6) AS f1, round(max(f1) - 0.6::DOUBLE, 6) AS delta FROM segments""")
def best_against_champion(spark, folder):
    return rounded(runs.best_delta(segments(spark, folder), 0.6, "f1"))


@query("class_weights", f"""WITH {SNAP}, c AS (SELECT count(*) AS n, sum(label) AS p FROM scored)
SELECT round(n / (2.0::DOUBLE * p), 6) AS positive_weight, round(n / (2.0::DOUBLE * (n - p)), 6) AS negative_weight, round((n - p) / CAST(p AS DOUBLE), 6) AS positive_ratio FROM c""")
def class_weights(spark, folder):
    from ebbtide.operators.training import class_weights as weights
    return rounded(weights(scored_customers(spark, folder)))


@query("text_expressions", """
SELECT o_orderkey, 'CUST' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS padded, 'v' || CAST(o_orderkey AS VARCHAR) AS version,
       strftime(o_orderdate, '%Y%m%d-%H%M%S') AS suffix, 'order-' || CAST(o_orderkey AS VARCHAR) AS stem,
       CASE WHEN length(o_orderpriority) > 6 THEN substr(o_orderpriority, 1, 6) || '...' ELSE o_orderpriority END AS cut,
       CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS large, round(abs(250000 - o_totalprice), 2) AS distance,
       least(greatest(o_totalprice, 50000), 300000) AS clipped
FROM orders""")
def text_expressions(spark, folder):
    from ebbtide.functions.features import clip
    price, key = F.col("o_totalprice"), F.col("o_orderkey").cast("string")
    return table(spark, folder, "orders").select(
        "o_orderkey", scalars.padded_id(F.col("o_custkey")).alias("padded"), scalars.version_label(key).alias("version"),
        scalars.time_suffix(F.col("o_orderdate")).alias("suffix"),
        scalars.file_stem(F.concat(F.lit("/data/in/order-"), key, F.lit(".csv"))).alias("stem"),
        scalars.ellipsis(F.col("o_orderpriority"), 6).alias("cut"), (price > 250000).cast("int").alias("large"),
        F.round(F.abs(250000 - price), 2).alias("distance"), clip(price, 50000, 300000).alias("clipped"))


@query("records_as_json", f"""WITH {SNAP}
SELECT '{{"CustomerID":"' || CustomerID || '","Age":' || CAST(Age AS VARCHAR) || ',"Churn":"' || Churn || '"}}' AS json FROM snap""")
def records_as_json(spark, folder):
    return sinks.to_json_column(snapshot(spark, folder).select("CustomerID", "Age", "Churn"))


@query("records_united", f"WITH {SNAP} SELECT CustomerID, Churn FROM snap")
def records_united(spark, folder):
    df = snapshot(spark, folder).select(ID, "Churn")
    return shaping.union_records([df.filter("Churn = 'Yes'"), df.filter("Churn = 'No'")])
