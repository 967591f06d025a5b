"""Request batches spread over files and micro-batches, next to SQL over whole batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.base import SNAP, query
from catalog.quality import REQUESTS, requests
from catalog.scoring import _answers_sql
from ebbtide.operators import scoring
from ebbtide.session import work_path
from ebbtide.streaming import batches

# Customers come in pairs, every fourth three hundred as one batch that is too large. Of every
# eleventh pair the second record never comes; every seventh record comes twice.
BATCHED = """
numbered AS (SELECT customer_id, CAST(substr(customer_id, 5) AS BIGINT) AS n FROM requests),
batched AS (
  SELECT customer_id, n, CASE WHEN n // 300 % 4 = 3 THEN 'large-' || CAST(n // 300 AS VARCHAR) ELSE 'pair-' || CAST(n // 2 AS VARCHAR) END AS batch FROM numbered),
verdicts AS (
  SELECT batch, count(DISTINCT b.customer_id) AS records,
         CASE WHEN count(DISTINCT b.customer_id) <= 100 THEN count(DISTINCT e.customer_id) END AS invalid,
         count(DISTINCT b.customer_id) <= 100 AND count(DISTINCT e.customer_id) = 0 AS accepted,
         CASE WHEN count(DISTINCT b.customer_id) > 100 THEN 'too large' WHEN count(DISTINCT e.customer_id) > 0 THEN 'invalid' END AS reason
  FROM batched b LEFT JOIN errors e USING (customer_id) GROUP BY batch HAVING NOT bool_or(batch LIKE 'pair%' AND n % 22 = 11))"""


def streamed_batches_out(spark, folder, files_per_batch: int = 64):
    """Write the batched requests as files, first and second records apart, and run the stream."""
    source, out, checkpoint = (work_path(spark, f"batches-{n}") for n in ("in", "out", "checkpoint"))
    n = F.col("n")
    numbered = requests(spark, folder).withColumn("n", F.substring("customer_id", 5, 20).cast("bigint"))
    large = F.floor(n / 300) % 4 == 3
    batch = F.when(large, F.concat(F.lit("large-"), F.floor(n / 300).cast("string"))).otherwise(F.concat(F.lit("pair-"), F.floor(n / 2).cast("string")))
    counted = (
        numbered.withColumns({"batch": batch, "position": F.when(large, n % 300).otherwise(n % 2), "at": F.timestamp_seconds(F.lit(1_700_000_000) + n % 600)})
        .withColumn("records", F.count("*").over(Window.partitionBy("batch"))).where(large | (n % 22 != 11))
    )
    twice = counted.withColumn("copy", F.explode(F.when(n % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    twice.repartition("position", "copy").drop("n", "copy").write.json(source)
    batches.start_batches(batches.read_batch_stream(spark, source, files_per_batch), scoring.score_with_rules, out, checkpoint, 3).awaitTermination()
    return out


@query("streamed_batch_verdicts", f"WITH {SNAP}, {REQUESTS}, {BATCHED} SELECT * FROM verdicts")
def streamed_batch_verdicts(spark, folder):
    return batches.read_outcome(spark, streamed_batches_out(spark, folder), "verdicts")


@query("streamed_batch_responses", f"""WITH {SNAP}, {REQUESTS}, {BATCHED}, answers AS ({_answers_sql('s', 'p > 0.5')})
SELECT answers.customer_id, churn_prediction, churn_probability, risk_level, confidence, model_version FROM answers JOIN batched USING (customer_id) JOIN verdicts USING (batch) WHERE accepted""")
def streamed_batch_responses(spark, folder):
    return batches.read_outcome(spark, streamed_batches_out(spark, folder), "valid")


@query("streamed_batch_rejects", f"""WITH {SNAP}, {REQUESTS}, {BATCHED}
SELECT batch, customer_id, field, type FROM errors JOIN batched USING (customer_id) JOIN verdicts USING (batch) WHERE reason = 'invalid'""")
def streamed_batch_rejects(spark, folder):
    return batches.read_outcome(spark, streamed_batches_out(spark, folder), "rejects").select("batch", "customer_id", "field", "type")
