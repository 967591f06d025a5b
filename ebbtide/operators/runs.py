"""Run and version tables: append, list, compare, promote."""

from __future__ import annotations

import random
import time
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.functions.scalars import ellipsis, lookup, prefixed_metrics
from ebbtide.schema import RUNS, VERSIONS

STAGES = ("Staging", "Production", "Archived", "None")
COMPARED = ("roc_auc", "accuracy", "precision", "recall")


def run_row(spark: SparkSession, name: str, tags=None, params=None, metrics=None, with_time: bool = True) -> DataFrame:
    """One finished run; its name ends with the start time unless told otherwise."""
    now = datetime.now(timezone.utc)
    if with_time:
        name = f"{name}-{now:%Y%m%d-%H%M%S}"
    text = {k: str(v) for k, v in (params or {}).items()}
    numbers = {k: float(v) for k, v in (metrics or {}).items()}
    return spark.createDataFrame([(uuid.uuid4().hex, name, now, dict(tags or {}), text, numbers)], RUNS)


def append_run(run: DataFrame, path: str) -> None:
    run.write.mode("append").parquet(path)


def leaderboard(results: DataFrame, metric: str = "roc_auc", key: str = "run_name") -> DataFrame:
    """Runs ranked by a metric, best first. One row per run, so the sorted window stays small."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), key)))


def best_delta(results: DataFrame, champion: float, metric: str = "roc_auc") -> DataFrame:
    """The best run and its distance to the champion's metric."""
    return results.agg(F.max_by("run_name", metric).alias("run_name"), F.max(metric).alias(metric)).withColumn(
        "delta", F.col(metric) - F.lit(champion))


def with_run(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Versions next to the name, metrics and parameters of their run."""
    return versions.join(runs.select("run_id", "run_name", "metrics", "params"), "run_id", "left")


def list_versions(versions: DataFrame, runs: DataFrame, name: str | None = None) -> DataFrame:
    """Versions newest first with their main metrics. An unknown name gives an empty frame."""
    chosen = versions if name is None else versions.filter(F.col("name") == name)
    return with_run(chosen, runs).select(
        "name", "version", "stage", "run_id", F.coalesce("run_name", F.lit("unknown")).alias("run_name"),
        lookup(F.col("metrics"), "roc_auc").alias("roc_auc"), lookup(F.col("metrics"), "accuracy").alias("accuracy"),
        "created", ellipsis(F.col("description")).alias("description"),
    ).orderBy("name", F.desc("version"))


def latest_per_stage(versions: DataFrame) -> DataFrame:
    """The newest version of each model and stage, by name and then newest first.

    A maximum per group, so it combines before the shuffle and one model with very many
    versions does no harm.
    """
    record = F.struct("version", *[c for c in versions.columns if c not in ("name", "stage", "version", "tags")])
    return versions.groupBy("name", "stage").agg(F.max_by(record, "version").alias("_r")).select(
        "name", "stage", "_r.*").orderBy("name", F.desc("version"), "stage")


def version_in_stage(versions: DataFrame, name: str, stage: str) -> DataFrame:
    return versions.filter((F.col("name") == name) & (F.col("stage") == stage)).agg(F.max("version").alias("version"))


def compare_versions(versions: DataFrame, runs: DataFrame, name: str, chosen: list[int], metrics=COMPARED) -> DataFrame:
    picked = versions.filter((F.col("name") == name) & F.col("version").isin(*chosen))
    return with_run(picked, runs).select(
        "version", "stage", F.coalesce("run_name", F.lit("unknown")).alias("run_name"),
        *[lookup(F.col("metrics"), m).alias(m) for m in metrics]).orderBy("version")


def version_record(versions: DataFrame, runs: DataFrame, name: str, version: int) -> DataFrame:
    """Everything known about one version as one row."""
    return with_run(versions.filter((F.col("name") == name) & (F.col("version") == version)), runs).select(
        F.col("name").alias("model_name"), "version", "stage", "run_id", "run_name", "description", "tags",
        "metrics", F.col("params").alias("parameters"), F.col("created").alias("created_timestamp"))


def champion_tags(runs: DataFrame, data_version: str = "v3.1") -> DataFrame:
    """Registration tags of each run: fixed entries plus one per metric."""
    fixed = F.create_map(
        F.lit("data_version"), F.lit(data_version), F.lit("run_name"), F.coalesce("run_name", F.lit("unknown")),
        F.lit("model_type"), lookup(F.col("params"), "model_type", "XGBoost"), F.lit("champion"), F.lit("true"))
    return runs.withColumn("champion_tags", F.map_concat(fixed, prefixed_metrics(F.col("metrics"))))


CLAIMS = "name string, version bigint, token string"


def claimed_versions(spark: SparkSession, claims: str) -> DataFrame:
    """All claims of version numbers below a folder; none if nothing was claimed there."""
    try:
        # One file per claim, each in a folder of its own, so that no writer cleans up after another.
        return spark.read.schema(CLAIMS).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).json(claims)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CLAIMS)


def claim_version(spark: SparkSession, claims: str, name: str, least: int = 1, tries: int = 50) -> int:
    """A version number, at least ``least``, that no other writer gets, from a folder that all writers share.

    A writer states its claim first and looks afterwards whether another one is there. Of
    two writers with the same number, the one that wrote second sees the first one's claim,
    so never both keep it. If each sees the other, both let the number go and try a higher
    one after a random pause. Numbers may be left out, as they are if a writer is lost. The
    folder must show a finished file to all who list it afterwards.
    """
    for attempt in range(tries):
        mine = F.col("name") == name
        highest = claimed_versions(spark, claims).filter(mine).agg(F.max("version")).first()[0]
        number = max(least, (highest or 0) + 1)
        token = uuid.uuid4().hex
        spark.createDataFrame([(name, number, token)], CLAIMS).coalesce(1).write.json(f"{claims}/claim-{token}")
        rivals = claimed_versions(spark, claims).filter(mine & (F.col("version") == number) & (F.col("token") != token))
        if rivals.isEmpty():
            return number
        time.sleep(random.random() * 0.2 * (attempt + 1))
    raise RuntimeError(f"no version of {name} could be claimed in {tries} tries")


def new_version(versions: DataFrame, name: str, run_id: str, description: str = "", tags=None, claims: str | None = None) -> DataFrame:
    """The next version of a model as a row to append; the first version of a new name is 1.

    With ``claims``, a folder that all writers share, no two writers get the same number.
    """
    spark = versions.sparkSession
    number = versions.filter(F.col("name") == name).agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
    if claims is not None:
        number = claim_version(spark, claims, name, number)
    row = (name, number, "None", run_id, datetime.now(timezone.utc), description, {k: str(v) for k, v in (tags or {}).items()})
    return spark.createDataFrame([row], VERSIONS)


def add_tags(versions: DataFrame, name: str, version: int, tags: dict) -> DataFrame:
    """Set tags of one version; a new value replaces an old one."""
    added = F.create_map(*[F.lit(str(x)) for pair in tags.items() for x in pair])
    kept = F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*map(str, tags)))
    chosen = (F.col("name") == name) & (F.col("version") == version)
    return versions.withColumn("tags", F.when(chosen, F.map_concat(kept, added)).otherwise(F.col("tags")))


def set_description(versions: DataFrame, name: str, version: int, text: str) -> DataFrame:
    chosen = (F.col("name") == name) & (F.col("version") == version)
    return versions.withColumn("description", F.when(chosen, F.lit(text)).otherwise(F.col("description")))


def stage_event(spark: SparkSession, name: str, version: int, stage: str, archive_existing: bool | None = None) -> DataFrame:
    """A transition to append to the stage log."""
    if stage not in STAGES:
        raise ValueError(f"stage must be one of {STAGES}")
    archive = stage == "Production" if archive_existing is None else archive_existing
    return spark.createDataFrame(
        [(name, version, stage, archive, datetime.now(timezone.utc))],
        "name string, version bigint, stage string, archive_existing boolean, at timestamp")


def current_stages(events: DataFrame) -> DataFrame:
    """Stage of each version after all events.

    The last event of a version decides, but a version in Production is archived once a
    later event puts another version of the same model there and archives the previous one.
    Both steps are maxima per group; no history is sorted. Of events at one time the one
    with the larger ``sequence`` is the later; a log without that column is in the order of
    the names of stages there, the same in every run.
    """
    sequence = F.col("sequence") if "sequence" in events.columns else F.lit(0)
    moment = F.struct(F.col("at"), sequence.alias("sequence"))
    last = events.groupBy("name", "version").agg(F.max(F.struct(moment.alias("at"), F.col("stage"))).alias("_last")).select(
        "name", "version", "_last.stage", "_last.at")
    takeover = events.filter((F.col("stage") == "Production") & F.col("archive_existing")).groupBy("name").agg(
        F.max(moment).alias("taken_at"))
    replaced = (F.col("stage") == "Production") & (F.col("at") < F.col("taken_at"))
    return last.join(takeover, "name", "left").select(
        "name", "version", F.when(F.coalesce(replaced, F.lit(False)), "Archived").otherwise(F.col("stage")).alias("stage"))
