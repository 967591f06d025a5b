"""Profiles over time from stored states, next to SQL over all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, rounded
from ebbtide.operators import profile, states
from ebbtide.session import work_path
from ebbtide.sources.snapshot import table
from ebbtide.streaming import profiling

FILE_ROWS, FILES = 1_000_000, 64
CHANGE = "2024-01-16"


def event_states(spark, folder, file_rows: int = FILE_ROWS, files: int = FILES):
    """Daily states of the events, which arrive as a stream of files."""
    source, out, checkpoint = (work_path(spark, f"events-{n}") for n in ("in", "states", "checkpoint"))
    events = table(spark, folder, "events").select("ts", "event_type", "value")
    events.write.option("maxRecordsPerFile", file_rows).parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(source)
    profiling.start_profiling(stream, F.to_date("ts"), ["value"], ["event_type"], out, checkpoint).awaitTermination()
    return states.read_states(spark, out)


def _profile_sql(where: str = "true") -> str:
    return f"""SELECT 'value' AS "column", 'mean' AS statistic, avg(value) AS value FROM events WHERE {where}
UNION ALL SELECT 'value', 'std', stddev_samp(value) FROM events WHERE {where}
UNION ALL SELECT 'event_type', 'share:' || event_type, count(*) / sum(CAST(count(*) AS DOUBLE)) OVER () FROM events
WHERE {where} AND event_type IS NOT NULL GROUP BY event_type"""


@query("daily_profile_states", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS period, 'value' AS "column", CAST(NULL AS VARCHAR) AS category, count(value) AS "rows",
       round(avg(value), 6) AS mean, round(var_pop(value) * count(value), 6) AS m2, min(value) AS low, max(value) AS high
FROM events WHERE value IS NOT NULL GROUP BY 1
UNION ALL SELECT CAST(CAST(ts AS DATE) AS VARCHAR), 'event_type', event_type, count(*), NULL, NULL, NULL, NULL
FROM events WHERE event_type IS NOT NULL GROUP BY 1, 3""")
def daily_profile_states(spark, folder):
    """States of micro-batches, merged by day."""
    return rounded(states.merge_states(event_states(spark, folder), ("period",)))


@query("merged_profile", f'WITH p AS ({_profile_sql()}) SELECT "column", statistic, round(value, 6) AS value FROM p')
def merged_profile(spark, folder):
    """All stored days merged give the profile of one scan of all rows."""
    return rounded(states.profile_of_state(states.merge_states(event_states(spark, folder))))


@query("period_drift", f"""WITH a AS ({_profile_sql(f"ts < TIMESTAMP '{CHANGE}'")}), b AS ({_profile_sql(f"ts >= TIMESTAMP '{CHANGE}'")})
SELECT "column", statistic, round(a.value, 6) AS baseline, round(b.value, 6) AS current, round(b.value - a.value, 6) + 0.0 AS change
FROM a FULL JOIN b USING ("column", statistic)""")
def period_drift(spark, folder):
    """Drift between two stretches of days, from their stored states alone."""
    stored = event_states(spark, folder)
    old, new = (states.profile_of_state(states.merge_states(stored.where(c))) for c in (f"period < '{CHANGE}'", f"period >= '{CHANGE}'"))
    return rounded(profile.profile_drift(old, new))
