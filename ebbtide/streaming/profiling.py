"""Profile states of a stream: each micro-batch reads its own rows and appends their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ebbtide.operators.states import profile_state, store_states


def start_profiling(stream: DataFrame, period: Column, numeric: list[str], categorical: list[str], out: str, checkpoint: str,
                    available_now: bool = True) -> StreamingQuery:
    """Append the state of each micro-batch to ``out``, by period.

    There is no streaming state: late rows are a further state of their period, and a
    micro-batch that runs again after a failure replaces its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store_states(profile_state(batch, period.cast("string"), numeric, categorical), out, batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
