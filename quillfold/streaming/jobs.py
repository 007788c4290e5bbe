"""Jobs as state: a stream of events keeps each job's state and lets it go when its retention is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import ENDED, QUEUED, RUNNING

OUT = "job_id string, status string, submitted_at timestamp, started_at timestamp, finished_at timestamp, error string, evicted boolean"
STATE = "status string, submitted_at timestamp, started_at timestamp, finished_at timestamp, error string"


def follow(events: DataFrame, retention_seconds: int, late: str = "0 seconds") -> DataFrame:
    """The state of each job after every batch of events(job_id, seq, ts, status, error) that names it, and once more, marked
    evicted, when the watermark passes its end by the retention. Running jobs are never evicted; events after the end change
    nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, submitted, started, finished, error = state.get if state.exists else (None, None, None, None, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], status, submitted, started, finished, error, True)], columns=[x.split()[0] for x in OUT.split(", ")])
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        for ts, now, why in rows[["ts", "status", "error"]].itertuples(index=False):
            if status in ENDED:
                break
            if now == QUEUED:
                submitted = submitted if submitted is not None else ts
            elif now == RUNNING:
                started = started if started is not None else ts
            else:
                finished, error = ts, why if now == "FAILED" else None
            status = now if now != QUEUED or status is None else status
        state.update((status, submitted, started, finished, error))
        if status in ENDED:
            state.setTimeoutTimestamp(max(int(finished.timestamp() * 1000) + retention_seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        out = pd.DataFrame([(key[0], status, submitted, started, finished, error, False)], columns=[x.split()[0] for x in OUT.split(", ")])
        yield out.astype({"submitted_at": "datetime64[ns]", "started_at": "datetime64[ns]", "finished_at": "datetime64[ns]"})

    timed = events.select(F.col("job_id").cast("string").alias("job_id"), "seq", F.col("ts").cast("timestamp").alias("ts"), "status", "error").withWatermark("ts", late)
    return timed.groupBy("job_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
