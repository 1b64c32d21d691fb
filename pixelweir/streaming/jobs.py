"""The job log as a stream: states that only move forward, and expiry by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pixelweir.operators.jobs import TERMINAL, TTL_SECONDS

ORDER = {"queued": 0, "running": 1, "succeeded": 2, "failed": 2}
STATE = "status string, progress double, updated timestamp, n long"
OUT = "job_id string, status string, progress double, updated timestamp, n_updates long, expired boolean"


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of Parquet files with job events as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def job_states(log: DataFrame, ttl: int = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Updates of (job_id, ts, status, progress): a finished job takes no more changes, progress never falls, and a job without news for `ttl` seconds after its last expires."""
    stream = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, progress, updated, n = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [progress], "updated": [updated], "n_updates": [n], "expired": [True]})
            return
        status, progress, updated, n = state.get if state.exists else ("queued", 0.0, None, 0)
        for r in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples():
            n += 1
            if status not in TERMINAL and ORDER[r.status] >= ORDER[status]:
                status = r.status
            progress = max(progress, float(r.progress))
            updated = r.ts if updated is None else max(updated, r.ts)
        state.update((status, progress, updated, n))
        now = max(int(updated.timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(now + ttl * 1000)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [progress], "updated": [updated], "n_updates": [n], "expired": [False]})

    return stream.groupBy("job_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def status_windows(log: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and status, once the watermark has passed the window."""
    stream = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stream.groupBy(F.window("ts", size), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")
