"""Queries that read a table as a stream, to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.registry import Registry
from lectern.storage import delete_folder, read_table, shared_dir
from lectern.streaming import limiter, rollup

R = Registry()

_STORE = "spark.sql.streaming.stateStore.providerClass"
_WITH_TIMERS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*")  # a stream's source is a folder or a pattern


def _to_end(spark: SparkSession, out: DataFrame) -> DataFrame:
    """What a stream gives until nothing new comes, as a table of the shared folder."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    known = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _WITH_TIMERS)
    try:
        running = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        if known is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, known)
    delete_folder(spark, f"{folder}/state")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@R.query(
    """WITH RECURSIVE w AS (SELECT user_id, min(ts) AS ws FROM events GROUP BY 1 UNION ALL
  SELECT w.user_id, (SELECT min(ts) FROM events e WHERE e.user_id = w.user_id AND e.ts >= w.ws + INTERVAL 2 DAY) FROM w
  WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = w.user_id AND e.ts >= w.ws + INTERVAL 2 DAY)),
j AS (SELECT e.event_id, e.user_id, e.ts, e.value, max(w.ws) AS ws FROM events e JOIN w ON w.user_id = e.user_id AND w.ws <= e.ts GROUP BY 1, 2, 3, 4),
u AS (SELECT *, CAST(sum(greatest(CAST(floor(value) AS BIGINT), 1)) OVER (PARTITION BY user_id, ws ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM j)
SELECT event_id, user_id, epoch_us(ws) AS window_start, used, used > 60 AS limited FROM u WHERE epoch_us(ts) < (SELECT epoch_us(max(ts)) // 1000 FROM events) * 1000"""
)
def limiter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter as a stateful stream; the last event waits for the watermark."""
    found = limiter.limited_stream(_events(spark, sf_dir), "user_id", "ts", "event_id", F.floor("value").cast("bigint"), 2 * 86_400, 60, "0 seconds")
    return _to_end(spark, found).select("event_id", "user_id", "window_start", "used", "limited")


@R.query(
    """WITH e AS (SELECT epoch_us(ts) // 3600000000 * 3600 AS window_start, event_type, CAST(floor(value) AS BIGINT) AS cost FROM events)
SELECT window_start, event_type, count(*) AS requests, CAST(sum(cost) AS BIGINT) AS cost FROM e WHERE (window_start + 3600) * 1000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events) - 600000 GROUP BY 1, 2"""
)
def watermarked_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rollups of a stream, each given out once the watermark, ten minutes behind the newest event, has passed its end."""
    found = rollup.watermarked_rollup(_events(spark, sf_dir), "ts", ["event_type"], F.floor("value").cast("bigint"), "1 hour", "10 minutes")
    return _to_end(spark, found)
