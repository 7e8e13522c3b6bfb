import random

from pyspark.sql import functions as F

from lectern.plans.stream_queries import _STORE, _WITH_TIMERS
from lectern.streaming import limiter, rollup

EVENTS = "event_id bigint, user_id bigint, ts timestamp, value double"


def run(spark, folder):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = limiter.limited_stream(stream, "user_id", "ts", "event_id", F.floor("value").cast("bigint"), 600, 30, "1 hour")
    query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(240)


def test_shuffled_batches_and_a_restart_give_the_batch_rows(spark, tmp_path):
    rng = random.Random(8)
    events = [(i, rng.randint(1, 4), 1_700_000_000 + 25 * i + rng.random(), rng.choice([0.0, 0.4, 3.0, 9.0])) for i in range(240)]
    # any order within the hour that the watermark waits
    order = sorted(events, key=lambda e: e[2] + rng.uniform(0, 1500))
    rows = lambda some: spark.createDataFrame(some, "event_id bigint, user_id bigint, t double, value double").select("event_id", "user_id", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")).alias("ts"), "value")
    spark.conf.set(_STORE, _WITH_TIMERS)
    try:
        for k in range(3):
            rows(order[k * 60 : k * 60 + 60]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(spark, tmp_path)
        early = spark.read.parquet(f"{tmp_path}/out").count()
        rows(order[180:]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows([(9999, 99, 1_800_000_000.0, 1.0)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(spark, tmp_path)
    finally:
        spark.conf.unset(_STORE)
    batch = rows(events)
    placed = rollup.over_limit(rollup.limit_windows(batch, "user_id", "ts", 600), "user_id", "ts", F.floor("value").cast("bigint"), 30)
    expected = sorted(map(tuple, placed.select("user_id", "event_id", "window_start", "used", "limited").collect()))
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("user_id", "event_id", "window_start", "used", "limited").collect()))
    assert got == expected and 0 < early < len(events)
