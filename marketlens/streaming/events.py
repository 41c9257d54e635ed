"""Windows over events, batch and streamed, and what incremental loading needs: cursors, late data, exactly-once alerts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.lens import Lens
from marketlens.registry import query
from marketlens.session import shared_folder


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Lens(spark, sf_dir).table("events", "event_id", "ts", "user_id", "event_type", "value")


def _money(c: str = "value"):
    return F.sum(F.col(c).cast("decimal(20,4)")).cast("decimal(30,4)")


@query("tumbling_events", "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, cast(sum(cast(value as decimal(20,4))) as decimal(30,4)) as total from events group by all")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), _money().alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("sliding_events", "select time_bucket(interval 1 hour, ts) - to_hours(k) as window_start, count(*) as n, count(distinct user_id) as users from events, (select unnest([0, 1]) as k) group by all")
def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two hours, one every hour."""
    return _events(spark, sf_dir).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).select(F.col("w.start").alias("window_start"), "n", "users")


@query("session_events", """select user_id, min(ts) as session_start, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from (
  select *, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 6 hour then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id))) group by user_id, s""")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions end after six hours without an event."""
    return _events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


@query("digest_daily", "select user_id % 4 as tenant, cast(date_trunc('day', ts) as date) as day, count(*) as events, count(distinct event_type) as kinds, max(value) as top from events group by all")
def digest_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy((F.col("user_id") % 4).alias("tenant"), F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("events"), F.countDistinct("event_type").alias("kinds"), F.max("value").alias("top"))


@query("digest_weekly", "select user_id % 4 as tenant, cast(date_trunc('week', ts) as date) as week, count(*) as events from events group by all")
def digest_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks begin on Monday."""
    return _events(spark, sf_dir).groupBy((F.col("user_id") % 4).alias("tenant"), F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.count("*").alias("events"))


@query("tenant_quota", "select tenant, minute, n from (select user_id % 4 as tenant, date_trunc('minute', ts) as minute, count(*) as n from events group by all) where n >= 2")
def tenant_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes in which a tenant asked more than once: the request quota's counter."""
    return _events(spark, sf_dir).groupBy((F.col("user_id") % 4).alias("tenant"), F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n")).where("n >= 2").select("tenant", F.col("minute").cast("timestamp_ntz").alias("minute"), "n")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file stream."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_once(frame: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and stops; the checkpoint makes a second run start where this one ended."""
    q = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by hour and type with a watermark: events later than ``late`` are left out."""
    return events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late).groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))


def distinct_alerts(events: DataFrame, late: str = "31 days") -> DataFrame:
    """One event for each (user, type, whole value) within the watermark: exactly-once alerts over a stream."""
    e = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late).withColumn("change", F.sha2(F.concat_ws("|", "user_id", "event_type", F.floor("value").cast("string")).cast("binary"), 256))
    return e.dropDuplicatesWithinWatermark(["change"])


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch to its own folder, so that a batch that runs again replaces itself."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return put


@query("stream_tumbling", "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n from events group by all")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by a stream that runs once over what is there; complete mode gives all windows."""
    at = f"{shared_folder(spark)}/stream-tumbling-{dt.datetime.now().timestamp():.6f}"
    counts = stream(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    run_once(counts, lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out"), f"{at}/ckpt", "complete")
    return spark.read.parquet(f"{at}/out").select(F.col("w.start").alias("window_start"), "event_type", "n")


def next_window(cursor: dt.date | None, today: dt.date, start: dt.date, days: int = 7, lookback: int = 3) -> tuple[dt.date, dt.date]:
    """The next days to load: after the cursor, at most ``days``; once caught up, the last ``lookback`` days again."""
    if cursor is None:
        return start, min(start + dt.timedelta(days - 1), today)
    if cursor >= today:
        return today - dt.timedelta(lookback - 1), today
    first = cursor + dt.timedelta(1)
    return first, min(first + dt.timedelta(days - 1), today)
