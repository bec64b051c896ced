"""The streaming runs, over the driver's tables as finished sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.shared import folder as folder_of
from ..streaming import alerts
from . import views
from .registry import query
from .search_queries import alert_debounce  # noqa: F401  the batch twin
from .views import table


@query("""WITH RECURSIVE src AS (SELECT user_id AS k, event_id AS ord, epoch_us(ts) // 1000000 AS "at" FROM events WHERE event_type = 'error'), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY "at", ord) AS rn FROM src),
walk AS (SELECT k, rn, "at", true AS pass, "at" AS last FROM n WHERE rn = 1
  UNION ALL SELECT n.k, n.rn, n."at", n."at" - w.last >= 3600, CASE WHEN n."at" - w.last >= 3600 THEN n."at" ELSE w.last END FROM walk w JOIN n ON n.k = w.k AND n.rn = w.rn + 1)
SELECT n.k, n.ord, n."at" FROM n JOIN walk w ON w.k = n.k AND w.rn = n.rn WHERE w.pass""")
def stream_alert_debounce(spark, sf):
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    lines = alerts.matching(events, "event_type", "error")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("at")
    folder = folder_of(spark, "stream")
    alerts.drain(alerts.debounced(lines.select(F.col("user_id").alias("k"), F.col("event_id").alias("ord"), at), 3600), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(alerts.KEPT).parquet(f"{folder}/out")


_IN_ORDER = """WITH RECURSIVE src AS (SELECT user_id AS k, event_id AS ord, epoch_us(ts) // 1000000 AS "at" FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY "at", ord) AS rn FROM src),
walk AS (SELECT k, rn, "at", true AS pass, "at" AS last FROM n WHERE rn = 1
  UNION ALL SELECT n.k, n.rn, n."at", n."at" - w.last >= 7200, CASE WHEN n."at" - w.last >= 7200 THEN n."at" ELSE w.last END FROM walk w JOIN n ON n.k = w.k AND n.rn = w.rn + 1)
SELECT n.k, n.ord, n."at" FROM n JOIN walk w ON w.k = n.k AND w.rn = n.rn WHERE w.pass"""


@query(_IN_ORDER)
def stream_debounce_in_order(spark, sf):
    """Alerts in event order, though the micro-batches (by event type) each span all of the time."""
    folder = folder_of(spark, "stream")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("at")
    events = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("ord"), at, F.col("ts").cast("timestamp").alias("ts"), "event_type")
    for (kind,) in events.select("event_type").distinct().orderBy("event_type").collect():
        events.where(F.col("event_type").eqNullSafe(F.lit(kind))).drop("event_type").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("k long, ord long, at long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    alerts.drain(alerts.debounced_in_order(stream, 7200, "3650 days"), f"{folder}/out", f"{folder}/checkpoint")
    end = events.select(F.max("ts") + F.expr("INTERVAL 4000 DAYS")).first()[0]  # a last row lets the watermark pass all others
    spark.createDataFrame([(-1, -1, int(end.timestamp()), end)], "k long, ord long, at long, ts timestamp").write.mode("append").parquet(f"{folder}/in")
    alerts.drain(alerts.debounced_in_order(stream, 7200, "3650 days"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(alerts.KEPT).parquet(f"{folder}/out").where("k >= 0")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_incremental(spark, sf):
    """Two runs over the same source: the second finds nothing new."""
    schema = table(spark, sf, "events").select("event_id", "user_id", "event_type").schema
    folder = folder_of(spark, "stream")
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
        alerts.drain(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(schema).parquet(f"{folder}/out")


@query('SELECT event_type, count(*) AS n FROM events GROUP BY event_type')
def stream_counts(spark, sf):
    """Lines per class, summed over micro-batches by a keyed sink."""
    schema = table(spark, sf, "events").select("event_type").schema
    folder = folder_of(spark, "stream")
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")

    def write(batch, number):
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def stream_one_shot(spark, sf):
    """Files of a folder taken once: a second run finds nothing new."""
    folder = folder_of(spark, "stream")
    table(spark, sf, "events").select("event_type").write.text(f"{folder}/in")
    for _ in range(2):
        alerts.consume_once(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", f"{folder}/archive")
    return spark.read.schema("value string").parquet(f"{folder}/out").groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_logs_followed(spark, sf):
    """Events as lines of many growing logs, followed by byte ranges in two runs of
    one checkpoint: the second run finds what was added since, and nothing twice."""
    folder = folder_of(spark, "logs")
    lines = table(spark, sf, "events").select(F.concat_ws(",", "event_id", "user_id", "event_type").alias("value"), "event_type")
    for error in (False, True):
        lines.where((F.col("event_type") == "error") == F.lit(error)).select("value").write.mode("append").text(f"{folder}/in")
        alerts.drain(alerts.follow(spark, f"{folder}/in/part-*", chunk="65536"), f"{folder}/out", f"{folder}/checkpoint")
    own = F.split("value", ",")
    got = spark.read.schema("file string, place long, value string").parquet(f"{folder}/out")
    return got.select(own[0].cast("long").alias("event_id"), own[1].cast("long").alias("user_id"), own[2].alias("event_type"))
