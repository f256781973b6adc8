"""File changes as a stream: watched paths, bursts by session windows, and an index run for each burst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.schema import EVENTS
from textloom.sources.files import supported

KINDS = ("modified", "created", "deleted", "moved")


def watched(events: DataFrame) -> DataFrame:
    """Events of files with a supported suffix and a known kind, with a time."""
    return events.where(F.col("ts").isNotNull() & F.col("kind").isin(*KINDS) & supported(F.col("path")))


def bursts(events: DataFrame, quiet: float = 2.0, late: str | None = None, bucket: int = 3600, key: str | None = None) -> DataFrame:
    """([key,] start, last, n_events, n_paths): watched events that follow each other by at most ``quiet`` seconds.

    ``key`` names a column (a root, a collection) whose values have bursts of their own, so that many roots are watched
    side by side; without it all events are those of one root.

    On a stream these are session windows; give ``late``, how long late events are waited for; later ones are
    dropped.  On a table nothing is late, and the timeline is cut into buckets of ``bucket`` seconds, so that no
    task sorts all events: bursts are found within the buckets, and only one row for each bucket is needed to
    carry a burst over their ends.  Repeated events count; repeated paths count once.
    """
    e = watched(events)
    if events.isStreaming:
        kind = dict(events.dtypes)["ts"]
        e = e.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late or "0 seconds")
        by = [key] if key else [F.length("path") >= 0]  # sessions need a key; this one is the same for all events of one root
        s = e.groupBy(*by, F.session_window("ts", f"{quiet} seconds").alias("w")).agg(F.count("*").alias("n_events"), F.size(F.collect_set("path")).alias("n_paths"), F.max("ts").alias("last"))
        return s.select(*([key] if key else []), F.col("w.start").cast(kind).alias("start"), F.col("last").cast(kind).alias("last"), "n_events", "n_paths")
    own = [key] if key else []
    kind = dict(events.dtypes)["ts"]
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.select(*own, "ts", "path", micros.alias("us"), F.floor(micros / (bucket * 1_000_000)).alias("bucket"))
    gap = F.lit(int(quiet * 1_000_000))
    at = [*own, "bucket"]
    ends = e.groupBy(*at).agg(F.max("us").alias("end")).withColumn("before", F.lag("end").over(Window.partitionBy(*own).orderBy("bucket"))).select(*at, "before")
    order = Window.partitionBy(*at).orderBy("us")
    e = e.join(ends, at).withColumn("prev", F.coalesce(F.lag("us").over(order), "before"))
    e = e.withColumn("opens", F.when(F.col("prev").isNull() | (F.col("us") - F.col("prev") > gap), F.col("us")))
    e = e.withColumn("own", F.max("opens").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    carried = e.groupBy(*at).agg(F.max("opens").alias("opened")).withColumn("open", F.last("opened", ignorenulls=True).over(Window.partitionBy(*own).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select(*at, "open")
    s = e.join(carried, at).withColumn("start", F.coalesce("own", "open"))
    return s.groupBy(*own, F.timestamp_micros("start").cast(kind).alias("start")).agg(F.max("ts").alias("last"), F.count("*").alias("n_events"), F.countDistinct("path").cast("int").alias("n_paths"))


def event_stream(spark: SparkSession, folder: str, kind: str = "parquet") -> DataFrame:
    """Change events from the files that a lister or watcher adds to a folder."""
    return spark.readStream.schema(EVENTS).format(kind).load(folder)


def watch(events: DataFrame, on_burst: Callable[[int], None], checkpoint: str, *, quiet: float = 2.0, late: str = "10 seconds", trigger: dict | None = None) -> StreamingQuery:
    """Start a query that calls ``on_burst(number of bursts)`` for each batch with closed bursts.

    A failing call is reported and does not end the stream.
    """

    def run(batch: DataFrame, _: int) -> None:
        n = batch.count()
        if n:
            try:
                on_burst(n)
            except Exception as e:  # noqa: BLE001
                print(f"indexing failed: {e}")

    w = bursts(events, quiet, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run)
    return (w.trigger(**trigger) if trigger else w).start()


def stop(query: StreamingQuery | None, wait: float = 5.0) -> None:
    if query is not None and query.isActive:
        query.stop()
        query.awaitTermination(wait)
