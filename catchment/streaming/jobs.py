"""Activity events as Structured Streaming jobs.

Every stateful job carries a watermark.  Jobs run with ``availableNow`` here;
on a live feed the same plans run with a processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.nearest import SiteTree, nearest_site
from ..session import new_path

WATERMARK = "10 minutes"
KEEP_EVENTS = 50


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet path as a stream with the schema the files have."""
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    # a glob, so that one file can be a stream
    return r.parquet(path[:-1] + f"[{path[-1]}]")


def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Drain the stream into a table and give the table."""
    spark = stream.sparkSession
    out, state = new_path(spark, label), new_path(spark, f"{label}-state")
    q = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, label: str, step: Callable[[DataFrame], DataFrame] | None = None, mode: str = "update") -> DataFrame:
    """Drain the stream batch by batch into a table that also names the batch.

    The folder of a batch is overwritten when the batch runs again, so a restart
    leaves no doubles.
    """
    spark = stream.sparkSession
    out, state = new_path(spark, label), new_path(spark, f"{label}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = step(batch) if step else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", state)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(out)


def stage_metrics(events: DataFrame, width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Per window and stage: how many tries, successes, failures; mean duration."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    s = F.col("status")
    return (
        events.withWatermark("ts", WATERMARK).groupBy(win.alias("w"), "stage")
        .agg(
            F.count(F.when(s == "try", 1)).alias("n_try"), F.count(F.when(s == "ok", 1)).alias("n_ok"), F.count(F.when(s == "fail", 1)).alias("n_fail"),
            F.sum("duration_ms").alias("total_ms"), F.count(F.lit(1)).alias("n"),
        )
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "stage", "n_try", "n_ok", "n_fail", "total_ms", "n")
    )


def session_ttl(events: DataFrame, idle: str = "12 hours") -> DataFrame:
    """Sessions closed by idle time.

    Events of one session merge inside each partition before the shuffle.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (
        events.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", idle).alias("w"), "session_id")
        .agg(F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last_ts"))
        .select("session_id", F.col("w.start").alias("start"), "last_ts", "n_events")
    )


def recent_events(events: DataFrame, keep: int = KEEP_EVENTS) -> DataFrame:
    """The last ``keep`` events per session, re-emitted whenever a session changes.

    Each Arrow batch is cut to the last events per session before the shuffle,
    so a busy session sends little; its state never holds more than ``keep`` rows.
    """
    cols = ["session_id", "event_id", "ts", "stage", "status"]
    e = events.select(*cols)

    def trim(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.sort_values(["ts", "event_id"]).groupby("session_id", sort=False).tail(keep)

    def update(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        old = [pd.DataFrame([dict(zip(cols[1:], r)) for r in zip(*state.get)])] if state.exists else []
        last = pd.concat(old + [f[cols[1:]] for f in frames]).sort_values(["ts", "event_id"]).tail(keep)
        last["ts"] = pd.to_datetime(last["ts"])
        state.update(tuple(last[c].tolist() for c in cols[1:]))
        # the state leaves twelve idle hours after the newest event
        end = int(last["ts"].max().timestamp() * 1000) + 12 * 3600 * 1000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield last.assign(session_id=key[0])[cols]

    schema = "session_id string, event_id bigint, ts timestamp, stage string, status string"
    slim = e.mapInPandas(trim, schema).withWatermark("ts", WATERMARK)
    return slim.groupBy("session_id").applyInPandasWithState(
        update, schema, "event_id array<bigint>, ts array<timestamp>, stage array<string>, status array<string>", "update", "EventTimeTimeout"
    )


def try_outcomes(events: DataFrame, gap: str = "24 hours", gap_seconds: int = 86400) -> DataFrame:
    """Tries with the outcomes of the same session and stage within ``gap``.

    The time bucket is part of the join key, so one long session is spread over
    tasks and its state ages out bucket by bucket.  Tries without an outcome
    come with nulls once the watermark has passed them.
    """
    def bucket(c):
        return F.floor(F.unix_timestamp(c) / gap_seconds)

    t = events.where("status = 'try'").select("session_id", "stage", F.col("event_id").alias("try_id"), F.col("ts").alias("try_ts")).withWatermark("try_ts", WATERMARK)
    o = events.where("status <> 'try'").select(F.col("session_id").alias("o_session"), F.col("stage").alias("o_stage"), F.col("event_id").alias("out_id"), F.col("ts").alias("out_ts"), "status").withWatermark("out_ts", WATERMARK)
    o = o.withColumn("o_b", F.explode(F.array(bucket("out_ts"), bucket("out_ts") - 1)))
    t = t.withColumn("b", bucket("try_ts"))
    on = (
        (F.col("session_id") == F.col("o_session")) & (F.col("stage") == F.col("o_stage")) & (F.col("b") == F.col("o_b"))
        & (F.col("out_ts") > F.col("try_ts")) & (F.col("out_ts") <= F.col("try_ts") + F.expr(f"interval {gap}"))
    )
    return t.join(o, on, "leftOuter").select("session_id", "stage", "try_id", "try_ts", "out_id", "out_ts", "status")


def first_outcomes(matches: DataFrame) -> DataFrame:
    """The first outcome of every try."""
    m = F.struct("out_ts", "out_id", "status")
    f = matches.groupBy("session_id", "stage", "try_id", "try_ts").agg(F.min(F.when(F.col("out_ts").isNotNull(), m)).alias("m"))
    ms = (F.unix_micros(F.col("m.out_ts")) - F.unix_micros("try_ts")) / 1000.0
    return f.select("session_id", "stage", "try_id", F.col("m.out_id").alias("out_id"), F.col("m.status").alias("status"), ms.alias("elapsed_ms"))


def settle_tries(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Every try of a table of events with its first outcome; nulls where none came."""
    tries = events.where("status = 'try'").select("session_id", "stage", F.col("event_id").alias("try_id"))
    found = first_outcomes(matches.where("out_id is not null"))
    return tries.join(found, ["session_id", "stage", "try_id"], "left")


def stream_coverage(points: DataFrame, sites: DataFrame, radius_m: float, keys=("aoi_id",)) -> DataFrame:
    """New demand scored against a fixed site set: the tree is built once, used per batch."""
    tree = SiteTree(sites, list(keys))

    def score(batch: DataFrame) -> DataFrame:
        return nearest_site(batch, tree, keys).withColumn("covered", F.col("dist_m") <= radius_m)

    return run_batches(points, "scored", score, mode="append")


def latest_status(events: DataFrame) -> DataFrame:
    """Newest status per session and whether it ever failed (update mode)."""
    at = F.struct("ts", "event_id")
    return events.withWatermark("ts", WATERMARK).groupBy("session_id").agg(
        F.max(at).alias("at"), F.max_by("status", at).alias("status"), F.bool_or(F.col("status") == "fail").alias("has_error")
    )


def newest_per_key(table: DataFrame, key: str) -> DataFrame:
    """Last version of every key over the batches of an update-mode table."""
    cols = [c for c in table.columns if c not in (key, "batch")]
    return table.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("m")).select(key, "m.*")


def dedup_events(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])
