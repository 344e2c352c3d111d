"""Streaming jobs over the events, drained to tables; oracles are their batch twins."""

from pyspark.sql import functions as F

from ..fixtures import ACTIVITY, DEMAND
from ..operators.measures import top_n
from ..streaming import jobs
from .registry import NEAREST_SQL, query

ACT = ("activity",)


def _plain(df, *names):
    """Timestamps without a zone, as the oracle has them."""
    for n in names:
        df = df.withColumn(n, F.col(n).cast("timestamp_ntz"))
    return df


def _stream(v):
    return jobs.file_stream(v.spark, f"{v.dir}/events.parquet").selectExpr(*ACTIVITY)


_MARK = "(select max(ts) - interval 10 minute from activity)"
_AGG = "count(*) filter (status='try') as n_try, count(*) filter (status='ok') as n_ok, count(*) filter (status='fail') as n_fail, round(sum(duration_ms),3) as total_ms, count(*) as n"


@query("stage_metrics_tumbling", f"select * from (select time_bucket(interval 5 minute, ts) as start, time_bucket(interval 5 minute, ts) + interval 5 minute as \"end\", stage, {_AGG} from activity group by all) where \"end\" <= {_MARK}", ACT)
def stage_metrics_tumbling(v):
    return _plain(jobs.run_append(jobs.stage_metrics(_stream(v)), "tumbling").withColumn("total_ms", F.round("total_ms", 3)), "start", "end")


@query("stage_metrics_sliding", f"select * from (select s as start, s + interval 10 minute as \"end\", stage, {_AGG} from (select *, time_bucket(interval 5 minute, ts) - k * interval 5 minute as s from activity, (values (0),(1)) t(k)) group by all) where \"end\" <= {_MARK}", ACT)
def stage_metrics_sliding(v):
    return _plain(jobs.run_append(jobs.stage_metrics(_stream(v), "10 minutes", "5 minutes"), "sliding").withColumn("total_ms", F.round("total_ms", 3)), "start", "end")


@query("session_ttl", f"""with g as (select *, case when ts - lag(ts) over (partition by session_id order by ts) < interval 12 hour then 0 else 1 end as brk from activity), n as (select *, sum(brk) over (partition by session_id order by ts rows unbounded preceding) as sn from g)
 select session_id, min(ts) as start, max(ts) as last_ts, count(*) as n_events from n group by session_id, sn having max(ts) + interval 12 hour <= {_MARK}""", ACT)
def session_ttl(v):
    return _plain(jobs.run_append(jobs.session_ttl(_stream(v)), "sessions"), "start", "last_ts")


@query("recent_events_per_session", "select session_id, event_id, ts, stage, status from (select *, row_number() over (partition by session_id order by ts desc, event_id desc) as r from activity) where r <= 50", ACT)
def recent_events_per_session(v):
    t = jobs.run_batches(jobs.recent_events(_stream(v)), "recent")
    last = t.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return _plain(t.join(last, ["session_id", "batch"]).drop("batch"), "ts")


@query("last_n_events", "select session_id, r as rank, event_id, ts, status, r <= 30 as shown, r <= 20 as replayed from (select *, row_number() over (partition by session_id order by ts desc, event_id desc) as r from activity) where r <= 50", ACT)
def last_n_events(v):
    t = top_n(v.activity(), ["session_id"], [F.desc("ts"), F.desc("event_id")], 50)
    return _plain(t, "ts").select("session_id", "rank", "event_id", "ts", "status", (F.col("rank") <= 30).alias("shown"), (F.col("rank") <= 20).alias("replayed"))


@query("try_outcome_match", """select t.session_id, t.stage, t.event_id as try_id, arg_min(o.event_id, (o.ts, o.event_id)) as out_id, arg_min(o.status, (o.ts, o.event_id)) as status, (epoch_us(min(o.ts)) - epoch_us(any_value(t.ts)))/1000e0 as elapsed_ms
 from (select * from activity where status='try') t left join (select * from activity where status<>'try') o on o.session_id=t.session_id and o.stage=t.stage and o.ts > t.ts and o.ts <= t.ts + interval 24 hour group by 1,2,3""", ACT)
def try_outcome_match(v):
    m = jobs.run_append(jobs.try_outcomes(_stream(v)), "outcomes")
    return jobs.settle_tries(v.activity(), m)


@query("stream_coverage", "select aoi_id, demand_id, site_id, dist_m, dist_m <= 10000 as covered from (" + NEAREST_SQL + ")", ("demand", "candidates"))
def stream_coverage(v):
    pts = jobs.file_stream(v.spark, f"{v.dir}/customer.parquet").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(*DEMAND)
    return jobs.stream_coverage(pts, v.candidates(), 10000.0).select("aoi_id", "demand_id", "site_id", "dist_m", "covered")


@query("latest_status", "select session_id, arg_max(status, (ts, event_id)) as status, bool_or(status='fail') as has_error from activity group by 1", ACT)
def latest_status(v):
    t = jobs.run_batches(jobs.latest_status(_stream(v)), "status")
    return jobs.newest_per_key(t, "session_id").select("session_id", "status", "has_error")


@query("dedup_events", "select session_id, event_id, ts, stage, status, duration_ms from activity", ACT)
def dedup_events(v):
    """Every event is sent twice; one of each pair comes out."""
    s = _stream(v)
    return _plain(jobs.run_append(jobs.dedup_events(s.union(s)), "deduped"), "ts")
