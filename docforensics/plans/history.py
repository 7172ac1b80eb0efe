"""Queries of the jobs intake and history_analytics, and batch twins of live_intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fx
from ..operators import history as op
from ..streaming import intake as live
from .registry import query


@query("select page_id, case when ext not in ('.jpg', '.jpeg', '.png', '.bmp', '.tif', '.tiff', '.webp') then 400 when n > 20971520 then 413 when n = 0 then 400 else 200 end as status from (select page_id, strlen(html) as n, case when regexp_extract(url, '[^/.](\\.[^./]*)$', 1) = '' then '.jpg' else lower(regexp_extract(url, '[^/.](\\.[^./]*)$', 1)) end as ext from pages)")
def intake_status(spark, sf_dir):
    from ..sources import tables

    d = fx(spark, sf_dir, "pages").select("page_id", tables.extension(F.col("url")).alias("ext"), F.octet_length("html").alias("length"))
    return tables.intake_status(d).select("page_id", "status")


@query("select scan_id, line_no, word_no, text, conf from fx_tokens where conf >= 20 and trim(text) <> ''")
def read_ocr_tokens(spark, sf_dir):
    from ..sources import tables

    d = fx(spark, sf_dir, "fx_tokens").withColumn("conf", F.col("conf").cast("string"))
    return tables.clean_tokens(d).select("scan_id", "line_no", "word_no", "text", "conf")


@query("select doc_id, sha256(text) as sha256 from documents")
def content_hash(spark, sf_dir):
    return fx(spark, sf_dir, "documents").select("doc_id", op.content_hash(F.col("text")).alias("sha256"))


@query("select doc_id, min(doc_id) over (partition by text) as result_of, doc_id = min(doc_id) over (partition by text) as analysed from documents")
def dedup_scans(spark, sf_dir):
    d = fx(spark, sf_dir, "documents").select("doc_id", op.content_hash(F.col("text")).alias("sha256"))
    return op.dedup_scans(d, order_col="doc_id").select("doc_id", "result_of", "analysed")


@query("select user_id, max(event_id) as last_event from events group by user_id order by max(ts) desc, user_id limit 32")
def recent_results(spark, sf_dir):
    d = fx(spark, sf_dir, "events")
    last = op.recent_results(d, "user_id", "ts", 32)
    return last.join(d, "user_id").groupBy("user_id").agg(F.max("event_id").alias("last_event"))


@query(
    """with d as (select event_id, user_id, cast(ts as date) as day, row_number() over (partition by cast(ts as date) order by ts, event_id) as i from events),
  p as (select *, lag(i) over (partition by day, user_id order by i) as p from d)
  select event_id, p is not null and (select count(distinct b.user_id) from d b where b.day = p.day and b.i > p.p and b.i < p.i) < 16 as hit from p"""
)
def lru_hit_audit(spark, sf_dir):
    d = fx(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"))
    return op.lru_hit_audit(d, ["day"], "user_id", ["ts", "event_id"], 16).select("event_id", "hit")


@query("select id, cast(row_number() over (order by ts desc, id desc) as bigint) as number, filename from fx_log")
def scan_history(spark, sf_dir):
    return op.scan_history(fx(spark, sf_dir, "fx_log")).select("id", F.col("number").cast("bigint").alias("number"), "filename")


_ODD = "(select id, filename, case when id % 50 = 0 then null when id % 997 = 1 then timestamp '1970-01-01 00:00:00' when id % 3 = 0 then timestamp '2024-01-01 00:00:00' else ts end as ts from fx_log)"


@query(f"select id, cast(row_number() over (order by ts desc nulls last, id desc) as bigint) as number from {_ODD}")
def scan_history_odd_times(spark, sf_dir):
    """Some rows without a time, some far from all others, a third at one time."""
    ts = F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 997 == 1, F.expr("timestamp '1970-01-01 00:00:00'")).when(F.col("id") % 3 == 0, F.expr("timestamp '2024-01-01 00:00:00'")).otherwise(F.col("ts"))
    return op.scan_history(fx(spark, sf_dir, "fx_log").withColumn("ts", ts)).select("id", F.col("number").cast("bigint").alias("number"))


@query(
    """with d as (select event_id, user_id, row_number() over (order by ts, event_id) as i from events where event_id % 5 = 0),
  p as (select *, lag(i) over (partition by user_id order by i) as p from d)
  select event_id, p is not null and (select count(distinct b.user_id) from d b where b.i > p.p and b.i < p.i) < 64 as hit from p"""
)
def lru_hit_audit_one_session(spark, sf_dir):
    """All requests of some kinds as one session: no task holds it."""
    d = fx(spark, sf_dir, "events").where("event_id % 5 = 0").select("event_id", "user_id", "ts", F.lit("all").alias("session"))
    return op.lru_hit_audit(d, ["session"], "user_id", ["ts", "event_id"], 64).select("event_id", "hit")


@query("select page_id, url from pages where contains(lower(url), 'example.org/en')")
def search_history(spark, sf_dir):
    return op.search_history(fx(spark, sf_dir, "pages"), "url", "Example.org/EN").select("page_id", "url")


@query("select id, first_value(id) over (partition by filename order by ts desc, id desc) as image_id from fx_log")
def replay_lookup(spark, sf_dir):
    return op.replay_lookup(fx(spark, sf_dir, "fx_log")).select("id", "image_id")


@query("select verdict, mrz_type, count(*) as n, round(avg(score), 4) as mean_score from fx_log group by cube (verdict, mrz_type)")
def verdict_summary(spark, sf_dir):
    return op.verdict_summary(fx(spark, sf_dir, "fx_log"))


@query("select cast(ts as date) as day, verdict, count(*) as n from fx_log group by rollup (cast(ts as date), verdict)")
def daily_summary(spark, sf_dir):
    return op.daily_summary(fx(spark, sf_dir, "fx_log"))


@query("select event_id, array_to_string(list_filter(map_keys(cast(props as map(varchar, varchar))), lambda k: k not in ('a', 'b')), ',') as extra from (select event_id, map {concat('k', event_id % 3): '1', 'a': '2'} as props from events)")
def extra_fields(spark, sf_dir):
    m = F.create_map(F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")), F.lit("1"), F.lit("a"), F.lit("2"))
    return fx(spark, sf_dir, "events").select("event_id", F.array_join(op.extra_fields(m, ("a", "b")), ",").alias("extra"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def removed_items(spark, sf_dir):
    return op.removed_items(fx(spark, sf_dir, "documents").select("doc_id"), fx(spark, sf_dir, "labels"), "doc_id")


@query(
    """with recursive f as (select session, seq, row_number() over (partition by session order by ts, seq) as i, variance > 600 and corners_lit as ok from fx_frames),
  r as (select session, seq, i, case when ok then 1 else 0 end as c from f where i = 1
        union all select f.session, f.seq, f.i, case when f.ok then least(c + 1, 40) else greatest(c - 2, 0) end from r join f on f.session = r.session and f.i = r.i + 1)
  select seq, cast(c as int) as counter, c >= 5 as stable from r"""
)
def stream_frame_stability(spark, sf_dir):
    return live.stability(fx(spark, sf_dir, "fx_frames"), stable_at=5).select("seq", "counter", "stable")


@query("select time_bucket(interval 1 hour, ts) as start, verdict, count(*) as n from fx_log group by all")
def stream_verdict_windows(spark, sf_dir):
    return live.verdict_windows(fx(spark, sf_dir, "fx_log"), "1 hour").select("start", "verdict", "n")


@query(
    """with s as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as new from fx_log),
  g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from s)
  select user_id, min(ts) as start, count(*) as n from g group by user_id, k"""
)
def stream_session_windows(spark, sf_dir):
    return live.session_counts(fx(spark, sf_dir, "fx_log"), "user_id", "2 hours").select("user_id", "start", "n")
