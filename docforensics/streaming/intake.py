"""Streaming forms: uploads analysed once, frames until stable, live counts. Each works on streams and on tables."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST, DOWN, STABLE = 40, 2, 30


def intake_dedup(uploads: DataFrame, ts: str = "received_at", retention: str = "1 hour") -> DataFrame:
    """Uploads whose content wasn't seen within the retention time."""
    return uploads.withWatermark(ts, retention).dropDuplicatesWithinWatermark(["sha256"])


def intake_answers(uploads: DataFrame, key: str = "scan_id", ts: str = "received_at", retention: str = "1 hour") -> DataFrame:
    """Every upload of a stream with the first of equal content (result_of) and whether it is that one itself (analysed).

    A content's first upload is remembered for the retention time after it, by the uploads' own times;
    an equal one that comes later than that is analysed anew. Uploads later than the watermark, which
    lags by the retention time, are dropped. Uploads without a hash equal no other. Columns: key, sha256, ts, result_of, analysed.
    """
    kind = {f.name: f.dataType for f in uploads.schema}
    keep = pd.Timedelta(retention)
    late = uploads.withWatermark(ts, retention).select(key, "sha256", ts)
    out = T.StructType([T.StructField(key, kind[key]), T.StructField("sha256", T.StringType()), T.StructField(ts, kind[ts]), T.StructField("result_of", kind[key]), T.StructField("analysed", T.BooleanType())])
    held = T.StructType([T.StructField("result_of", kind[key]), T.StructField("until", T.LongType())])

    def answer(sha, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        first, until = state.get if state.exists else (None, None)
        rows = pd.concat([*batches]).sort_values([ts, key])
        result, own = [], []
        for i, at in zip(rows[key], rows[ts], strict=True):
            new = until is None or at.value > until
            if new:
                first, until = i, (at + keep).value
            result.append(first)
            own.append(new)
        state.update((first, until))
        state.setTimeoutTimestamp(max(until // 1_000_000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: rows[key], "sha256": sha[0], ts: rows[ts], "result_of": result, "analysed": own})

    known = late.where("sha256 is not null").groupBy("sha256").applyInPandasWithState(answer, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    return known.unionByName(late.where("sha256 is null").select(key, "sha256", ts, F.col(key).alias("result_of"), F.lit(True).alias("analysed")))


def verdict_windows(log: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by window and verdict; rows later than the watermark are dropped from streams."""
    d = log.withWatermark("ts", late) if log.isStreaming else log
    counted = d.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "verdict").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "verdict", "n")


def session_counts(log: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    d = log.withWatermark("ts", late) if log.isStreaming else log
    counted = d.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def frame_ok() -> Column:
    return (F.col("variance") > 600) & F.col("corners_lit")


def _step(c: int, ok: bool) -> int:
    return min(c + 1, MOST) if ok else max(c - DOWN, 0)


def stability(frames: DataFrame, stable_at: int = STABLE) -> DataFrame:
    """Counter after each frame of a session: up by one to 40 if the frame is good, else down by two to 0.

    A run of frames maps a counter x to min(hi, max(lo, x + add)), and such maps compose to one of
    the same form. So each hour of a session is composed by itself, the hours' maps are folded in
    order, and each frame's map is applied to where its hour starts: a session is no load for one
    task but for one row an hour. Frames without a good picture or a variance count as bad.
    """
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("hour")
    ok = F.coalesce(frame_ok(), F.lit(False)).alias("ok")
    rows = frames.select("session", hour, "ts", "seq", ok).repartition("session", "hour").sortWithinPartitions("session", "hour", "ts", "seq")

    def compose(batches):
        at = add = lo = hi = None
        for b in batches:
            out = []
            for key, good in zip(zip(b.column("session").to_pylist(), b.column("hour").to_pylist(), strict=True), b.column("ok").to_pylist(), strict=True):
                if key != at:
                    at, add, lo, hi = key, 0, 0, MOST
                add, lo, hi = add + (1 if good else -DOWN), _step(lo, good), _step(hi, good)
                out.append((add, lo, hi))
            maps = [pa.array([m[k] for m in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("session", "hour", "ts", "seq")), *maps], ["session", "hour", "ts", "seq", "add", "lo", "hi"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    mapped = rows.mapInArrow(compose, f"session {kind['session']}, hour bigint, ts {kind['ts']}, seq {kind['seq']}, add bigint, lo bigint, hi bigint")
    whole = mapped.groupBy("session", "hour").agg(F.max_by(F.struct("add", "lo", "hi"), F.struct("ts", "seq", F.abs("add"))).alias("m")).select("session", "hour", "m.*")

    def fold(batches):
        at, c = None, 0
        for b in batches:
            out = []
            for session, add, lo, hi in zip(*(b.column(k).to_pylist() for k in ("session", "add", "lo", "hi")), strict=True):
                if session != at or not out and at is None:
                    at, c = session, 0
                out.append(c)
                c = min(hi, max(lo, c + add))
            yield pa.RecordBatch.from_arrays([b.column("session"), b.column("hour"), pa.array(out, pa.int64())], ["session", "hour", "start"])

    starts = whole.repartition("session").sortWithinPartitions("session", "hour").mapInArrow(fold, f"session {kind['session']}, hour bigint, start bigint")
    joined = mapped.alias("f").join(starts.alias("s"), F.col("f.session").eqNullSafe(F.col("s.session")) & F.col("f.hour").eqNullSafe(F.col("s.hour")))
    counter = F.least("f.hi", F.greatest("f.lo", F.col("s.start") + F.col("f.add"))).cast("int")
    return joined.select("f.session", "f.seq", counter.alias("counter"), (counter >= stable_at).alias("stable"))


STATE = T.StructType([T.StructField("counter", T.IntegerType()), T.StructField("last", T.LongType())])
OUTPUT = T.StructType([T.StructField("session", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("counter", T.IntegerType()), T.StructField("stable", T.BooleanType())])


def stream_stability(frames: DataFrame, stable_at: int = STABLE, idle: str = "30 minutes", late: str = "1 minute") -> DataFrame:
    """The same counter over a stream, kept as state for each session; frames of a batch are taken in the order of time.

    A session without a frame for the idle time leaves the state; if it comes back, it starts from 0.
    Frames later than the watermark, which lags by `late`, are dropped.
    """
    rest = pd.Timedelta(idle)

    def update(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        c, last = state.get if state.exists else (0, None)
        rows = pd.concat([*batches]).sort_values(["ts", "seq"])
        out = []
        for seq, at, variance, lit in zip(rows["seq"], rows["ts"], rows["variance"], rows["corners_lit"], strict=True):
            if last is not None and at.value > last + rest.value:
                c = 0
            last = at.value if last is None else max(last, at.value)
            c = _step(c, bool(pd.notna(variance) and variance > 600 and pd.notna(lit) and lit))
            out.append((key[0], seq, c, c >= stable_at))
        state.update((c, last))
        state.setTimeoutTimestamp(max((last + rest.value) // 1_000_000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["session", "seq", "counter", "stable"])

    d = frames.withWatermark("ts", late).select("session", "seq", "ts", "variance", "corners_lit")
    return d.groupBy("session").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
