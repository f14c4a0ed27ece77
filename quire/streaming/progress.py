"""Progress of jobs as streams.

State is keyed by job and bounded by what a job needs: a number, or the messages that came before their job was known.
Rows of a key arrive in no order within a trigger, so every state function orders them first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.jobs import overall
from quire.session import ship

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def running_progress(messages: DataFrame) -> DataFrame:
    """(job, seq, overall) from a stream (job, seq, stage_idx, pct): how far each job is, never falling."""
    ship(messages.sparkSession)
    rows = messages.select("job", "seq", overall(F.col("stage_idx"), F.col("pct")).alias("raw"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        most = state.get[0] if state.exists else 0.0
        seq, raw = (np.concatenate(x) for x in zip(*((p["seq"].to_numpy(), p["raw"].to_numpy()) for p in parts), strict=True))
        order = seq.argsort(kind="stable")
        far = np.fmax(np.fmax.accumulate(raw[order]), most)
        state.update((float(far[-1]),))
        yield pd.DataFrame({"job": key[0], "seq": seq[order], "overall": far})

    return rows.groupBy("job").applyInPandasWithState(step, "job bigint, seq bigint, overall double", "most double", "append", GroupStateTimeout.NoTimeout)


def job_board(messages: DataFrame, keep: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """(engine_id, job, seq, kind, detail) from a stream (engine_id, seq, ts, kind, job, detail).

    kind is attach (names the engine id's job), dismiss, or an event. Events before their attach are held and follow it;
    events after a dismiss are dropped. A job's state, its tombstone included, goes when the stream's time, by ts, is
    ``keep`` past its last message.
    """
    ship(messages.sparkSession)
    span = pd.Timedelta(keep)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        job, gone, held = state.get if state.exists else (None, False, [])
        held = [tuple(h) for h in held]
        out = []
        rows = pd.concat(list(parts)).sort_values("seq")
        for r in rows.itertuples(index=False):
            if gone:
                continue
            if r.kind == "dismiss":
                gone, held = True, []
            elif r.kind == "attach":
                job = r.job
                out += [(key[0], job, *h) for h in held]
                held = []
            elif job is None:
                held.append((int(r.seq), r.kind, r.detail))
            else:
                out.append((key[0], job, int(r.seq), r.kind, r.detail))
        state.update((job, gone, held))
        last = max(int((rows["ts"].max() + span).timestamp() * 1000), state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(last)
        yield pd.DataFrame(out, columns=["engine_id", "job", "seq", "kind", "detail"])

    return messages.withWatermark("ts", delay).groupBy("engine_id").applyInPandasWithState(
        step, "engine_id string, job string, seq bigint, kind string, detail string", "job string, gone boolean, held array<struct<seq:bigint,kind:string,detail:string>>", "append", GroupStateTimeout.EventTimeTimeout
    )


def replies(requests: DataFrame, answers: DataFrame, timeout: str = "1 hour") -> DataFrame:
    """Requests (id, ts, method) joined with answers (id, ts, result) that come within the timeout, as streams."""
    q = requests.withWatermark("ts", timeout).select(F.col("id"), F.col("ts").alias("asked"), "method").alias("q")
    a = answers.withWatermark("ts", timeout).select(F.col("id").alias("aid"), F.col("ts").alias("answered"), "result").alias("a")
    within = (F.col("id") == F.col("aid")) & (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"interval {timeout}"))
    return q.join(a, within).select("id", "method", "asked", "answered", "result")


def live_only(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events once each, by event_id within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Extension: (user_id, start, n) of sessions."""
    s = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")


def windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Extension: (start, event_type, n) of tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


def run_all(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now and writes Parquet to ``out``."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
