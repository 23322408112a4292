"""Alert streams: enrichment, fan-out to handlers, event-time windows and a keyed token bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from narralake.operators.consistency import alert_severity

CAPACITY, REFILL, IDLE = 5.0, 5.0, 60
Handler = Callable[[DataFrame, int], None]


def publish(alerts: DataFrame, time_col: str = "ts") -> DataFrame:
    """What a channel carries: every alert with its time and type, as JSON."""
    return alerts.select(F.to_json(F.struct("*", F.col(time_col).alias("timestamp"), F.lit("contradiction_detected").alias("alert_type"))).alias("value"))


def enrich(alerts: DataFrame, time_col: str = "ts") -> DataFrame:
    """Severity from the reason, status active, type and detection time, which default to a contradiction and the event's own time."""
    own = lambda name, default: F.coalesce(F.col(name), default) if name in alerts.columns else default
    return alerts.select(*[c for c in alerts.columns if c not in ("alert_type", "detected_at")], alert_severity(F.col("reason")).alias("severity"), F.lit("active").alias("status"), own("alert_type", F.lit("contradiction_detected")).alias("alert_type"), own("detected_at", F.col(time_col)).alias("detected_at"))


def for_user(alerts: DataFrame, user_id: str) -> DataFrame:
    """What one user's client is sent."""
    return alerts.filter(F.col("user_id").cast("string") == user_id)


def fan_out(alerts: DataFrame, handlers: dict[str, Handler], checkpoint: str, failures: list[tuple[str, str]] | None = None, **trigger: Any) -> StreamingQuery:
    """Every micro-batch goes to all handlers; one that fails is noted and does not stop the others."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, handler in handlers.items():
            try:
                handler(batch, number)
            except Exception as error:  # a handler is foreign code
                if failures is not None:
                    failures.append((name, str(error)))
        batch.unpersist()

    return alerts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def windowed_counts(events: DataFrame, width: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"))


def take_tokens(times: list[float], tokens: float = CAPACITY, last: float | None = None) -> tuple[list[bool], float, float | None]:
    """(allowed, tokens left, time of the last refill). A denied request changes nothing."""
    out = []
    for t in times:
        now = CAPACITY if last is None else min(CAPACITY, tokens + (t - last) * REFILL)
        if now < 1:
            out.append(False)
            continue
        tokens, last = now - 1, t
        out.append(True)
    return out, tokens, last


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (user_id, event_id, at) come sorted by user and time; one user's tokens are held at a time, never the user's rows."""
    user, tokens, last = None, CAPACITY, None
    for batch in batches:
        out = []
        for who, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if who != user:
                user, tokens, last = who, CAPACITY, None
            (ok,), tokens, last = take_tokens([at], tokens, last)
            out.append(ok)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], ["user_id", "event_id", "allowed"])


def token_bucket(events: DataFrame) -> DataFrame:
    """Batch twin: user_id, event_id, allowed. A user's requests are one ordered fold, streamed in batches; users spread over tasks."""
    timed = events.select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("at")).filter("user_id IS NOT NULL AND at IS NOT NULL")
    return timed.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInArrow(_bucket, "user_id long, event_id long, allowed boolean")


def token_bucket_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same as a stateful stream. A user's state goes when the watermark is IDLE seconds beyond the user's last event:
    an idle bucket is full again, so nothing is lost. Requests of a user that come out of order between batches are folded as they come."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        tokens, last = state.get if state.exists else (CAPACITY, None)
        allowed, tokens, last = take_tokens(rows["at"].tolist(), tokens, last)
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int(1000 * (rows["at"].max() + IDLE)), state.getCurrentWatermarkMs() + 1))
        yield rows[["user_id", "event_id"]].assign(allowed=allowed)

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("user_id", "event_id", "ts", F.col("ts").cast("double").alias("at")).filter("user_id IS NOT NULL")
    return timed.groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)
