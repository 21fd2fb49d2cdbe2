"""Streaming: telemetry windows with a watermark, and a sliding-window rate limiter with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HITS = "key bigint, at double, hit_id bigint, allowed boolean"


def rollup(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and type of a stream; ``ts`` without zone is taken as the session's."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def judge(times: list[float], held: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Whether each hit is allowed; denied hits are not kept, so they never count against later ones."""
    out = []
    for t in times:
        held = [h for h in held if h > t - window]
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out, held


def limited(hits: DataFrame, limit: int = 20, window: float = 60.0) -> DataFrame:
    """Batch form over ``hits(key, at, hit_id)``: what the limiter would have said, key by key.

    No hit survives a gap of ``window``, so a key's hits are cut there and its parts go to any task.
    The gaps are found between buckets of ``window`` seconds, of which the first and last hit are
    known, as none is within a bucket.  A task reads its parts in order and holds one batch and the
    allowed hits of one part within the window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for batch in batches:
            parts = list(zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), strict=True))
            times = [float("nan") if t is None else t for t in batch.column("at").to_pylist()]
            allowed, i = [], 0
            while i < len(parts):
                j = i
                while j < len(parts) and parts[j] == parts[i]:
                    j += 1
                said, held = judge(times[i:j], held if parts[i] == own else [], limit, window)
                own = parts[i]
                allowed += said
                i = j
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "at", "hit_id")), pa.array(allowed, pa.bool_())], names=["key", "at", "hit_id", "allowed"])

    rows = hits.select(F.col("key").cast("bigint").alias("key"), F.col("at").cast("double").alias("at"), F.col("hit_id").cast("bigint").alias("hit_id")).withColumn("bucket", F.floor(F.col("at") / window))
    buckets = rows.groupBy("key", "bucket").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy("key").orderBy("bucket")
    cut = F.coalesce(F.col("first") - F.lag("last").over(order) >= window, F.lit(True))
    parts = buckets.withColumn("cut", cut.cast("int")).select(F.col("key").alias("k"), F.col("bucket").alias("b"), F.sum("cut").over(order).alias("part"))
    placed = rows.join(parts, rows.key.eqNullSafe(parts.k) & rows.bucket.eqNullSafe(parts.b)).select("key", "part", "at", "hit_id")
    return placed.repartition("key", "part").sortWithinPartitions("key", "part", "at", "hit_id").mapInArrow(run, HITS)


def limited_stream(hits: DataFrame, limit: int = 20, window: float = 60.0) -> DataFrame:
    """Stream form: the state of a key is its allowed hits within the window, at most ``limit`` of them.

    The hits of a key in one micro-batch come in no order, so they are held and sorted; the source's
    limit of a trigger (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) bounds them.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["at", "hit_id"])
        allowed, held = judge(pdf["at"].tolist(), held, limit, window)
        state.update((held,))
        state.setTimeoutDuration(int(window * 1000))
        yield pdf.assign(allowed=allowed)[["key", "at", "hit_id", "allowed"]]

    return hits.groupBy("key").applyInPandasWithState(run, HITS, "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
