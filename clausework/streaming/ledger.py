"""Telemetry as typed events: payloads read by event type, written once per batch, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Event types and the fields of their payloads.
PAYLOADS = {
    "review.started": "playbook string, version int, source string", "escalation.completed": "task string, tier string, needs_human boolean",
    "finding.dispositioned": "rule_key string, action string, model_tier string, confidence double, reviewer_role string", "redline.edited": "clause_key string, suggested string, final string, reviewer_role string",
    "citation.overridden": "status string, source_unit_id string", "export.created": "format string",
}
#: Fields without which a payload is of no use.
NEEDED = {"review.started": ["playbook"], "escalation.completed": ["task"], "finding.dispositioned": ["action"], "redline.edited": ["final"], "citation.overridden": ["status"], "export.created": ["format"]}


def column(event_type: str) -> str:
    return event_type.replace(".", "_")


def typed(events: DataFrame) -> DataFrame:
    """``events(event_id, event_type, payload, ...)`` with one struct column for each type, filled for rows of that type, and ``problem``.

    A problem is unknown_type, malformed (no JSON object, or a field of another type) or incomplete; such rows
    stay, with their payload as it came. Works on streams and tables alike.
    """
    read = {t: F.from_json("payload", f"{fields}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}) for t, fields in PAYLOADS.items()}
    rows = events.withColumns({f"__{column(t)}": F.when(F.col("event_type") == t, x) for t, x in read.items()})
    of = lambda t: F.col(f"__{column(t)}")
    problem = F.when(~F.coalesce(F.col("event_type").isin(list(PAYLOADS)), F.lit(False)), "unknown_type")
    for t in PAYLOADS:
        mine = F.col("event_type") == t
        lacking = F.lit(False)
        for name in NEEDED[t]:
            lacking = lacking | of(t)[name].isNull()
        problem = problem.when(mine & (of(t).isNull() | of(t)["_bad"].isNotNull()), "malformed").when(mine & lacking, "incomplete")
    rows = rows.withColumn("problem", problem)
    good = {column(t): F.when((F.col("event_type") == t) & F.col("problem").isNull(), of(t).dropFields("_bad")) for t in PAYLOADS}
    return rows.withColumns(good).drop(*[f"__{column(t)}" for t in PAYLOADS])


def dispositions(events: DataFrame) -> DataFrame:
    """Of typed events: per reviewer role, dispositions, the share accepted as they were and the mean confidence of the model."""
    d = events.where("event_type = 'finding.dispositioned' AND problem IS NULL").select("finding_dispositioned.*")
    return d.groupBy("reviewer_role").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("action") == "accept") / F.count("*"), 6).alias("accepted"), F.round(F.avg("confidence"), 6).alias("confidence"))


def append_once(path: str, failing: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch has a folder of its own, which a replay of the batch writes anew.

    So a batch that was written, but not yet marked as done when the query died, is there once. ``failing`` is
    called behind the write, for tests.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if failing:
            failing(batch_id)

    return write


def start(events: DataFrame, path: str, checkpoint: str, every: str | None = None, failing: Callable[[int], None] | None = None) -> StreamingQuery:
    """Typed events of a stream into the append-only table at ``path``.

    Without ``every`` what is there now is drained and the query ends; with it ("2 seconds") it goes on polling.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return typed(events).writeStream.foreachBatch(append_once(path, failing)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
