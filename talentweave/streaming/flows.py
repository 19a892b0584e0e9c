"""Structured Streaming flows: captures into snapshots, application events, scan progress."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.operators.state import fold_events
from talentweave.operators.sync import publish
from talentweave.sources.snapshots import publish_sources


def application_states(events: DataFrame) -> DataFrame:
    """A posting's state after each micro-batch (update mode), as ``fold_events`` has it; events (posting_id, ts, seq, action).

    The state is two events a posting, the last that set a state and the last opening, whatever the number of events.
    An event that arrives after later ones gives what it would have given in order, however late it is.
    """
    return fold_events(events)


def progress_states(events: DataFrame) -> DataFrame:
    """Per source: last page, detail pages, whether it stopped early, the last status and the counts that came with it."""
    at = F.struct("ts", "seq")
    return events.groupBy("source_id").agg(
        F.max("page").alias("last_page"), F.coalesce(F.sum("detail_pages"), F.lit(0)).alias("detail_pages"), F.coalesce(
            F.bool_or("stopped_early"), F.lit(False)
        ).alias("stopped_early"),
        F.max_by("status", F.when(F.col("status").isNotNull(), at)).alias("status"), F.count("*").alias("n_events"),
    )


def capture_counts(captures: DataFrame, late: str = "2 hours") -> DataFrame:
    """Captures by hour; those later than the watermark are not counted (they are merged all the same)."""
    return captures.withWatermark("captured_at", late).groupBy(
        F.window("captured_at", "1 hour").alias("hour"), "source_id"
    ).agg(F.count("*").alias("n"))


def once(captures: DataFrame, keys: tuple[str, ...] = ("source_id", "external_id", "content_hash"), at: str = "captured_at", late: str = "1 day") -> DataFrame:
    """Captures without those that came before within the watermark, in this micro-batch or an earlier one.

    A capture without a time counts as made when its micro-batch began.  State is dropped as the watermark passes.
    """
    timed = captures.withColumn(at, F.coalesce(at, F.current_timestamp())).withWatermark(at, late)
    return timed.dropDuplicatesWithinWatermark(list(keys))


def merge_batches(
    prepare: Callable[[DataFrame], DataFrame], root: str, empty: DataFrame, as_of: Callable[[int], dt.datetime]
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each micro-batch is merged into the snapshot and published as version batch id + 1.

    Only sources that the batch holds are rewritten.  A batch that is replayed finds its version published, or writes
    it anew on top of the version before.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        update = lambda stored, incoming: publish(stored, incoming, as_of(batch_id), deactivate_missing=False)
        publish_sources(batch.sparkSession, root, batch_id + 1, prepare(batch), update, empty)

    return merge
