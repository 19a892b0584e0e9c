"""Application state of postings folded from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.functions.text import squeeze

SETTLED = ("applied", "not_interested")
STATES = ("not_applied", "applied", "not_interested", "pending")


def normal_state(c: Column) -> Column:
    """One of the four states, or null."""
    text = F.lower(F.replace(squeeze(c), F.lit("-"), F.lit("_")))
    return F.when(text.isin(*STATES), text)


def fold_events(events: DataFrame) -> DataFrame:
    """(posting_id, status, confirmation_needed, pending_since) after all events (posting_id, ts, seq, action).

    ``opened`` makes a posting pending unless it is applied or not of interest; any other action sets that state;
    unknown actions do nothing.  A set state decides alone and only the last opening counts, so the last of each is
    all that need be known: one aggregation that combines on the map side, in a stream as well as in a batch, and in
    whatever order events come.
    """
    rows = events.withColumns({"at": F.struct("ts", "seq"), "set": normal_state(F.col("action"))}).where("set is not null or action = 'opened'")
    is_set = F.col("set").isNotNull()
    last = rows.groupBy("posting_id").agg(
        F.max_by("set", F.when(is_set, F.col("at"))).alias("set"), F.max(F.when(is_set, F.col("at"))).alias("set_at"),
        F.max(F.when(~is_set, F.col("at"))).alias("opened_at")
    )
    free = F.col("opened_at").isNotNull() & (F.col("set").isNull() | ((F.col("opened_at") > F.col("set_at")) & ~F.col("set").isin(*SETTLED)))
    status = F.when(free | (F.col("set") == "pending"), "pending").otherwise(F.col("set"))
    since = F.when(free, F.col("opened_at.ts")).when(F.col("set") == "pending", F.col("set_at.ts"))
    return last.select("posting_id", status.alias("status"), F.coalesce(status == "pending", F.lit(False)).alias("confirmation_needed"), since.alias("pending_since"))
