"""Snapshots of sources against the stored table: created, updated, unchanged, deactivated."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.operators.dedupe import keep_first
from talentweave.operators.sizes import looked_up

KEYS = ("source_id", "external_id")


def compare(stored: DataFrame, incoming: DataFrame, deactivate_missing: bool = True, value: str = "content_hash") -> DataFrame:
    """(source_id, external_id, action): one full outer join on the key, and a look at the few sources that sent.

    Actions: created, updated, unchanged; for stored active rows that are missing: deactivated, if asked for and
    their source sent anything, else kept.  Rows with equal keys in a batch count once.
    """
    new = keep_first(incoming.select(*KEYS, F.col(value).alias("new")), list(KEYS), ["new"])
    old = stored.select(*KEYS, F.col(value).alias("old"), "active")
    both = old.withColumn("was", F.lit(True)).join(new.withColumn("is", F.lit(True)), list(KEYS), "full_outer")
    if deactivate_missing:
        sent = looked_up(incoming.select(F.col("source_id").alias("sent")).distinct(), "sent")
        both = both.join(sent, both["source_id"] == sent["sent"], "left")
    else:
        both = both.withColumn("sent", F.lit(None).cast("long"))
    action = (
        F.when(F.col("was").isNull(), "created")
        .when(F.col("is").isNotNull() & F.col("old").eqNullSafe(F.col("new")), "unchanged")
        .when(F.col("is").isNotNull(), "updated")
        .when(F.col("active") & F.col("sent").isNotNull(), "deactivated")
        .otherwise("kept")
    )
    return both.select(*KEYS, action.alias("action"))


def counts(actions: DataFrame) -> DataFrame:
    """Created, updated, unchanged and deactivated rows of each source."""
    return actions.groupBy("source_id").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("created", "updated", "unchanged", "deactivated")])


def publish(stored: DataFrame, incoming: DataFrame, as_of: dt.datetime, deactivate_missing: bool = True) -> DataFrame:
    """The stored table after a batch; columns as stored.

    A new row is seen first now.  An equal content hash only refreshes last_seen_at, activity and the URL (a changed
    URL counts as an update in time).  Another hash takes all content columns and drops the vector; application
    state and first_seen_at stay as they are.
    """
    now = F.lit(as_of)
    content = [c for c in stored.columns if c not in (*KEYS, "id", "active", "first_seen_at", "last_seen_at", "last_updated_at", "url", "canonical_url", "content_hash", "embedding", "application_status", "application_confirmation_needed")]
    new = keep_first(incoming, list(KEYS), ["content_hash"])
    given = set(new.columns)
    new = new.select(*KEYS, *[F.col(c).alias(f"n_{c}") for c in new.columns if c not in KEYS]).withColumn("n_is", F.lit(True))
    old = stored.withColumn("o_was", F.lit(True))
    rows = old.join(new, list(KEYS), "full_outer")
    if deactivate_missing:
        sent = looked_up(incoming.select(F.col("source_id").alias("n_sent")).distinct(), "sent")
        rows = rows.join(sent, rows["source_id"] == sent["n_sent"], "left")
    else:
        rows = rows.withColumn("n_sent", F.lit(None).cast("long"))
    fresh, seen = F.col("o_was").isNull(), F.col("n_is").isNotNull()
    same = F.col("o_was").isNotNull() & seen & F.col("content_hash").eqNullSafe(F.col("n_content_hash") if "content_hash" in given else F.lit(None))
    changed = seen & ~same
    moved = same & ~F.col("url").eqNullSafe(F.col("n_url")) if "url" in given else F.lit(False)

    def pick(name: str, when: Column) -> Column:
        return F.when(when, F.col(f"n_{name}")).otherwise(F.col(name)) if name in given else F.col(name)

    missing = F.col("o_was").isNotNull() & ~seen & F.col("n_sent").isNotNull() & F.lit(deactivate_missing)
    out = {c: pick(c, changed) for c in content}
    out |= {
        "content_hash": pick("content_hash", changed), "url": pick("url", seen), "canonical_url": pick("canonical_url", seen),
        "embedding": F.when(
            changed, F.col("n_embedding") if "embedding" in given else F.lit(None)
        ).otherwise(F.col("embedding")) if "embedding" in stored.columns else None,
        "active": F.when(seen, True).when(missing, False).otherwise(F.col("active")),
        "first_seen_at": F.when(fresh, now).otherwise(F.col("first_seen_at")), "last_seen_at": F.when(seen, now).otherwise(F.col("last_seen_at")),
        "last_updated_at": F.when(changed | moved, now).otherwise(F.col("last_updated_at")),
        "application_status": F.coalesce("application_status", F.lit("not_applied")), "application_confirmation_needed": F.coalesce(
            "application_confirmation_needed", F.lit(False)
        ),
    }
    return rows.select(*[(F.col(c) if c in KEYS or c not in out else out[c]).alias(c) for c in stored.columns])


def scan_state(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Sources after their scans: the new values where there are any, the old ones else."""
    fields = [c for c in results.columns if c != "source_id"]
    new = results.select(F.col("source_id").alias("id"), *[F.col(c).alias(f"n_{c}") for c in fields])
    rows = sources.join(new, "id", "left")
    return rows.select(*[F.coalesce(f"n_{c}", c).alias(c) if c in fields else F.col(c) for c in sources.columns])


def fill_vectors(rows: DataFrame, vectors: DataFrame, key: str = "id", model: str | None = None) -> DataFrame:
    """Vectors taken over only where there is none, or one of another model."""
    stale = F.col("embedding").isNull() if model is None else F.col("embedding").isNull() | ~F.col("model").eqNullSafe(F.lit(model))
    new = vectors.select(key, F.col("embedding").alias("_new"))
    out = rows.join(new, key, "left").withColumn("embedding", F.when(stale, F.col("_new")).otherwise(F.col("embedding"))).drop("_new")
    return out if model is None else out.withColumn("model", F.when(F.col("embedding").isNotNull(), F.lit(model)).otherwise(F.col("model")))


def without_sources(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of sources that were not removed."""
    return rows.join(removed.select(F.col("id").alias("source_id")), "source_id", "left_anti")


def cleared(postings: DataFrame, scans: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All results of scans taken back: no postings, no scans, and sources as if they had never been scanned."""
    never = {c: F.lit(None).cast(sources.schema[c].dataType) for c in ("etag", "last_modified", "last_scan_at", "last_status") if c in sources.columns}
    return postings.where("false"), scans.where("false"), sources.withColumns(never)


def upsert(stored: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Insert or update by key; columns the change leaves null stay."""
    new = changes.select(key, *[F.col(c).alias(f"n_{c}") for c in changes.columns if c != key])
    rows = stored.join(new, key, "full_outer")
    return rows.select(*[F.coalesce(f"n_{c}", c).alias(c) if f"n_{c}" in new.columns else F.col(c) for c in stored.columns])
