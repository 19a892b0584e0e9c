"""Snapshots kept by source: a version holds the rows of those sources only that its batch touched.

    root/rows/version=V/part=S/    rows of source S as version V left them
    root/manifest/version=V/       (part, version, n): which version holds each source's rows, and how many
    root/published/V               an empty file, made last; the largest number is the current version

Rows and manifest are there before the file that publishes them, and nothing that is published is ever written again.
So a writer that dies leaves the version before as it was, and its rerun writes the same partitions anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.operators.sizes import BROADCAST_ROWS, looked_up, settled
from talentweave.sources.shared import filesystem

MANIFEST = "part string, version long, n long"
#: Rows of at most so many sources are written by the tasks that merged them, one file a task and source.
FEW_PARTS = 32


def part_of(source: Column) -> Column:
    """The name of a source's partition; rows without a source have one, too."""
    return F.coalesce(source.cast("string"), F.lit("none"))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions in order."""
    files, there = filesystem(spark, f"{root}/published")
    return sorted(int(x.getPath().getName()) for x in files.listStatus(there)) if files.exists(there) else []


def current_version(spark: SparkSession, root: str) -> int | None:
    return max(versions(spark, root), default=None)


def mark_published(spark: SparkSession, root: str, version: int) -> None:
    """From now on the version is there for readers; a file is made at once or not at all."""
    files, there = filesystem(spark, f"{root}/published/{version:012d}")
    files.create(there, False).close()


def manifest(spark: SparkSession, root: str, version: int | None) -> DataFrame:
    """(part, version, n) of a published version; no rows for none."""
    if version is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST.replace("version", "held")).parquet(f"{root}/manifest/version={version}").withColumnRenamed("held", "version")


def _escaped(spark: SparkSession, part: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(part)


def _rows(spark: SparkSession, root: str, folders: list[str] | None = None) -> DataFrame | None:
    """Rows of all versions, or of some of their folders, with version and part; None where nothing was ever written."""
    found = None
    for folder in folders[:1] if folders else [f"{root}/rows"]:
        try:
            found = spark.read.parquet(folder).schema
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    if found is None:
        return None
    own = [f for f in found.fields if f.name not in ("version", "part")]
    schema = T.StructType([*own, T.StructField("version", T.LongType()), T.StructField("part", T.StringType())])
    return spark.read.schema(schema).option("basePath", f"{root}/rows").parquet(*folders or [f"{root}/rows"])


def read_version(spark: SparkSession, root: str, version: int | None, parts: DataFrame | None = None) -> DataFrame | None:
    """The snapshot as a version left it, or that of some parts; None before the first version or where there are no rows.

    Up to BROADCAST_ROWS parts are read by their folders, so that no other is even listed; more are joined.
    """
    if version is None:
        return None
    held = manifest(spark, root, version).select("part", "version")
    if parts is not None:
        held = held.join(parts, "part", "left_semi")
    named = held.limit(BROADCAST_ROWS + 1).collect()
    if len(named) <= BROADCAST_ROWS:
        folders = [f"{root}/rows/version={r['version']}/part={_escaped(spark, r['part'])}" for r in named]
        rows = _rows(spark, root, folders) if folders else None
    else:
        rows = _rows(spark, root).join(held.hint("merge"), ["version", "part"], "left_semi")
    return None if rows is None else rows.drop("version", "part")


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    return read_version(spark, root, current_version(spark, root))


def _dealt(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows as they are to be written, with even files, also where one source holds a third of all rows.

    A merge deals rows by key, so each of its tasks has a like share of every source, and moving all rows once more
    gains nothing unless sources are so many that files would be, too; only then rows are dealt by source.
    """
    return rows if touched.limit(FEW_PARTS + 1).count() <= FEW_PARTS else rows.hint("rebalance", "part")


def publish_sources(
    spark: SparkSession, root: str, version: int, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], empty: DataFrame, source: str = "source_id"
) -> bool:
    """Merge a batch into the snapshot and publish it as ``version``; only sources that the batch holds are read and written.

    ``merge(stored, incoming)`` gives the new rows of these sources, ``empty`` has the columns of a snapshot.  The base
    is the latest version published before.  A version that is published already is left as it is, so a batch may be
    replayed; an empty batch publishes a version with the same rows.  True if a version was published.
    """
    known = versions(spark, root)
    if version in known:
        return False
    if known and version < known[-1]:
        raise ValueError(f"version {version} is older than the current one, {known[-1]}")
    base = known[-1] if known else None
    incoming = settled(incoming, "batch")
    touched = looked_up(incoming.select(part_of(F.col(source)).alias("part")).distinct(), "touched")
    stored = read_version(spark, root, base, touched)
    rows = merge(empty if stored is None else stored, incoming)
    rows = rows.withColumns({"version": F.lit(version).cast("long"), "part": part_of(F.col(source))})
    out = _dealt(rows, touched).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("version", "part").parquet(f"{root}/rows")
    now = _rows(spark, root, [f"{root}/rows/version={version}"])
    kept = manifest(spark, root, base).join(touched, "part", "left_anti")
    if now is not None:
        new = now.join(touched, "part", "left_semi").groupBy("part", "version").agg(F.count("*").alias("n"))
        kept = kept.unionByName(new)
    kept.withColumnRenamed("version", "held").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
    mark_published(spark, root, version)
    return True


def drop_old(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions, and the partitions that none of these names; their number.

    Files that publish go first, so no reader finds a version whose rows are half gone; what a dead writer left of a
    newer version stays, as it may be written again.
    """
    known = versions(spark, root)
    old, kept = known[:-keep], known[-keep:]
    if not old:
        return 0
    files, there = filesystem(spark, root)
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(there, name)
    for v in old:
        files.delete(at(f"published/{v:012d}"), False)
    named = {(r["version"], f"part={_escaped(spark, r['part'])}") for v in kept for r in manifest(spark, root, v).collect()}  # one row a source
    gone = 0
    for folder in files.listStatus(at("rows")):
        name = folder.getPath().getName()
        if not name.startswith("version=") or int(name.removeprefix("version=")) > kept[-1]:
            continue
        v, parts = int(name.removeprefix("version=")), list(files.listStatus(folder.getPath()))
        unused = [p for p in parts if (v, p.getPath().getName()) not in named]
        for p in unused:
            files.delete(p.getPath(), True)
        if len(unused) == len(parts):
            files.delete(folder.getPath(), True)
        gone += len(unused)
    for v in old:
        files.delete(at(f"manifest/version={v}"), True)
    return gone
