import datetime as dt

import pytest
from pyspark.sql import functions as F

from talentweave.operators import sync
from talentweave.sources import snapshots

NOW = dt.datetime(2024, 5, 1)
SCHEMA = "source_id long, external_id string, title string, content_hash string, url string, active boolean, first_seen_at timestamp, last_seen_at timestamp, last_updated_at timestamp, application_status string, application_confirmation_needed boolean"


@pytest.fixture
def publish(spark, tmp_path):
    root = f"{tmp_path}/snap"

    def do(version, rows, day=0, missing=False):
        batch = spark.createDataFrame([(s, e, t, t, "u") for s, e, t in rows], "source_id long, external_id string, title string, content_hash string, url string")
        merge = lambda stored, sent: sync.publish(stored, sent, NOW + dt.timedelta(days=day), deactivate_missing=missing)
        return snapshots.publish_sources(spark, root, version, batch, merge, spark.createDataFrame([], SCHEMA))

    do.root = root
    return do


def _state(spark, root):
    return {(r.source_id, r.external_id): (r.title, r.active) for r in snapshots.read_current(spark, root).collect()}


def _held(spark, root):
    return {r.part: (r.version, r.n) for r in snapshots.manifest(spark, root, snapshots.current_version(spark, root)).collect()}


def test_only_touched_sources_are_written(spark, publish):
    assert snapshots.current_version(spark, publish.root) is None and snapshots.read_current(spark, publish.root) is None
    publish(1, [(1, "a", "A"), (1, "b", "B"), (2, "c", "C"), (None, "d", "D"), (33, "e", "E")])
    publish(2, [(2, "c", "C2"), (2, "f", "F")])
    assert _held(spark, publish.root) == {"1": (1, 2), "2": (2, 2), "none": (1, 1), "33": (1, 1)}
    assert _state(spark, publish.root)[2, "c"] == ("C2", True) and len(_state(spark, publish.root)) == 6
    publish(3, [(1, "b", "B")], missing=True)
    assert _state(spark, publish.root)[1, "a"] == ("A", False) and _state(spark, publish.root)[33, "e"] == ("E", True)
    publish(4, [])  # an empty batch
    assert snapshots.current_version(spark, publish.root) == 4 and len(_state(spark, publish.root)) == 6
    files = snapshots.read_current(spark, publish.root).inputFiles()
    assert {tuple(f.split("/")[-3:-1]) for f in files} == {("version=1", "part=none"), ("version=1", "part=33"), ("version=2", "part=2"), ("version=3", "part=1")}


@pytest.mark.parametrize("dies_in", ["mark_published", "manifest"])
def test_a_writer_that_dies_leaves_the_version_before(spark, publish, monkeypatch, dies_in):
    publish(1, [(1, "a", "A"), (2, "c", "C")])
    before = _state(spark, publish.root)

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(snapshots, dies_in, dies)
        with pytest.raises(RuntimeError, match="killed"):
            publish(2, [(2, "c", "C2"), (3, "x", "X")])
    assert snapshots.current_version(spark, publish.root) == 1 and _state(spark, publish.root) == before
    assert publish(2, [(2, "c", "C2"), (3, "x", "X")])
    assert _state(spark, publish.root) == {(1, "a"): ("A", True), (2, "c"): ("C2", True), (3, "x"): ("X", True)}
    assert not publish(2, [(2, "c", "C9")])  # published already
    assert _state(spark, publish.root)[2, "c"] == ("C2", True)
    with pytest.raises(ValueError, match="older"):
        publish(0, [(2, "c", "C9")])


def test_old_versions_go_and_what_is_named_stays(spark, publish):
    for v in range(1, 6):
        publish(v, [(1, "a", f"A{v}")] + ([(2, "c", "C")] if v == 1 else []), v)
    before = _state(spark, publish.root)
    assert snapshots.drop_old(spark, publish.root, keep=2) == 3
    assert snapshots.versions(spark, publish.root) == [4, 5] and _state(spark, publish.root) == before
    assert {r.title for r in snapshots.read_version(spark, publish.root, 4).where(F.col("source_id") == 1).collect()} == {"A4"}
    assert snapshots.drop_old(spark, publish.root, keep=2) == 0
    publish(6, [(2, "c", "C6")], 6)
    assert _state(spark, publish.root)[2, "c"] == ("C6", True)
