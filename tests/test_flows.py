import datetime as dt
import json

from pyspark.sql import functions as F

from talentweave.operators import state, sync
from talentweave.plans import derived
from talentweave.sources import readers, sinks, snapshots
from talentweave.streaming import flows

NOW = dt.datetime(2024, 5, 1)
EMPTY = "source_id long, external_id string, title string, url string, content_hash string, active boolean, first_seen_at timestamp, last_seen_at timestamp, last_updated_at timestamp, application_status string, application_confirmation_needed boolean"


def _capture(path, n, jobs):
    (path / f"b{n}.json").write_text(
        json.dumps({"parser": "list", "page": {"url": "https://www.indeed.com/jobs", "title": "Jobs", "site": "Indeed"}, "source": {"id": 4, "name": "S"}, "jobs": jobs})
    )


JOBS = [
    {"raw_id": "k1", "title": " Cook ", "summary": "<b>a</b> b", "url": "https://www.indeed.com/rc/clk?jk=k1&from=x"},
    {"raw_id": "k2", "title": "Clerk", "company": "Z"}
]


def test_capture_rows(spark, tmp_path):
    _capture(tmp_path, 0, JOBS)
    batches = readers.captures(spark, str(tmp_path))
    rows = readers.capture_rows(batches).orderBy("pos").collect()
    assert [(r.raw_id, r.title, r.company, r.url, r.summary) for r in rows] == [
        ("k1", "Cook", "S", "https://www.indeed.com/viewjob?jk=k1", "a b"),
        ("k2", "Clerk", "Z", "https://www.indeed.com/viewjob?jk=k2", "")
    ]
    sources = spark.createDataFrame([(4, "https://x.org", "custom_url")], "id long, url string, source_type string")
    assert readers.resolve_sources(batches, sources).first()["source_id"] == 4
    new = readers.resolve_sources(batches, sources.where("id = 0")).first()
    assert new["source_id"] is None and new["new_name"] == "S"


def test_capture_stream_is_idempotent(spark, tmp_path):
    landed, root = tmp_path / "in", str(tmp_path / "snap")
    landed.mkdir()
    empty = spark.createDataFrame([], EMPTY)
    prepare = lambda b: readers.capture_rows(b).select(
        "source_id", F.col("raw_id").alias("external_id"), "title", "url", F.sha2("title", 256).alias("content_hash")
    )
    merge = flows.merge_batches(prepare, root, empty, lambda i: NOW + dt.timedelta(days=i))

    def run():
        stream = spark.readStream.schema(readers.CAPTURE).option("multiLine", True).json(str(landed))
        q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    _capture(landed, 0, JOBS)
    run()
    assert {r.external_id for r in snapshots.read_current(spark, root).collect()} == {"k1", "k2"}
    _capture(landed, 1, JOBS)
    run()
    rows = snapshots.read_current(spark, root).collect()
    assert len(rows) == 2 and all(r.first_seen_at == NOW and r.last_updated_at == NOW for r in rows)
    merge(readers.captures(spark, str(landed / "b1.json")), 1)  # the same batch again
    assert snapshots.read_current(spark, root).count() == 2 and snapshots.current_version(spark, root) == 2
    assert snapshots.current_version(spark, str(tmp_path / "none")) is None


def test_repeated_captures_change_nothing(spark, tmp_path):
    """The same captures in a later micro-batch are dropped before the merge: not even the time they were seen changes."""
    landed, root = tmp_path / "in", str(tmp_path / "snap")
    landed.mkdir()
    merge = flows.merge_batches(lambda b: b.drop("captured_at"), root, spark.createDataFrame([], EMPTY), lambda i: NOW + dt.timedelta(days=i))

    def run():
        rows = readers.capture_rows(spark.readStream.schema(readers.CAPTURE).option("multiLine", True).json(str(landed)))
        rows = rows.select(
            "source_id", F.col("raw_id").alias("external_id"), "title", "url", F.sha2("title", 256).alias("content_hash"), F.lit(None).cast("timestamp").alias("captured_at")
        )
        q = flows.once(rows).writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {(r.external_id, r.last_seen_at, r.title) for r in snapshots.read_current(spark, root).collect()}

    _capture(landed, 0, [*JOBS, JOBS[0]])
    first = run()
    assert len(first) == 2
    _capture(landed, 1, JOBS)
    assert run() == first
    _capture(landed, 2, [JOBS[0] | {"title": "Chef"}])
    later = run()
    assert {x[2] for x in later} == {"Chef", "Clerk"} and len(later & first) == 1


def test_state_stream_equals_batch(spark, tmp_path):
    kinds = ["view", "purchase", "error", "signup", "click"]
    rows = [(i, NOW + dt.timedelta(minutes=i), i * 7 % 5, kinds[i * i % 5 if i % 2 else i % 5], 150.0 * (i % 2)) for i in range(120)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    for i in range(3):  # files in order of time
        events.where(f"event_id >= {i * 40} and event_id < {i * 40 + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    q = flows.application_states(derived.app_events(stream)).writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {r.posting_id: (r.status, r.confirmation_needed, r.pending_since) for r in state.fold_events(derived.app_events(events)).collect()}
    assert {r.posting_id for r in spark.table("states").collect()} == set(batch)
    last = {r.posting_id: r for r in spark.table("states").collect()}  # as collected, in order of micro-batches
    assert {k: (r.status, r.confirmation_needed, r.pending_since) for k, r in last.items()} == batch
    progress = flows.progress_states(derived.progress_events(events)).collect()
    assert sum(r.n_events for r in progress) == 120


def test_late_events_give_what_they_would_have_given_in_order(spark, tmp_path):
    schema = "posting_id long, ts timestamp, seq long, action string"
    at = lambda m: NOW + dt.timedelta(minutes=m)
    batches = [
        [(1, at(10), 1, "opened"), (2, at(10), 2, "applied"), (3, at(30), 3, "opened"), (4, at(10), 4, "Not-Applied")],
        [(1, at(5), 5, "applied"), (2, at(5), 6, "opened"), (3, at(20), 7, "not_applied"), (4, at(10), 8, "opened"), (5, at(1), 9, "what")],
        [(1, at(20), 10, "not-applied"), (2, at(3), 11, "not_interested"), (3, at(1), 12, "opened"), (4, at(9), 13, "applied")],
    ]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "e"))
        write = lambda rows, n: rows.withColumn("n", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))
        q = flows.application_states(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination()
    got = {r.posting_id: (r.status, r.confirmation_needed, r.pending_since) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect()}
    whole = state.fold_events(spark.createDataFrame([e for b in batches for e in b], schema)).collect()
    assert got == {r.posting_id: (r.status, r.confirmation_needed, r.pending_since) for r in whole}
    assert got == {
        1: ("not_applied", False, None), 2: ("applied", False, None), 3: ("pending", True, at(30)), 4: ("pending", True, at(10))
    }


def test_readers_of_board_files(spark, tmp_path):
    (tmp_path / "board.json").write_text(
        json.dumps({"jobs": [{"id": "1", "title": "A", "absolute_url": "u", "content": "<p>x &amp; y</p>", "location": {"name": "Rome"}}]})
    )
    assert readers.board_payloads(spark, str(tmp_path / "board.json"), 7).select(
        "source_id", "raw_id", "description", "location"
    ).first()[:] == (7, "1", "x & y", "Rome")
    (tmp_path / "posts.json").write_text(
        json.dumps([{"id": "p", "text": "T", "createdAt": 1700000000000, "categories": {"location": "Bern"}, "lists": [{"text": "Needs", "content": "<li>a</li>"}]}])
    )
    assert readers.postings_payloads(spark, str(tmp_path / "posts.json"), 7).select(
        "raw_id", "requirements_text", "location"
    ).first()[:] == ("p", "Needs a", "Bern")
    folder = tmp_path / "texts"
    folder.mkdir()
    for name, text in (("a.txt", "x" * 50), ("b.md", "short"), ("c.exe", "y" * 50)):
        (folder / name).write_text(text)
    assert {r.filename: r.status for r in readers.resume_texts(spark, str(folder)).collect()} == {
        "a.txt": "ok", "b.md": "too short", "c.exe": "unsupported"
    }


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "Tïtle", 0.123456, ["a", "b"], ["r1", "r2"], NOW)],
        "posting_id long, title string, score double, matched_skills array<string>, reasons array<string>, posted_at timestamp"
    )
    rows = rows.withColumns({c: F.col("score") for c in ("embedding_score", "skill_score", "experience_score")}).withColumn(
        "missing_skills", F.array().cast("array<string>")
    )
    sinks.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert back["score"] == "0.1235" and back["matched_skills"] == "a, b" and back["reasons"] == "r1 | r2" and len(back) == 15
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).select("job.id", "job.title").first()[:] == (1, "Tïtle")
    counts = sync.counts(spark.createDataFrame([(1, "x", "created"), (1, "y", "updated")], "source_id long, external_id string, action string"))
    assert sinks.scan_rows(counts, NOW, NOW).first()["jobs_found"] == 2
