"""Streams run with availableNow and must equal their batch twins."""

import json

from pyspark.sql import functions as F

from parlance.operators.catalog import latest_states
from parlance.operators.turns import build_turns
from parlance.streaming import jobs

EVENTS = "job_id bigint, event_id bigint, state string, progress int, at_ms bigint"
SEGS = "meeting_id bigint, " + jobs.SEGMENT_DDL


def put(spark, rows, schema, folder, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))


def test_audit_ingest_lands_each_line_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda d, i: json.dumps({"timestamp": f"2026-04-0{d}T10:00:0{i}+00:00", "action": "auth.login", "username": f"u{i}", "success": True})
    (src / "audit_a.jsonl").write_text("\n".join([line(1, 1), "{broken", line(2, 2)]) + "\n")
    run = lambda: jobs.ingest_audit(jobs.audit_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (src / "audit_b.jsonl").write_text(line(2, 3) + "\n")
    run()
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.username for r in got.collect()) == ["u1", "u2", "u3"]
    assert {str(r.log_date) for r in got.select("log_date").distinct().collect()} == {"2026-04-01", "2026-04-02"}


def test_latest_state_upsert_equals_batch(spark, tmp_path):
    src = tmp_path / "ev"
    rows = [(1, 1, "uploaded", 0, 100), (2, 2, "diarizing", 50, 110), (1, 3, "transcribing", 20, 200)]
    late = [(1, 4, "completed", 100, 150), (3, 5, "error", 10, 300), (2, 6, "completed", 100, 400)]
    run = lambda: jobs.follow_job_states(spark.readStream.schema(EVENTS).json(str(src)), str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    put(spark, rows, EVENTS, src, 0)
    run()
    put(spark, late, EVENTS, src, 1)
    run()
    want = latest_states(spark.createDataFrame(rows + late, EVENTS)).collect()
    got = jobs.snapshot(spark, str(tmp_path / "t")).select("job_id", "state", "progress", "at_ms").collect()
    assert sorted(got) == sorted(want)


def test_stalled_jobs_fire_after_the_timeout(spark, tmp_path):
    jobs.use_rocksdb(spark)
    src, hour = tmp_path / "ev", 3_600_000
    put(spark, [(1, 1, "diarizing", 60, 10 * hour), (2, 2, "completed", 100, 10 * hour), (3, 3, "summarizing", 99, 10 * hour)], EVENTS, src, 0)
    put(spark, [(3, 4, "completed", 100, 10 * hour + 5)], EVENTS, src, 1)
    put(spark, [(9, 5, "completed", 100, 20 * hour)], EVENTS, src, 2)
    put(spark, [(9, 6, "completed", 100, 20 * hour + 1)], EVENTS, src, 3)
    ev = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(src))
    out = str(tmp_path / "out")
    jobs.stalled_jobs(ev).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert [(r.job_id, r.state, r.progress, r.last_state) for r in got] == [(1, "error", 60, "diarizing")]


def test_online_turns_equal_batch_turns(spark, tmp_path):
    jobs.use_rocksdb(spark)
    src = tmp_path / "seg"
    seg = lambda m, o, s, e, t, sp: (m, o, s, e, t, sp, None, 0.5 + o / 100, 0.9 - o / 100)
    first = [seg(1, 1, 0, 1000, "Hello there", "A"), seg(1, 2, 1100, 2000, "General thing", "A"), seg(2, 1, 0, 900, "Yes well", "B")]
    second = [seg(1, 3, 2100, 3000, "and more", "A"), seg(1, 4, 3100, 4000, "other one", "B"), seg(1, 5, 4050, 5000, "A again", "A"), seg(2, 2, 3000, 3900, "later on", "B")]
    far = [seg(3, 1, 900_000, 901_000, "closing time", "C")]
    farther = [seg(3, 2, 950_000, 951_000, "final words", "C")]
    for i, rows in enumerate((first, second, far, farther)):
        put(spark, rows, SEGS, src, i)
        stream = spark.readStream.schema(SEGS).option("maxFilesPerTrigger", 1).json(str(src))
        stream = stream.withColumn("event_time", F.timestamp_millis(F.col("start_ms") + 10**12))
        jobs.online_turns(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = build_turns(spark.createDataFrame(first + second + far, SEGS))
    cols = ["meeting_id", "ord", "start_ms", "end_ms", "text", "speaker_id", F.round("confidence", 9).alias("c"), "attribution_confidence"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
