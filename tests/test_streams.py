import json

from uas_spark.streaming import stream as st


def _write_bodies(path, rows):
    path.mkdir(parents=True, exist_ok=True)
    with open(path / "part-0.json", "w") as f:
        for serial, body in rows:
            f.write(json.dumps({"serial": serial, "body": body}) + "\n")


def test_ingest_stream_is_exactly_once_across_restart(spark, tmp_path):
    src = tmp_path / "src"
    one = {"reportId": "it-r1", "recordedAt": "2026-07-25T14:03:11.000Z", "latitude": 47.6205,
           "longitude": -122.3493, "altitudeFt": 412.5}
    two = dict(one, reportId="it-r2", recordedAt="2026-07-25T14:03:12.000Z")
    _write_bodies(src, [("SN", json.dumps(one)), ("SN", json.dumps([one, two])), ("SN", "[]")])
    table, ckpt = str(tmp_path / "table"), str(tmp_path / "ckpt")
    st.stream_ingest_positions(spark, str(src), table, ckpt).awaitTermination()
    assert sorted(r.report_id for r in spark.read.parquet(table).collect()) == ["it-r1", "it-r2"]
    # the client retries the whole batch in a new file; a fresh checkpoint replays everything
    (src / "retry").mkdir()
    _write_bodies(src / "retry", [("SN", json.dumps([one, two]))])
    st.stream_ingest_positions(spark, str(src), table, str(tmp_path / "ckpt2")).awaitTermination()
    assert sorted(r.report_id for r in spark.read.parquet(table).collect()) == ["it-r1", "it-r2"]


def test_latest_snapshot_ignores_late_report(spark, tmp_path):
    src = tmp_path / "src"
    new = {"reportId": "b", "recordedAt": "2026-07-25T14:00:00Z", "latitude": 47.0, "longitude": -122.0,
           "altitudeFt": 1.0}
    late = dict(new, reportId="a", recordedAt="2026-07-25T13:00:00Z")
    _write_bodies(src, [("SN", json.dumps(new)), ("SN", json.dumps(late))])
    snap = str(tmp_path / "snap")
    st.stream_latest_position(spark, str(src), snap, str(tmp_path / "ck")).awaitTermination()
    assert [r.report_id for r in st.latest_snapshot(spark, snap).collect()] == ["b"]


def _report(i, at="2026-07-25T14:00:00Z", lat=47.0):
    return {"reportId": i, "recordedAt": at, "latitude": lat, "longitude": -122.0, "altitudeFt": 1.0}


def test_bad_report_rejects_its_body(spark, tmp_path):
    src, table = tmp_path / "src", str(tmp_path / "table")
    _write_bodies(src, [("SN", json.dumps([_report("a"), _report("b", lat=99.0)])), ("SN", json.dumps(_report("c"))),
                        ("SN", "not json"), ("SN", "[]")])
    st.stream_ingest_positions(spark, str(src), table, str(tmp_path / "ck"), str(tmp_path / "bad")).awaitTermination()
    assert [r.report_id for r in spark.read.parquet(table).collect()] == ["c"]
    bad = spark.read.json(str(tmp_path / "bad")).collect()
    assert len(bad) == 2 and all(r.n_bad == 1 for r in bad)


def test_first_in_the_body_wins(spark, tmp_path):
    src, table = tmp_path / "src", str(tmp_path / "table")
    two = [dict(_report("a"), altitudeFt=float(9 - k)) for k in range(5)]
    _write_bodies(src, [("SN", json.dumps(two)), ("SN", json.dumps(dict(_report("a"), altitudeFt=0.0)))])
    st.stream_ingest_positions(spark, str(src), table, str(tmp_path / "ck")).awaitTermination()
    assert [r.altitude_ft for r in spark.read.parquet(table).collect()] == [9.0]


def _both(spark, src, table, tmp_path):
    st.stream_dedup_bounded(spark, src, table, str(tmp_path / "ck")).awaitTermination()
    st.stream_late_reports(spark, src, table, str(tmp_path / "late")).awaitTermination()


def test_bounded_dedup_keeps_late_first_reports(spark, tmp_path):
    src, table = tmp_path / "src", str(tmp_path / "table")
    _write_bodies(src / "1", [("SN", json.dumps([_report("new"), _report("new")]))])
    _both(spark, str(src) + "/*", table, tmp_path)
    _write_bodies(src / "2", [("SN", json.dumps([_report("late", "2026-07-24T13:00:00Z"), _report("new"), _report("x")]))])
    _both(spark, str(src) + "/*", table, tmp_path)
    _write_bodies(src / "3", [("SN", json.dumps([_report("late", "2026-07-24T13:00:00Z"), _report("y"),
                                                 _report("edge", "2026-07-25T13:00:00Z")]))])
    _both(spark, str(src) + "/*", table, tmp_path)
    assert sorted(r.report_id for r in spark.read.parquet(table).collect()) == ["edge", "late", "new", "x", "y"]
    # everything replayed under new checkpoints, late path first on what is stored: nothing is stored twice
    st.stream_late_reports(spark, str(src) + "/*", table, str(tmp_path / "late2")).awaitTermination()
    assert spark.read.parquet(table).count() == 5


def test_reports_on_time_do_not_read_the_table(spark, tmp_path, monkeypatch):
    src, table = tmp_path / "src", str(tmp_path / "table")
    _write_bodies(src / "1", [("SN", json.dumps([_report("a"), _report("a"), _report("b")]))])
    _write_bodies(src / "2", [("SN", json.dumps([_report("a"), _report("c", "2026-07-25T13:30:00Z")]))])
    monkeypatch.setattr(st, "_stored", lambda *a: (_ for _ in ()).throw(AssertionError("read")))
    st.stream_dedup_bounded(spark, str(src) + "/*", table, str(tmp_path / "ck"), files_per_trigger=1).awaitTermination()
    assert sorted(r.report_id for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]


def _zones(src, name, rows):
    src.mkdir(exist_ok=True)
    (src / name).write_text("".join(json.dumps({"report_id": r, "zone_id": z, "recorded_at": f"2026-07-25T{t}Z"}) + "\n"
                                    for r, z, t in rows))


def test_zone_leaves_by_its_timer_and_state_survives(spark, tmp_path):
    src, sink, ck = tmp_path / "src", str(tmp_path / "sink"), str(tmp_path / "ck")

    def run():
        st.stream_zone_staleness(spark, str(src), sink, ck).awaitTermination()
        return {r.zone_id: (r.change, r.report_id) for r in st.zone_states(spark, sink).collect()}

    _zones(src, "a.json", [("r1", "z", "14:00:00"), ("r0", "z", "13:50:00"), ("q1", "y", "13:40:00")])
    assert run() == {"z": ("enter", "r1"), "y": ("enter", "q1")}
    _zones(src, "b.json", [("s1", "x", "14:30:00")])  # z is 30 minutes old: still fresh; y is not
    assert run() == {"z": ("enter", "r1"), "y": ("leave", "q1"), "x": ("enter", "s1")}
    _zones(src, "c.json", [("s2", "x", "14:30:01"), ("old", "z", "13:00:00")])
    assert run() == {"z": ("leave", "r1"), "y": ("leave", "q1"), "x": ("update", "s2")}
    _zones(src, "d.json", [("r2", "z", "14:31:00"), ("r3", "z", "14:31:00")])
    assert run()["z"] == ("enter", "r2")
    n = st.zone_changes(spark, sink).count()
    run()  # nothing new: nothing written again
    assert st.zone_changes(spark, sink).count() == n
    assert n == 7


def test_snapshot_size_follows_the_drones(spark, tmp_path):
    src, snap, ck = tmp_path / "src", str(tmp_path / "snap"), str(tmp_path / "ck")
    for k in range(4):
        _write_bodies(src / str(k), [(f"SN-{j}", json.dumps(_report(f"r{k}-{j}", f"2026-07-25T14:0{(k * 3) % 4}:00Z")))
                                     for j in range(6)])
        st.stream_latest_position(spark, str(src) + "/*", snap, ck, slots=4).awaitTermination()
    got = {r.drone_serial_number: r.report_id for r in st.latest_snapshot(spark, snap).collect()}
    assert got == {f"SN-{j}": f"r1-{j}" for j in range(6)}
    assert spark.read.parquet(snap).count() == 6
    # a replay of everything leaves the same table
    st.stream_latest_position(spark, str(src) + "/*", snap, str(tmp_path / "ck2"), slots=4).awaitTermination()
    assert {r.drone_serial_number: r.report_id for r in st.latest_snapshot(spark, snap).collect()} == got


def test_appends_are_clustered_with_bloom_filters(spark, tmp_path):
    import glob

    from pyspark.sql import functions as F

    from uas_spark.sources.sinks import append_time_partitioned
    path = str(tmp_path / "t")
    df = spark.range(4000, numPartitions=16).select(
        F.concat(F.lit("r"), F.col("id") * 7919).alias("report_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 40).alias("recorded_at"))
    append_time_partitioned(df, path, files=3)
    assert all(len(glob.glob(d + "/*.parquet")) <= 3 for d in glob.glob(path + "/recorded_date=*"))
    hit = spark.read.parquet(path).filter(F.col("report_id").isin("r7919", "r11113x"))
    assert hit.count() == 1
    miss = spark.read.parquet(path).filter(F.col("report_id") == "r79191")
    miss.collect()
    leaf = miss._jdf.queryExecution().executedPlan().collectLeaves().head()
    metrics = leaf.metrics() if leaf.metrics().contains("numOutputRows") else leaf.executedPlan().collectLeaves().head().metrics()
    assert metrics.apply("numOutputRows").value() < 400  # nearly all row groups were skipped


def test_source_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    import glob

    from pyspark.sql import functions as F

    from uas_spark.plans import registry_streams as rs
    spark.range(40).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
                           F.col("id").alias("user_id"), F.lit(1.0).alias("value")).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(rs, "SOURCE_ROWS", 10, raising=False)
    per = rs._position_source(spark, str(tmp_path), str(tmp_path / "src"), retries=True)
    files = glob.glob(str(tmp_path / "src" / "*.json"))
    assert per == 2 and len(files) == 8 and all(sum(1 for _ in open(f)) <= 11 for f in files)
    assert len({line for f in files for line in open(f)}) == 40  # every body, twice, in two files


def test_ingest_reads_accepted_rows_from_cache(spark, tmp_path, monkeypatch):
    src, table, seen, real = tmp_path / "src", str(tmp_path / "table"), [], st.ingest.dedup_append

    def spy(stored, batch, **more):
        seen.append(batch.storageLevel.useMemory)
        return real(stored, batch, **more)

    monkeypatch.setattr(st.ingest, "dedup_append", spy)
    _write_bodies(src, [("SN", json.dumps([_report("a"), _report("b")]))])
    st.stream_ingest_positions(spark, str(src), table, str(tmp_path / "ck")).awaitTermination()
    assert seen == [True] and spark.read.parquet(table).count() == 2
