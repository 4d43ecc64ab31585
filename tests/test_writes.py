import datetime as dt
import random
import re

from pyspark.sql import functions as F

from uas_spark.operators import ingest, patches, refs, registrations

POS = "report_id string, drone_serial_number string, recorded_at timestamp, latitude double, longitude double"


def _t(s):
    return dt.datetime.fromisoformat(s)


def test_idempotent_retry_returns_empty(spark):
    rows = [("it-r1", "SN", _t("2026-07-25 14:03:11"), 47.6205, -122.3493),
            ("it-r2", "SN", _t("2026-07-25 14:03:12"), 47.6206, -122.3494)]
    batch = spark.createDataFrame(rows, POS)
    empty = spark.createDataFrame([], POS)
    first = ingest.dedup_append(empty, batch)
    assert first.count() == 2
    assert ingest.dedup_append(first, batch).count() == 0
    assert ingest.dedup_append(first, empty).count() == 0


def test_atomic_batch_rejects_whole_batch(spark):
    df = spark.createDataFrame([(1, "clear"), (1, "sunny"), (2, "foggy")], "batch_id int, state string")
    from uas_spark.operators.validate import enum_ok
    good, bad = ingest.atomic_batch(df, "batch_id", enum_ok(F.col("state"), "visibility_state"))
    assert [r.batch_id for r in good.collect()] == [2]
    assert [(r.batch_id, r.bad_rows) for r in bad.collect()] == [(1, 1)]


def test_unknown_sensor_rejects_batch(spark):
    sensors = spark.createDataFrame([("s1",)], "sensor_id string")
    pos = spark.createDataFrame([(1, "s1"), (1, "no-such-sensor"), (2, "s1")], "batch_id int, sensor_id string")
    unk = ingest.unknown_sensors(pos, sensors).collect()
    assert [(r.batch_id, r.unknown_sensor_ids) for r in unk] == [(1, ["no-such-sensor"])]


REG = "registration_id string, serial_number string, owner_id string, start_date date, end_date date, arrival long"
FIX_REG = [
    ("it-reg-1", "IT-SN-1", "o1", "2026-01-01", "2026-06-30", "accepted"),
    ("it-reg-2", "IT-SN-1", "o1", "2026-08-01", "2026-12-31", "accepted"),
    ("it-reg-overlap", "IT-SN-1", "o1", "2026-06-01", "2026-08-15", "registration_overlap"),
    ("it-reg-boundary-base", "IT-SN-BOUNDARY", "o1", "2026-01-01", "2026-06-30", "accepted"),
    ("it-reg-touching-start", "IT-SN-BOUNDARY", "o1", "2026-06-30", "2026-07-15", "registration_overlap"),
    ("it-reg-adjacent-after", "IT-SN-BOUNDARY", "o1", "2026-07-01", "2026-07-15", "accepted"),
    ("it-reg-touching-end", "IT-SN-BOUNDARY", "o1", "2026-07-15", "2026-08-01", "registration_overlap"),
    ("it-reg-1", "IT-SN-9", "o1", "2027-01-01", "2027-02-01", "duplicate_id"),
    ("it-reg-no-owner", "IT-SN-NO-OWNER", "nobody", "2027-01-01", "2027-02-01", "owner_not_found"),
    ("it-reg-3", "IT-SN-2", "o2", "2026-02-01", "2026-09-30", "accepted"),
]


def _reg_df(spark):
    rows = [(a, b, c, dt.date.fromisoformat(d), dt.date.fromisoformat(e), i) for i, (a, b, c, d, e, _) in
            enumerate(FIX_REG)]
    return spark.createDataFrame(rows, REG)


def test_sequential_registration_outcomes(spark):
    owners = spark.createDataFrame([("o1",), ("o2",)], "owner_id string")
    reqs = _reg_df(spark)
    # cross-serial id reuse: 'it-reg-1' on IT-SN-9 conflicts with the stored one
    stored = reqs.filter(F.col("arrival") == 0)
    rest = reqs.filter(F.col("arrival") > 0)
    out = {(r.registration_id, r.arrival): r.outcome
           for r in registrations.sequential_accept(rest, owners, stored).collect()}
    for i, row in enumerate(FIX_REG[1:], start=1):
        assert out[(row[0], i)] == row[5], row


def test_registration_lookups(spark):
    acc = _reg_df(spark).filter(F.col("registration_id").isin("it-reg-1", "it-reg-2", "it-reg-3")
                                & (F.col("serial_number") != "IT-SN-9"))
    probes = spark.createDataFrame([("a", "IT-SN-1", dt.date(2026, 3, 1)), ("b", "IT-SN-1", dt.date(2026, 9, 1)),
                                    ("c", "IT-SN-1", dt.date(2026, 7, 15))],
                                   "probe_id string, serial_number string, date date")
    got = {r.probe_id: r.r_registration_id for r in registrations.active_registration(acc, probes).collect()}
    assert got == {"a": "it-reg-1", "b": "it-reg-2", "c": None}
    owners = spark.createDataFrame([("o1",), ("o2",)], "owner_id string")
    probes = spark.createDataFrame([("o1",), ("o2",), ("ghost",)], "owner_id string")
    r = registrations.owner_registrations(owners, acc, probes, "2026-03-01").collect()
    assert sorted(x.registration_id for x in r if x.registration_id) == ["it-reg-1", "it-reg-3"]
    assert [x.owner_found for x in r if x.owner_id == "ghost"] == [False]


def test_patch_overlap(spark):
    acc = _reg_df(spark).filter(F.col("registration_id").isin("it-reg-1", "it-reg-2") & (F.col("arrival") < 2))
    p = spark.createDataFrame([("it-reg-2", 1, dt.date(2026, 6, 15), None)],
                              "registration_id string, seq long, start_date date, end_date date")
    assert registrations.registration_patch_overlap(acc, p).first().outcome == "registration_overlap"


AUTH = "authorization_id string, owner_id string, status string, start_time timestamp, end_time timestamp"
PATCH = "target_id string, seq long, status string, max_altitude_ft double"


def test_lifecycle_matrix(spark):
    base = spark.createDataFrame([("a1", "o1", "proposed", _t("2026-08-01 14:00:00"), _t("2026-08-01 18:00:00"))],
                                 AUTH)
    ps = spark.createDataFrame([("a1", 1, "proposed", 300.0), ("a1", 2, "approved", None), ("a1", 3, None, 200.0),
                                ("a1", 4, "rescinded", 100.0), ("a1", 5, "rescinded", None),
                                ("a1", 6, "proposed", None), ("nope", 1, None, 1.0)], PATCH)
    got = {(r.target_id, r.seq): r.outcome for r in patches.lifecycle_outcomes(
        base, ps, "authorization_id", ["max_altitude_ft"]).collect()}
    assert [got[("a1", i)] for i in range(1, 7)] == ["accepted", "accepted", "approved_immutable",
                                                      "approved_immutable", "accepted", "rescinded_terminal"]
    assert got[("nope", 1)] == "not_found"


def test_lifecycle_fold_window_recheck(spark):
    base = spark.createDataFrame([("w1", "c", "proposed", _t("2026-08-01 14:00:00"), _t("2026-08-01 18:00:00"))],
                                 "waiver_id string, conditions string, status string, start_time timestamp, "
                                 "end_time timestamp")
    ps = spark.createDataFrame([("w1", 1, None, None, _t("2026-08-01 19:00:00"), None),
                                ("w1", 2, None, None, _t("2026-08-01 15:00:00"), None),
                                ("w1", 3, "approved", None, None, None),
                                ("w1", 4, "rescinded", None, None, None)],
                               "target_id string, seq long, status string, conditions string, "
                               "start_time timestamp, end_time timestamp")
    got = [r.outcome for r in patches.lifecycle_fold(base, ps, "waiver_id", "conditions")
           .orderBy("seq").collect()]
    assert got == ["end_before_start", "accepted", "accepted", "accepted"]


def test_patch_nullable_absent_null_value(spark):
    base = spark.createDataFrame([("a1", "p1", _t("2026-01-01 00:00:00")), ("a2", "p2", _t("2026-01-01 00:00:00")),
                                  ("a3", "p3", _t("2026-01-01 00:00:00"))],
                                 "authorization_id string, pilot_id string, updated_at timestamp")
    ps = spark.createDataFrame([("a1", 1, '{"maxAltitudeFt": 10}'), ("a2", 1, '{"pilotId": null}'),
                                ("a3", 1, '{"pilotId": "p9"}')], "target_id string, seq long, raw string")
    got = {r.authorization_id: r.pilot_id for r in patches.patch_nullable(
        base, ps, "authorization_id", "pilot_id", "pilotId", "2026-08-01 00:00:00").collect()}
    assert got == {"a1": "p1", "a2": None, "a3": "p9"}


def test_pilot_of_another_owner_refused(spark):
    pilots = spark.createDataFrame([("p1", "org1")], "pilot_id string, organization_owner_id string")
    df = spark.createDataFrame([("x", "p1", "org1"), ("y", "p1", "org2"), ("z", None, "org2")],
                               "id string, pilot_id string, owner_id string")
    got = {r.id: r.pilot_found for r in refs.ref_pilot_under_owner(df, pilots).collect()}
    assert got == {"x": True, "y": False, "z": True}


def test_self_overlap_sweep(spark):
    rows = [("a", "S", "2026-01-01", "2026-01-10"), ("b", "S", "2026-01-10", "2026-01-20"),
            ("c", "S", "2026-02-01", "2026-02-05"), ("d", "S", "2026-01-12", "2026-01-13"),
            ("e", "T", "2026-01-01", "2026-12-31")]
    df = spark.createDataFrame([(a, b, dt.date.fromisoformat(c), dt.date.fromisoformat(d)) for a, b, c, d in rows],
                               "registration_id string, serial_number string, start_date date, end_date date")
    got = {r.registration_id: r.overlap for r in registrations.self_overlap(df).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": True, "e": False}


def test_insert_if_absent_first_claim(spark):
    existing = spark.createDataFrame([("x",)], "id string")
    req = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3), ("z", 4)], "id string, arrival int")
    got = {(r.id, r.arrival): r.outcome for r in ingest.insert_if_absent(existing, req, "id",
                                                                         [F.col("arrival")]).collect()}
    assert got == {("x", 1): "duplicate_id", ("y", 2): "accepted", ("y", 3): "duplicate_id", ("z", 4): "accepted"}


def test_sequential_clusters_are_independent(spark):
    owners = spark.createDataFrame([("o1",)], "owner_id string")
    rows = [("r1", "S", "o1", "2026-01-01", "2026-01-10", 0), ("r2", "S", "o1", "2026-01-05", "2026-01-06", 1),
            ("r3", "S", "o1", "2026-03-01", "2026-03-10", 2), ("r4", "S", "o1", "2026-03-10", "2026-03-12", 3),
            ("r5", "S", "o1", "2026-01-10", "2026-01-11", 4)]
    df = spark.createDataFrame([(a, b, c, dt.date.fromisoformat(d), dt.date.fromisoformat(e), i)
                                for a, b, c, d, e, i in rows], REG)
    got = {r.registration_id: r.outcome for r in registrations.sequential_accept(df, owners).collect()}
    assert got == {"r1": "accepted", "r2": "registration_overlap", "r3": "accepted",
                   "r4": "registration_overlap", "r5": "registration_overlap"}


def test_flight_plan_patch_reasons(spark):
    plans = spark.createDataFrame([("fp1", "o1", None, None, None, _t("2026-08-01 14:00:00"),
                                    _t("2026-08-01 18:00:00"))],
                                  "flight_plan_id string, owner_id string, registration_id string, pilot_id string, "
                                  "airspace_authorization_id string, start_time timestamp, end_time timestamp")
    pilots = spark.createDataFrame([("p1", "o1"), ("p2", "o2")], "pilot_id string, organization_owner_id string")
    regs = spark.createDataFrame([("r1", "o1"), ("r2", "o2")], "registration_id string, owner_id string")
    auths = spark.createDataFrame([("a1",)], "authorization_id string")
    ps = spark.createDataFrame([
        ("fp1", 1, '{"pilotId":"p2"}'), ("fp1", 2, '{"registrationId":"r9"}'), ("fp1", 3, '{"registrationId":"r2"}'),
        ("fp1", 4, '{"airspaceAuthorizationId":"a9"}'), ("fp1", 5, '{"startTime":"2026-08-01T19:00:00Z"}'),
        ("fp1", 6, '{"pilotId":"p1","registrationId":"r1","airspaceAuthorizationId":"a1"}'),
        ("fp1", 7, '{"pilotId":null}'), ("nope", 1, '{}')], "target_id string, seq long, raw string")
    got = {(r.target_id, r.seq): r.outcome for r in patches.flight_plan_patch(plans, ps, pilots, regs, auths).collect()}
    assert [got[("fp1", i)] for i in range(1, 8)] == [
        "pilot_not_found", "registration_not_found", "registration_owner_mismatch", "authorization_not_found",
        "end_before_start", "accepted", "accepted"]
    assert got[("nope", 1)] == "not_found"


def test_replace_partitions(spark, tmp_path):
    from uas_spark.sources import sinks
    root = str(tmp_path / "owners")
    mk = lambda rows: spark.createDataFrame(rows, "owner_id string, city string, k int")
    sinks.replace_partitions(mk([("o1", "a", 1), ("o2", "a", 2)]), root, "k")
    sinks.replace_partitions(mk([("o2", "b", 2), ("o3", "b", 2)]), root, "k")
    assert sorted((r.owner_id, r.city) for r in spark.read.parquet(root).collect()) == [
        ("o1", "a"), ("o2", "b"), ("o3", "b")]


REG = "registration_id string, serial_number string, owner_id string, start_date date, end_date date, arrival long"


def _day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(days=n)


def test_patch_overlap_brute_force(spark):
    """Patches see the accepted ones before them, in seq order per serial."""
    rng = random.Random(11)
    stored = [(f"r{i}", f"S{i % 4}", "o", _day(a := rng.randint(0, 200)), _day(a + rng.randint(0, 30)), i) for i in range(60)]
    ps = [(f"r{rng.randint(0, 65)}", k // 2, _day(rng.randint(0, 220)) if rng.random() < 0.5 else None,
           _day(rng.randint(0, 220)) if rng.random() < 0.5 else None) for k in range(600)]
    ps = list({(p[0], p[1]): p for p in ps}.values())
    got = registrations.registration_patch_overlap(
        spark.createDataFrame(stored, REG),
        spark.createDataFrame(ps, "registration_id string, seq long, start_date date, end_date date")).collect()
    now = {r[0]: [r[1], r[3], r[4]] for r in stored}
    exp = {}
    for rid, seq, s, e in sorted(ps, key=lambda p: (p[1], p[0])):
        if rid not in now:
            exp[rid, seq] = "not_found"
            continue
        row = now[rid]
        ns, ne = s or row[1], e or row[2]
        hit = (s or e) and any(x[0] == row[0] and k != rid and x[1] <= ne and x[2] >= ns for k, x in now.items())
        exp[rid, seq] = "registration_overlap" if hit else "end_before_start" if ne < ns else "accepted"
        if exp[rid, seq] == "accepted":
            row[1:] = ns, ne
    assert {(r.registration_id, r.seq): r.outcome for r in got} == exp and len(set(exp.values())) == 4


def test_patched_registrations_never_overlap(spark):
    """Two patches of one batch that would meet: the second is refused."""
    stored = [("a", "S", "o", _day(0), _day(10), 0), ("b", "S", "o", _day(20), _day(30), 1)]
    ps = [("a", 1, None, _day(15)), ("b", 2, _day(15), None), ("b", 3, _day(16), None)]
    got = registrations.registration_patch_overlap(
        spark.createDataFrame(stored, REG),
        spark.createDataFrame(ps, "registration_id string, seq long, start_date date, end_date date")).collect()
    assert {r.seq: r.outcome for r in got} == {1: "accepted", 2: "registration_overlap", 3: "accepted"}


def _brute_accept(reqs, owners, stored):
    taken, ids, out = [(r[1], r[3], r[4]) for r in stored], {r[0] for r in stored}, {}
    for rid, serial, owner, s, e, arrival in sorted(reqs, key=lambda r: (r[5], r[0])):
        if owner not in owners:
            out[rid, arrival] = "owner_not_found"
        elif any(x[0] == serial and x[1] <= e and s <= x[2] for x in taken):
            out[rid, arrival] = "registration_overlap"
        elif rid in ids:
            out[rid, arrival] = "duplicate_id"
        else:
            out[rid, arrival] = "accepted"
            taken.append((serial, s, e))
            ids.add(rid)
    return out


def test_sequential_accept_brute_force(spark):
    rng = random.Random(23)
    owners = spark.createDataFrame([("o",)], "owner_id string")
    for trial in range(4):
        def one(i):
            a = rng.randint(0, 150)
            return (f"r{rng.randint(0, 120) if rng.random() < 0.4 else i + 1000}", f"S{rng.randint(0, 2)}",
                    "o" if rng.random() < 0.95 else "x", _day(a), _day(a + rng.choice([0, 1, 3, 10, 60, -1])), i)
        reqs = [one(i) for i in range(300)]
        stored = [(f"r{i}", f"S{i % 3}", "o", _day(a := rng.randint(0, 150)), _day(a + rng.randint(0, 6)), None)
                  for i in range(5 * trial)]
        got = registrations.sequential_accept(spark.createDataFrame(reqs, REG), owners,
                                              spark.createDataFrame(stored, REG) if stored else None).collect()
        exp = _brute_accept(reqs, {"o"}, stored)
        assert {(r.registration_id, r.arrival): r.outcome for r in got} == exp and len(got) == 300
        assert set(exp.values()) >= {"accepted", "registration_overlap", "duplicate_id"}


def test_a_large_cluster_is_settled_without_a_fold_of_all(spark):
    """A quarter of a million requests of one serial that all hang together, first come first served."""
    owners = spark.createDataFrame([("o",)], "owner_id string")
    n = 250_000
    r = spark.range(n).select(
        F.concat(F.lit("r"), F.col("id")).alias("registration_id"), F.lit("S").alias("serial_number"), F.lit("o").alias("owner_id"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), (F.xxhash64("id") % 1800).cast("int")).alias("start_date"), F.col("id").alias("arrival"))
    r = r.withColumn("end_date", F.date_add("start_date", (F.pmod(F.xxhash64("arrival", F.lit(1)), F.lit(40))).cast("int")))
    got = registrations.sequential_accept(r, owners).groupBy("outcome").count().collect()
    rows = [(x.start_date, x.end_date) for x in r.orderBy("arrival").collect()]
    days, accepted = set(), 0
    for s, e in rows:
        span = range(s.toordinal(), e.toordinal() + 1)
        if days.isdisjoint(span):
            days.update(span)
            accepted += 1
    assert {x.outcome: x["count"] for x in got} == {"accepted": accepted, "registration_overlap": n - accepted}


def _brute_windows(base, ps):
    now, out = {b[0]: [b[1], b[2]] for b in base}, {}
    for tid, seq, st, en, ok in sorted(ps, key=lambda p: (p[0], p[1])):
        if st is None and en is None:
            continue
        new = [st or now[tid][0], en or now[tid][1]]
        out[tid, seq] = new[1] <= new[0]
        if ok and not out[tid, seq]:
            now[tid] = new
    return out


def test_window_checks_brute_force(spark):
    from uas_spark.operators import folds
    rng = random.Random(7)

    def hour():
        return dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randint(0, 500))
    base = [(f"t{i}", dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randint(1, 500))) for i in range(8)]
    # one id holds most patches, so that its segments lie in several ranges of the deal
    ps = [(f"t{rng.choice([0] * 12 + list(range(8)))}", k, hour() if rng.random() < 0.5 else None,
           hour() if rng.random() < 0.4 else None, rng.random() < 0.9) for k in range(3000)]
    got = folds.window_checks(
        spark.createDataFrame(ps, "_tid string, _seq long, _st timestamp, _en timestamp, _ok boolean"),
        spark.createDataFrame(base, "_tid string, _st0 timestamp, _en0 timestamp")).collect()
    exp = _brute_windows(base, ps)
    assert {(r._tid, r._seq): r._bad for r in got} == exp and len(got) == len(exp)


def test_lifecycle_refuses_a_window_that_ends_before_it_starts(spark):
    base = spark.createDataFrame([("a1", "o1", "proposed", _t("2026-08-01 14:00:00"), _t("2026-08-01 18:00:00"))], AUTH)
    ps = spark.createDataFrame(
        [("a1", 1, "approved", None, None, _t("2026-07-01 00:00:00")), ("a1", 2, None, 5.0, _t("2026-08-01 17:00:00"), None),
         ("a1", 3, None, None, None, _t("2026-08-01 16:00:00")), ("a1", 4, "approved", None, None, None),
         ("a1", 5, None, None, None, _t("2026-07-01 00:00:00")), ("a1", 6, "rescinded", None, None, None)],
        "target_id string, seq long, status string, max_altitude_ft double, start_time timestamp, end_time timestamp")
    judged = patches.lifecycle_outcomes(base, ps, "authorization_id", ["max_altitude_ft"])
    assert [r.outcome for r in judged.orderBy("seq").collect()] == [
        "end_before_start", "accepted", "end_before_start", "accepted", "approved_immutable", "accepted"]
    out = patches.apply_accepted(base, judged, "authorization_id", ["status", "start_time", "end_time"], "2026-08-01 00:00:00").first()
    assert (out.status, out.start_time, out.end_time) == ("rescinded", _t("2026-08-01 17:00:00"), _t("2026-08-01 18:00:00"))


def test_stretches_brute_force(spark):
    rng = random.Random(31)
    regs = [(f"r{rng.randint(0, 99):02d}-{i}", f"S{i % 3}", "o", _day(a := rng.randint(0, 60)), _day(a + rng.choice([-1, 0, 2, 9, 40])), i)
            for i in range(90)]
    probes = [(f"p{s}-{d}", f"S{s}", _day(d)) for s in range(4) for d in range(0, 110)] + [("n1", None, _day(1)), ("n2", "S1", None)]
    got = registrations.active_registration(
        spark.createDataFrame(regs, REG), spark.createDataFrame(probes, "probe_id string, serial_number string, date date")).collect()
    exp = {}
    for pid, serial, d in probes:
        hits = [r for r in regs if r[1] == serial and d is not None and r[3] <= d <= r[4]]
        exp[pid] = min(hits, key=lambda r: (-r[3].toordinal(), r[0]))[0] if hits else None
    assert {r.probe_id: r.r_registration_id for r in got} == exp and len(got) == len(probes)


def test_dateless_patch_never_overlaps(spark):
    # the stored rows already overlap; a patch without a date must not look at that
    stored = spark.createDataFrame([("a", "S", "o", _day(0), _day(9), 0), ("b", "S", "o", _day(5), _day(15), 1)], REG)
    p = spark.createDataFrame([("a", 1, None, None)], "registration_id string, seq long, start_date date, end_date date")
    assert registrations.registration_patch_overlap(stored, p).first().outcome == "accepted"


def test_sequential_accept_ids_are_global(spark):
    rng = random.Random(5)
    for case in range(3):
        reqs = [(f"id{rng.randint(0, 25)}", f"S{rng.randint(0, 5)}", rng.choice(["o", "o", "o", "none"]),
                 _day(a := rng.randint(0, 120)), _day(a + rng.randint(0, 20)), k) for k in range(80)]
        stored = [("id3", "S1", "o", _day(0), _day(20), 0), ("z", "S2", "o", _day(30), _day(60), 0)] if case else []
        accepted, exp = list(stored), {}
        for r in reqs:
            if r[2] != "o":
                exp[r[5]] = "owner_not_found"
            elif any(x[1] == r[1] and x[3] <= r[4] and r[3] <= x[4] for x in accepted):
                exp[r[5]] = "registration_overlap"
            elif any(x[0] == r[0] for x in accepted):
                exp[r[5]] = "duplicate_id"
            else:
                exp[r[5]] = "accepted"
                accepted.append(r)
        got = registrations.sequential_accept(spark.createDataFrame(reqs, REG),
                                              spark.createDataFrame([("o",)], "owner_id string"),
                                              spark.createDataFrame(stored, REG) if stored else None)
        assert {r.arrival: r.outcome for r in got.collect()} == exp and "duplicate_id" in exp.values()


def test_insert_if_absent_ties(spark):
    ex = spark.createDataFrame([("old",)], "id string")
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y"), ("a", 2, "z"), ("b", 5, "x"), ("old", 0, "x")]
    out = ingest.insert_if_absent(ex, spark.createDataFrame(rows, "id string, t int, v string"), "id", [F.col("t")])
    got = [(r.id, r.t) for r in out.filter("outcome = 'accepted'").collect()]
    assert sorted(got) == [("a", 1), ("b", 5)] and out.count() == len(rows)


def test_explicit_null_touches_an_approved_row(spark):
    base = spark.createDataFrame([("A", "approved")], "authorization_id string, status string")
    p = spark.createDataFrame([("A", 1, "rescinded", None, True), ("A", 2, "rescinded", None, False)],
                              "target_id string, seq long, status string, max_altitude_ft double, pilot_present boolean")
    got = patches.lifecycle_outcomes(base, p, "authorization_id", ["max_altitude_ft"], present_cols=["pilot_present"])
    assert {r.seq: r.outcome for r in got.collect()} == {1: "approved_immutable", 2: "accepted"}


def test_keyed_append_reads_the_batch_dates_only(spark, tmp_path):
    from uas_spark.sources import sinks
    table = str(tmp_path / "t")
    cols = "report_id string, recorded_at timestamp, v int"
    rows = [(f"r{i}", dt.datetime(2026, 1, 1 + i % 20, i % 24), 0) for i in range(100)]
    sinks.append_time_partitioned(spark.createDataFrame(rows, cols), table)
    batch = spark.createDataFrame([("r3", rows[3][1], 7), ("new", rows[3][1], 1), ("new", rows[3][1], 2)], cols)
    out = ingest.dedup_append(spark.read.parquet(table), batch, arrival=[F.col("v")])
    assert [(r.report_id, r.v) for r in out.collect()] == [("new", 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    listed = re.findall(r"PartitionFilters: \[([^\]]*)", plan)
    assert listed and all("recorded_date" in x and "2026-01-04" in x for x in listed)


def test_small_batches_skip_row_groups_without_their_ids(spark, tmp_path, monkeypatch):
    import glob
    import os

    from pyspark.sql import functions as F

    from uas_spark.sources import sinks
    table, n = str(tmp_path / "t"), 20000
    rows = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("report_id"), F.timestamp_seconds(
        F.lit(1_767_225_600) + F.col("id") % 7200).alias("recorded_at"), F.lit(0).alias("v"))
    for part in range(5):
        sinks.append_time_partitioned(rows.filter(F.pmod(F.xxhash64("report_id", F.lit(part)), F.lit(5)) == part), table)
    assert max(map(os.path.getsize, glob.glob(table + "/*/*.parquet"))) < 1 << 18  # no filter of a megabyte each
    stored = spark.read.parquet(table)
    total = stored.count()

    def read(batch):
        found = ingest.touched(stored, batch, "recorded_date", "recorded_at", "report_id")
        found.collect()
        return found._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    fresh = rows.limit(300).withColumn("report_id", F.concat("report_id", F.lit("x"))).persist()
    assert read(fresh) < total * 0.2  # 300 new ids: nearly every row group is skipped
    again = stored.drop("recorded_date").limit(1)
    assert 0 < read(again) < total * 0.6  # a retry reads the group that holds it
    mixed = fresh.unionByName(stored.drop("recorded_date").limit(40)).withColumn("v", F.lit(1))
    odd = mixed.unionByName(mixed.limit(1).withColumn("report_id", F.lit(None).cast("string")))
    few = {tuple(r) for r in ingest.dedup_append(stored, odd).collect()}
    monkeypatch.setattr(ingest, "touched", lambda s, b, part, at, _: ingest.touched_days(s, b, part, at))
    assert few == {tuple(r) for r in ingest.dedup_append(stored, odd).collect()} and len(few) == 301
    monkeypatch.undo()
    assert read(rows) == total  # a batch beyond LOOKUP_ROWS is compared by its dates alone
    assert read(rows.limit(0)) == 0 and ingest.dedup_append(stored, rows.limit(0)).count() == 0


def test_registration_probe_overlap(spark):
    rng = random.Random(3)
    stored = [(f"r{i}", f"S{i % 3}", "o", _day(a := rng.randint(0, 300)), _day(a + rng.randint(0, 20)), i) for i in range(40)]
    cand = [(f"r{rng.randint(0, 45)}", f"S{rng.randint(0, 3)}", "o", _day(a := rng.randint(0, 300)),
             _day(a + rng.randint(0, 10)), k) for k in range(200)]
    got = registrations.registration_overlap(spark.createDataFrame(cand, REG), spark.createDataFrame(stored, REG)).collect()
    by = {r[0]: r for r in stored}
    assert len(got) == len(cand)
    for r in got:
        hits = {x[0] for x in stored if x[1] == r.serial_number and x[0] != r.registration_id
                and x[3] <= r.end_date and x[4] >= r.start_date}
        assert (r.overlapping_id in hits) if hits else r.overlapping_id is None
        if hits:
            assert by[r.overlapping_id][4] == max(by[h][4] for h in hits)


def test_far_end_dates_stay_small(spark):
    regs = spark.createDataFrame([("r1", "S", "o", dt.date(2026, 1, 1), dt.date(9999, 12, 31), 0),
                                  ("r2", "S", "o", dt.date(2026, 3, 1), dt.date(2026, 3, 9), 1)], REG)
    assert registrations._stretches(regs).count() == 3
    probes = spark.createDataFrame([("a", "S", dt.date(2026, 3, 5)), ("b", "S", dt.date(2400, 1, 1)),
                                    ("c", "S", dt.date(2025, 1, 1)), ("d", "T", dt.date(2026, 3, 5))],
                                   "probe_id string, serial_number string, date date")
    got = {r.probe_id: r.r_registration_id for r in registrations.active_registration(regs, probes).collect()}
    assert got == {"a": "r2", "b": "r1", "c": None, "d": None}
    none = registrations.active_registration(regs.filter("false"), probes).collect()
    assert len(none) == 4 and all(r.r_registration_id is None for r in none)


def test_plan_patches_see_each_other_and_the_table_follows(spark):
    t = lambda d: dt.datetime(2026, 8, d)
    plans = spark.createDataFrame([("fp", "o", "r0", None, "a1", t(1), t(5), t(1))],
                                  "flight_plan_id string, owner_id string, registration_id string, pilot_id string, "
                                  "airspace_authorization_id string, start_time timestamp, end_time timestamp, updated_at timestamp")
    none = lambda cols: spark.createDataFrame([], cols)
    ps = spark.createDataFrame([
        ("fp", 1, '{"startTime":"2026-08-04T00:00:00Z"}'), ("fp", 2, '{"endTime":"2026-08-03T00:00:00Z"}'),
        ("fp", 3, '{"endTime":"2026-08-09T00:00:00Z","airspaceAuthorizationId":"nope"}'),
        ("fp", 4, '{"startTime":"2026-08-06T00:00:00Z"}'), ("fp", 5, '{"registrationId":null}'),
        ("fp", 6, '{"startTime":"2026-08-08T00:00:00Z","airspaceAuthorizationId":"nope"}')],
        "target_id string, seq long, raw string")
    judged = patches.flight_plan_patch(plans, ps, none("pilot_id string, organization_owner_id string"),
                                       none("registration_id string, owner_id string"), none("authorization_id string"))
    got = {r.seq: r.outcome for r in judged.collect()}
    # 2 ends before the start that 1 set; 3 and 6 change nothing; 4 starts after the stored end
    assert got == {1: "accepted", 2: "end_before_start", 3: "authorization_not_found", 4: "end_before_start",
                   5: "accepted", 6: "end_before_start"}
    out = patches.apply_accepted(plans, judged, "flight_plan_id", ["start_time", "end_time"], "2026-09-01 00:00:00",
                                 cleared={"registration_id": "has_registration"}).first()
    assert (out.registration_id, out.airspace_authorization_id, out.start_time, out.end_time, out.updated_at) == (
        None, "a1", t(4), t(5), dt.datetime(2026, 9, 1))


def test_rows_without_a_reference_are_spread(spark):
    from pyspark.sql import functions as F

    from uas_spark.operators import refs
    plans = spark.range(2000).select(F.col("id").cast("string").alias("flight_plan_id"), F.lit("O-1").alias("owner_id"),
                                     F.when(F.col("id") < 2, F.concat(F.lit("P-"), F.col("id"))).alias("pilot_id"))
    pilots = spark.createDataFrame([("P-1", "O-1"), (None, "O-1")], "pilot_id string, organization_owner_id string")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = refs.ref_pilot_under_owner(plans, pilots).withColumn("task", F.spark_partition_id())
        rows = out.select("flight_plan_id", "pilot_found", "task").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 2000 and [r.flight_plan_id for r in rows if not r.pilot_found] == ["0"]
    per_task = [sum(1 for r in rows if r.task == t) for t in {r.task for r in rows}]
    assert len(per_task) > 2 and max(per_task) < 1000


def test_registration_patch_overlap_plans_its_patches_once(spark):
    """the patches are read once; every later step reads the saved rows."""
    import datetime as dt
    d = dt.date(2024, 1, 1)
    stored = spark.createDataFrame([("R-1", "S", d, d), ("R-2", "S", d, d + dt.timedelta(9))],
                                   "registration_id string, serial_number string, start_date date, end_date date")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    p = spark.createDataFrame([("R-1", 1, None, d + dt.timedelta(3)), ("R-2", 2, d + dt.timedelta(5), None),
                               ("R-1", 3, None, d + dt.timedelta(4)), ("R-1", 4, d + dt.timedelta(5), None), ("R-9", 1, d, d)],
                              "registration_id string, seq long, start_date date, end_date date")
    out = registrations.registration_patch_overlap(stored, p.mapInArrow(counted, p.schema))
    got = {(r.registration_id, r.seq): r.outcome for r in out.collect()}
    assert got == {("R-1", 1): "registration_overlap", ("R-2", 2): "accepted", ("R-1", 3): "accepted",
                   ("R-1", 4): "end_before_start", ("R-9", 1): "not_found"}
    assert seen.value == 5


def test_look_ups_of_saved_rows_leave_rows_without_a_key_out(spark):
    """same rows as by the join of all of them; repeated and null keys on both sides."""
    from uas_spark.operators import refs
    rows = spark.createDataFrame([(i, [None, "a", "b", "x"][i % 4], ["o", None, "p"][i % 3]) for i in range(24)],
                                 "k int, pilot_id string, owner_id string")
    pilots = spark.createDataFrame([("a", "o"), ("a", "o"), ("b", "p"), (None, "o")], "pilot_id string, organization_owner_id string")
    regs = spark.createDataFrame([("a", "o"), ("a", "p"), ("b", None), (None, "o")], "registration_id string, owner_id string")
    auths = spark.createDataFrame([("a",), (None,), ("a",)], "authorization_id string")
    for look in (lambda **s: refs.ref_pilot_under_owner(rows, pilots, **s),
                 lambda **s: refs.ref_registration_owner(rows, regs, "pilot_id", **s),
                 lambda **s: refs.ref_authorization_exists(rows, auths, "pilot_id", **s)):
        one, other = look(saved=False), look(saved=True)
        assert one.columns == other.columns
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
        assert "_ls" not in other._jdf.queryExecution().optimizedPlan().toString()


def test_patches_are_made_once(spark, tmp_path):
    """the outcomes read saved patches, not the order lines again; waypoints are dealt once (F1)."""
    import datetime as dt
    from uas_spark.plans import registry
    from uas_spark.sources import fixtures as fx
    day = dt.date(2024, 1, 1)
    lines = [(o, 3 * o + k, 7 * o + k, 1, float(k + 1), 10.0, 0.1, 0.0, "RAN"[(o + k) % 3], "OF"[k % 2], day)
             for o in (1, 2, 3, 5, 8, None) for k in range(3) if o is not None] + [(None, 5, 5, 1, 2.0, 1.0, 0.0, 0.0, "N", "O", day)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                                 "l_linestatus string, l_shipdate date").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(o, o, "POF"[o % 3], 1.0, day, "1-URGENT") for o in (1, 2, 3, 4, 5)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, "
                          "o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(c, f"c{c}", 1, 1.0, "BUILDING") for c in range(1, 9)],
                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
                          ).write.parquet(str(tmp_path / "customer.parquet"))
    for key in ("authorization_lifecycle", "flight_plan_patch"):
        out = registry.QUERIES[key](spark, str(tmp_path))
        assert "l_partkey" not in out._jdf.queryExecution().optimizedPlan().toString(), key
        assert out.count() == 16, key
    dealt = fx.waypoints(spark, str(tmp_path))
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {("FP-2", 0), ("FP-2", 5), ("FP-4", 2), ("FP-6", 0), ("FP-8", 2)}
    got = {(r.flight_plan_id, r.sequence_number) for r in dealt.collect()}
    assert want <= got and ("FP-2", 6) not in got
