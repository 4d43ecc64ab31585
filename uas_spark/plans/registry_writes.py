"""Registered queries of the write path: ingest, reference checks, registrations, patches,
deletes (M1-M24) and the keyed listings (F1-F12, P3, P6, T5, T6, G1-G4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, listings, patches, refs, registrations
from ..session import saved_rows
from ..sources import fixtures as fx
from .oracle_fixtures import iso, with_fixtures
from .registry import ORACLE, query

STAMP = "2024-02-01 00:00:00"
AS_OF = "2023-11-15"


# ============================================================ M1-M6

@query("dedup_append_live", with_fixtures("live_stored", "live_batch") + f"""
SELECT report_id, {iso('recorded_at')} AS recorded_at, drone_serial_number
FROM (SELECT *, row_number() OVER (PARTITION BY recorded_at, report_id ORDER BY attempt) rn FROM live_batch) b
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM live_stored s WHERE s.recorded_at = b.recorded_at
                                                          AND s.report_id = b.report_id)""")
def q_dedup_append_live(spark, sf_dir):
    out = ingest.dedup_append(fx.live_stored(spark, sf_dir), fx.live_batch(spark, sf_dir),
                              arrival=[F.col("attempt")])
    return out.select("report_id", "recorded_at", "drone_serial_number")


def _sensor_split(spark, sf_dir):
    sp = fx.sensor_positions(spark, sf_dir)
    stored = sp.filter(F.col("recorded_at") < F.to_timestamp(F.lit(fx.STORED_BEFORE)))
    b = sp.filter(F.col("recorded_at") >= F.to_timestamp(F.lit(fx.BATCH_FROM)))
    batch = b.withColumn("attempt", F.lit(0)).unionByName(b.withColumn("attempt", F.lit(1)))
    return stored, batch


_SENSOR_SPLIT = """sstored AS (SELECT * FROM sensor_positions WHERE recorded_at < TIMESTAMP '2024-01-16 00:00:00'),
sbatch AS (SELECT *, 0 AS attempt FROM sensor_positions WHERE recorded_at >= TIMESTAMP '2024-01-10 00:00:00'
           UNION ALL SELECT *, 1 AS attempt FROM sensor_positions WHERE recorded_at >= TIMESTAMP '2024-01-10 00:00:00'),
unknown AS (SELECT DISTINCT b.batch_id, b.sensor_id FROM sbatch b
            WHERE b.sensor_id NOT IN (SELECT sensor_id FROM sensors))"""


@query("dedup_append_sensor", with_fixtures("sensor_positions", "sensors") + f""", {_SENSOR_SPLIT}
SELECT 'rejected' AS kind, string_agg(sensor_id, ',' ORDER BY sensor_id) AS report_id, 'unknown_sensor' AS sensor_id,
       batch_id FROM unknown GROUP BY batch_id
UNION ALL
SELECT 'stored', report_id, sensor_id, batch_id
FROM (SELECT *, row_number() OVER (PARTITION BY recorded_at, report_id ORDER BY attempt) rn FROM sbatch) b
WHERE rn = 1 AND batch_id NOT IN (SELECT batch_id FROM unknown)
  AND NOT EXISTS (SELECT 1 FROM sstored s WHERE s.recorded_at = b.recorded_at AND s.report_id = b.report_id)""")
def q_dedup_append_sensor(spark, sf_dir):
    stored, batch = _sensor_split(spark, sf_dir)
    new, rejected = ingest.sensor_ingest(stored, batch, fx.sensors(spark, sf_dir), arrival=[F.col("attempt")])
    bad = rejected.select(F.lit("rejected").alias("kind"), F.array_join("unknown_sensor_ids", ",").alias("report_id"),
                          F.col("reason").alias("sensor_id"), "batch_id")
    return new.select(F.lit("stored").alias("kind"), "report_id", "sensor_id", "batch_id").unionByName(bad)


@query("unknown_sensor_check", with_fixtures("sensor_positions", "sensors") + f""", {_SENSOR_SPLIT}
SELECT batch_id, string_agg(sensor_id, ',' ORDER BY sensor_id) AS unknown_sensor_ids
FROM unknown GROUP BY batch_id""")
def q_unknown_sensor_check(spark, sf_dir):
    _, batch = _sensor_split(spark, sf_dir)
    out = ingest.unknown_sensors(batch, fx.sensors(spark, sf_dir))
    return out.select("batch_id", F.array_join("unknown_sensor_ids", ",").alias("unknown_sensor_ids"))


@query("dedup_append_zone", with_fixtures("zone_reports") + f"""
SELECT kind, report_id, {iso('recorded_at')} AS recorded_at, zone_id
FROM (SELECT *, row_number() OVER (PARTITION BY kind, recorded_at, report_id ORDER BY attempt) rn
      FROM (SELECT *, 0 AS attempt FROM zone_reports WHERE ingested_at >= TIMESTAMP '2024-01-10 00:00:00'
            UNION ALL SELECT *, 1 AS attempt FROM zone_reports WHERE ingested_at >= TIMESTAMP '2024-01-10 00:00:00')) b
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM zone_reports s WHERE s.ingested_at < TIMESTAMP '2024-01-16 00:00:00'
   AND s.kind = b.kind AND s.recorded_at = b.recorded_at AND s.report_id = b.report_id)""")
def q_dedup_append_zone(spark, sf_dir):
    """M3: the four zone tables are one DataFrame keyed additionally by ``kind``."""
    z = fx.zone_reports(spark, sf_dir)
    stored = z.filter(F.col("ingested_at") < F.to_timestamp(F.lit(fx.STORED_BEFORE)))
    b = z.filter(F.col("ingested_at") >= F.to_timestamp(F.lit(fx.BATCH_FROM)))
    batch = b.withColumn("attempt", F.lit(0)).unionByName(b.withColumn("attempt", F.lit(1)))
    out = ingest.dedup_append(stored, batch, ["kind", "recorded_at", "report_id"], [F.col("attempt")])
    return out.select("kind", "report_id", "recorded_at", "zone_id")


@query("atomic_batch", with_fixtures("live_positions") + """
SELECT event_id // 50 AS batch_id,
       CAST(sum(CASE WHEN NOT (47.0 + altitude_ft / 4 > -90 AND 47.0 + altitude_ft / 4 < 90) THEN 1 ELSE 0 END) AS BIGINT) AS bad_rows,
       count(*) AS n_rows
FROM live_positions GROUP BY event_id // 50""")
def q_atomic_batch(spark, sf_dir):
    """M4: report batches of 50 whose vertex latitude (47 + value/4) must lie strictly inside
    (-90, 90); a batch with one bad report is rejected whole. Verdict per batch."""
    e = fx.load(spark, sf_dir, "events")
    rows = e.select((F.col("event_id") / 50).cast("long").alias("batch_id"),
                    (F.lit(47.0) + F.col("value") / 4).alias("lat"))
    from ..operators.validate import coordinates_ok
    good, bad = ingest.atomic_batch(rows, "batch_id", coordinates_ok(F.col("lat"), F.lit(0.0)))
    verdict_good = good.groupBy("batch_id").agg(F.lit(0).cast("long").alias("bad_rows"),
                                                F.count(F.lit(1)).alias("n_rows"))
    n = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"))
    verdict_bad = bad.join(n, "batch_id").select("batch_id", F.col("bad_rows").cast("long"), "n_rows")
    return verdict_good.unionByName(verdict_bad)


@query("insert_if_absent", with_fixtures("authorizations") + """
SELECT authorization_id, CASE WHEN start_time < TIMESTAMP '2024-01-15 00:00:00' OR n = 1 THEN 'duplicate_id'
                              ELSE 'accepted' END AS outcome, count(*) AS n_requests
FROM authorizations, (SELECT unnest([0, 1]) AS n) GROUP BY ALL""")
def q_insert_if_absent(spark, sf_dir):
    """M6: all authorizations submitted twice at the same instant; those starting before Jan 15
    are already stored."""
    a = fx.authorizations(spark, sf_dir)
    existing = a.filter(F.col("start_time") < F.to_timestamp(F.lit("2024-01-15 00:00:00")))
    out = ingest.insert_if_absent(existing, a.unionAll(a), "authorization_id", [F.col("created_at")])
    return out.groupBy("authorization_id", "outcome").agg(F.count(F.lit(1)).alias("n_requests"))


@query("distinct_ids", with_fixtures("sensor_positions", "sensors") + """
SELECT DISTINCT sensor_id AS id FROM sensor_positions WHERE sensor_id NOT IN (SELECT sensor_id FROM sensors)""")
def q_distinct_ids(spark, sf_dir):
    """Unique referenced sensor ids minus registered ones."""
    return ingest.distinct_missing(fx.sensor_positions(spark, sf_dir), "sensor_id", fx.sensors(spark, sf_dir),
                                   "sensor_id")


# ============================================================ M7-M12

@query("ref_owner_exists", with_fixtures("flight_plans", "owners") + """
SELECT flight_plan_id, owner_id IN (SELECT owner_id FROM owners) AS owner_found FROM flight_plans""")
def q_ref_owner_exists(spark, sf_dir):
    return refs.ref_owner_exists(fx.flight_plans(spark, sf_dir), fx.owners(spark, sf_dir)).select(
        "flight_plan_id", "owner_found")


@query("ref_pilot_under_owner", with_fixtures("flight_plans", "pilots") + """
SELECT flight_plan_id, pilot_id IS NULL OR EXISTS (SELECT 1 FROM pilots p WHERE p.pilot_id = f.pilot_id
                                                   AND p.organization_owner_id = f.owner_id) AS pilot_found
FROM flight_plans f""")
def q_ref_pilot_under_owner(spark, sf_dir):
    return refs.ref_pilot_under_owner(fx.flight_plans(spark, sf_dir), fx.pilots(spark, sf_dir)).select(
        "flight_plan_id", "pilot_found")


@query("ref_pilot_standalone", with_fixtures("waivers", "pilots") + """
SELECT waiver_id, pilot_id IS NULL OR pilot_id IN (SELECT pilot_id FROM pilots) AS pilot_found FROM waivers""")
def q_ref_pilot_standalone(spark, sf_dir):
    return refs.ref_pilot_standalone(fx.waivers(spark, sf_dir), fx.pilots(spark, sf_dir)).select(
        "waiver_id", "pilot_found")


@query("ref_registration_owner", with_fixtures("flight_plans", "registrations") + """
SELECT f.flight_plan_id, CASE WHEN f.registration_id IS NULL THEN NULL WHEN r.registration_id IS NULL
  THEN 'registration_not_found' WHEN r.owner_id <> f.owner_id THEN 'registration_owner_mismatch' END
  AS registration_check
FROM flight_plans f LEFT JOIN registrations r ON r.registration_id = f.registration_id""")
def q_ref_registration_owner(spark, sf_dir):
    return refs.ref_registration_owner(fx.flight_plans(spark, sf_dir), fx.registrations(spark, sf_dir)).select(
        "flight_plan_id", "registration_check")


@query("ref_authorization_exists", with_fixtures("flight_plans", "authorizations") + """
SELECT flight_plan_id, airspace_authorization_id IS NULL
       OR airspace_authorization_id IN (SELECT authorization_id FROM authorizations) AS authorization_found
FROM flight_plans""")
def q_ref_authorization_exists(spark, sf_dir):
    return refs.ref_authorization_exists(fx.flight_plans(spark, sf_dir), fx.authorizations(spark, sf_dir)).select(
        "flight_plan_id", "authorization_found")


@query("pilot_owner_is_organization", with_fixtures("pilots", "owners") + """
SELECT p.pilot_id, CASE WHEN o.owner_id IS NULL THEN 'owner_not_found'
                        WHEN o.owner_type <> 'organization' THEN 'owner_not_organization' END AS reason
FROM pilots p LEFT JOIN owners o ON o.owner_id = p.organization_owner_id""")
def q_pilot_owner_is_organization(spark, sf_dir):
    return refs.pilot_owner_is_organization(fx.pilots(spark, sf_dir), fx.owners(spark, sf_dir)).select(
        "pilot_id", "reason")


@query("flight_plan_create_check", with_fixtures("flight_plans", "owners", "pilots", "registrations",
                                                 "authorizations") + """
SELECT f.flight_plan_id,
  CASE WHEN f.owner_id NOT IN (SELECT owner_id FROM owners) THEN 'owner_not_found'
       WHEN f.pilot_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pilots p WHERE p.pilot_id = f.pilot_id
            AND p.organization_owner_id = f.owner_id) THEN 'pilot_not_found'
       WHEN f.registration_id IS NOT NULL AND r.registration_id IS NULL THEN 'registration_not_found'
       WHEN f.registration_id IS NOT NULL AND r.owner_id <> f.owner_id THEN 'registration_owner_mismatch'
       WHEN f.start_time < TIMESTAMP '2024-01-10 00:00:00' THEN 'duplicate_id'
       WHEN f.airspace_authorization_id IS NOT NULL
            AND f.airspace_authorization_id NOT IN (SELECT authorization_id FROM authorizations)
         THEN 'authorization_not_found'
       ELSE 'accepted' END AS outcome
FROM flight_plans f LEFT JOIN registrations r ON r.registration_id = f.registration_id""")
def q_flight_plan_create_check(spark, sf_dir):
    """Entry 3 of the reference: create plans with every reference check; plans starting
    before Jan 10 already exist."""
    fp = fx.flight_plans(spark, sf_dir)
    existing = fp.filter(F.col("start_time") < F.to_timestamp(F.lit("2024-01-10 00:00:00")))
    out = refs.flight_plan_create_check(fp, fx.owners(spark, sf_dir), fx.pilots(spark, sf_dir),
                                        fx.registrations(spark, sf_dir), fx.authorizations(spark, sf_dir),
                                        existing, [F.col("created_at")])
    return out.select("flight_plan_id", "outcome")


# ============================================================ M13, M14, M17, T5, P3, F1, F9

@query("registration_overlap", with_fixtures("registrations") + """
SELECT c.registration_id, EXISTS (SELECT 1 FROM registrations s
  WHERE s.serial_number = c.serial_number AND s.registration_id <> c.registration_id
    AND s.start_date <= c.end_date AND c.start_date <= s.end_date) AS overlap
FROM registrations c""")
def q_registration_overlap(spark, sf_dir):
    """M13 over the whole table: each registration against every other of its serial."""
    return registrations.self_overlap(fx.registrations(spark, sf_dir)).select("registration_id", "overlap")


@query("registration_sequential_accept", with_fixtures("registrations", "owners").replace("WITH ", "WITH RECURSIVE ", 1) + """,
req AS (SELECT r.*, r.owner_id IN (SELECT owner_id FROM owners) AS owner_ok,
               row_number() OVER (PARTITION BY serial_number ORDER BY arrival) AS rn FROM registrations r),
fold(serial_number, rn, acc, ids, registration_id, outcome) AS (
  SELECT DISTINCT serial_number, CAST(0 AS BIGINT), CAST([] AS STRUCT(s DATE, e DATE)[]), CAST([] AS VARCHAR[]),
         CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM req
  UNION ALL
  SELECT serial_number, rn,
         CASE WHEN outcome = 'accepted' THEN list_append(acc, {'s': sd, 'e': ed}) ELSE acc END,
         CASE WHEN outcome = 'accepted' THEN list_append(ids, rid) ELSE ids END, rid, outcome
  FROM (SELECT f.serial_number, q.rn, f.acc, f.ids, q.start_date AS sd, q.end_date AS ed, q.registration_id AS rid,
               CASE WHEN NOT q.owner_ok THEN 'owner_not_found'
                    WHEN len(list_filter(f.acc, lambda a: a.s <= q.end_date AND q.start_date <= a.e)) > 0
                      THEN 'registration_overlap'
                    WHEN list_contains(f.ids, q.registration_id) THEN 'duplicate_id'
                    ELSE 'accepted' END AS outcome
        FROM fold f JOIN req q ON q.serial_number = f.serial_number AND q.rn = f.rn + 1) x)
SELECT registration_id, outcome FROM fold WHERE registration_id IS NOT NULL""")
def q_registration_sequential_accept(spark, sf_dir):
    out = registrations.sequential_accept(fx.registrations(spark, sf_dir), fx.owners(spark, sf_dir))
    return out.select("registration_id", "outcome")


def _judged(key: str) -> str:
    """The oracle of a patch operator as a named table j, for the table after its accepted patches."""
    head, _, tail = ORACLE[key].rpartition("\nSELECT ")
    return f"{head},\nj AS (SELECT {tail})\n"


def _reg_patches(spark, sf_dir):
    p = fx.lineitem_pairs(spark, sf_dir)
    d0 = F.to_date(F.lit("2023-09-01"))
    return p.select(F.concat(F.lit("R-"), F.col("l_orderkey").cast("string")).alias("registration_id"),
                    F.col("l_linenumber").cast("long").alias("seq"),
                    F.when(F.col("l_linestatus") == "O", F.date_add(d0, (F.col("l_partkey") % 180).cast("int")))
                     .alias("start_date"),
                    F.when(F.col("l_returnflag") == "R", F.date_add(d0, (F.col("l_suppkey") % 200).cast("int")))
                     .alias("end_date"))


@query("registration_patch_overlap", with_fixtures("registrations", "lineitem_pairs").replace("WITH ", "WITH RECURSIVE ", 1) + """,
p AS (SELECT 'R-' || CAST(l_orderkey AS VARCHAR) AS registration_id, CAST(l_linenumber AS BIGINT) AS seq,
        CASE WHEN l_linestatus = 'O' THEN DATE '2023-09-01' + CAST(l_partkey % 180 AS INTEGER) END AS start_date,
        CASE WHEN l_returnflag = 'R' THEN DATE '2023-09-01' + CAST(l_suppkey % 200 AS INTEGER) END AS end_date
      FROM lineitem_pairs),
m AS (SELECT p.*, b.serial_number, p.start_date IS NOT NULL OR p.end_date IS NOT NULL AS dated,
             row_number() OVER (PARTITION BY b.serial_number ORDER BY p.seq, p.registration_id) AS rn
      FROM p LEFT JOIN registrations b ON b.registration_id = p.registration_id),
fold(serial_number, rn, cur, registration_id, seq, outcome) AS (
  SELECT serial_number, CAST(0 AS BIGINT), list({'r': registration_id, 's': start_date, 'e': end_date}),
         CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM registrations GROUP BY 1
  UNION ALL
  SELECT serial_number, rn,
         CASE WHEN outcome = 'accepted' AND dated
              THEN list_transform(cur, lambda x: CASE WHEN x.r = rid THEN {'r': x.r, 's': ns, 'e': ne} ELSE x END) ELSE cur END,
         rid, seq, outcome
  FROM (SELECT *, CASE WHEN NOT dated THEN 'accepted'
                       WHEN len(list_filter(cur, lambda x: x.r <> rid AND x.s <= ne AND ns <= x.e)) > 0 THEN 'registration_overlap'
                       WHEN ne < ns THEN 'end_before_start' ELSE 'accepted' END AS outcome
        FROM (SELECT *, coalesce(sd, me.s) AS ns, coalesce(ed, me.e) AS ne
              FROM (SELECT f.serial_number, f.cur, m.rn, m.registration_id AS rid, m.seq, m.dated, m.start_date AS sd,
                           m.end_date AS ed, list_filter(f.cur, lambda x: x.r = m.registration_id)[1] AS me
                    FROM fold f JOIN m ON m.serial_number = f.serial_number AND m.rn = f.rn + 1) a) b) c)
SELECT registration_id, seq, outcome FROM fold WHERE seq IS NOT NULL
UNION ALL SELECT registration_id, seq, 'not_found' FROM m WHERE serial_number IS NULL""")
def q_registration_patch_overlap(spark, sf_dir):
    out = registrations.registration_patch_overlap(fx.registrations(spark, sf_dir), _reg_patches(spark, sf_dir))
    return out.select("registration_id", "seq", "outcome")


@query("registration_patch_table", _judged("registration_patch_overlap") + f""",
k AS (SELECT p.registration_id, arg_max(p.start_date, p.seq) FILTER (WHERE p.start_date IS NOT NULL) AS sd,
             arg_max(p.end_date, p.seq) FILTER (WHERE p.end_date IS NOT NULL) AS ed
      FROM p JOIN j ON j.registration_id = p.registration_id AND j.seq = p.seq WHERE j.outcome = 'accepted' GROUP BY 1)
SELECT r.registration_id, CAST(coalesce(k.sd, r.start_date) AS VARCHAR) AS start_date,
       CAST(coalesce(k.ed, r.end_date) AS VARCHAR) AS end_date,
       CASE WHEN k.registration_id IS NOT NULL THEN '{STAMP}.000000' ELSE {iso('r.created_at')} END AS updated_at
FROM registrations r LEFT JOIN k ON k.registration_id = r.registration_id""")
def q_registration_patch_table(spark, sf_dir):
    """The registrations after their accepted patches."""
    r, ps = fx.registrations(spark, sf_dir), _reg_patches(spark, sf_dir)
    judged = registrations.registration_patch_overlap(r, ps)
    out = patches.apply_accepted(r, judged, "registration_id", ["start_date", "end_date"], STAMP,
                                 target_col="registration_id")
    return out.select("registration_id", F.col("start_date").cast("string"), F.col("end_date").cast("string"),
                      "updated_at")


@query("join_positions_registration", with_fixtures("live_positions", "registrations") + """
SELECT position_id, registration_id, owner_id FROM (
  SELECT p.report_id AS position_id, r.registration_id, r.owner_id,
         row_number() OVER (PARTITION BY p.report_id ORDER BY r.start_date DESC, r.registration_id) rn
  FROM live_positions p LEFT JOIN registrations r ON r.serial_number = p.drone_serial_number
   AND r.start_date <= CAST(p.recorded_at AS DATE) AND r.end_date >= CAST(p.recorded_at AS DATE)) WHERE rn = 1""")
def q_join_positions_registration(spark, sf_dir):
    pos = fx.live_positions(spark, sf_dir).select(F.col("report_id").alias("position_id"), "drone_serial_number",
                                                  F.to_date("recorded_at").alias("date"))
    out = registrations.active_registration(fx.registrations(spark, sf_dir), pos, "drone_serial_number", "date",
                                            "position_id")
    return out.select(
        "position_id", F.col("r_registration_id").alias("registration_id"), F.col("r_owner_id").alias("owner_id"))


@query("registration_active_by_serial", with_fixtures("registrations") + f"""
SELECT s.serial_number, r.registration_id FROM (SELECT DISTINCT serial_number FROM registrations) s LEFT JOIN (
  SELECT serial_number, registration_id,
         row_number() OVER (PARTITION BY serial_number ORDER BY start_date DESC, registration_id) rn
  FROM registrations WHERE start_date <= DATE '{AS_OF}' AND end_date >= DATE '{AS_OF}') r
  ON r.serial_number = s.serial_number AND r.rn = 1""")
def q_registration_active_by_serial(spark, sf_dir):
    """T5 for every serial on one date (default 'today' is a parameter here)."""
    r = fx.registrations(spark, sf_dir)
    probes = r.select("serial_number").distinct().select(
        F.col("serial_number").alias("probe_id"), "serial_number", F.to_date(F.lit(AS_OF)).alias("date"))
    out = registrations.active_registration(r, probes)
    return out.select("serial_number", F.col("r_registration_id").alias("registration_id"))


@query("list_registrations", with_fixtures("registrations") + f"""
SELECT registration_id, serial_number, owner_id, strftime(start_date, '%Y-%m-%d') AS start_date,
       {iso('created_at')} AS created_at FROM registrations""")
def q_list_registrations(spark, sf_dir):
    return registrations.list_registrations(fx.registrations(spark, sf_dir)).select(
        "registration_id", "serial_number", "owner_id", "start_date", "created_at")


@query("owner_registrations", with_fixtures("owners", "registrations") + f""",
probes AS (SELECT 'O-' || CAST(o_custkey AS VARCHAR) AS owner_id FROM orders
           UNION SELECT 'O-' || CAST(o_custkey + 100000 AS VARCHAR) FROM orders WHERE o_orderkey % 97 = 0)
SELECT p.owner_id, o.owner_id IS NOT NULL AS owner_found, r.registration_id
FROM probes p LEFT JOIN owners o ON o.owner_id = p.owner_id
LEFT JOIN registrations r ON o.owner_id IS NOT NULL AND r.owner_id = p.owner_id
  AND r.start_date <= DATE '{AS_OF}' AND r.end_date >= DATE '{AS_OF}'""")
def q_owner_registrations(spark, sf_dir):
    """every ordering customer as a probe, plus unknown owner ids; registrations as of a date."""
    o = fx.load(spark, sf_dir, "orders")
    probes = (o.select(F.concat(F.lit("O-"), F.col("o_custkey").cast("string")).alias("owner_id"))
              .union(o.filter(F.col("o_orderkey") % 97 == 0).select(
                  F.concat(F.lit("O-"), (F.col("o_custkey") + 100000).cast("string")).alias("owner_id")))
              .distinct())
    out = registrations.owner_registrations(fx.owners(spark, sf_dir), fx.registrations(spark, sf_dir), probes, AS_OF)
    return out.select("owner_id", "owner_found", "registration_id")


# ============================================================ M15, M16, M18, M19, M21-M24

def _owner_patches(spark, sf_dir):
    p = fx.lineitem_pairs(spark, sf_dir)
    return p.select(F.concat(F.lit("O-"), F.col("l_orderkey").cast("string")).alias("target_id"),
                    F.col("l_linenumber").cast("long").alias("seq"),
                    F.when(F.col("l_linestatus") == "O",
                           F.concat(F.lit("+1-999-"), F.col("l_partkey").cast("string"))).alias("phone_number"),
                    F.when(F.col("l_returnflag") == "R",
                           F.concat(F.lit("City R"), F.col("l_suppkey").cast("string"))).alias("address_city"))


@query("patch_coalesce", with_fixtures("owners", "lineitem_pairs") + f""",
p AS (SELECT 'O-' || CAST(l_orderkey AS VARCHAR) AS target_id, l_linenumber AS seq,
        CASE WHEN l_linestatus = 'O' THEN '+1-999-' || CAST(l_partkey AS VARCHAR) END AS phone_number,
        CASE WHEN l_returnflag = 'R' THEN 'City R' || CAST(l_suppkey AS VARCHAR) END AS address_city
      FROM lineitem_pairs),
a AS (SELECT target_id, arg_max(phone_number, seq) FILTER (WHERE phone_number IS NOT NULL) AS ph,
             arg_max(address_city, seq) FILTER (WHERE address_city IS NOT NULL) AS city FROM p GROUP BY target_id)
SELECT 'owner' AS kind, o.owner_id, coalesce(a.ph, o.phone_number) AS phone_number,
       coalesce(a.city, o.address_city) AS address_city,
       CASE WHEN a.target_id IS NOT NULL THEN '{STAMP}.000000' ELSE {iso('o.updated_at')} END AS updated_at,
       CAST(-1 AS BIGINT) AS seq
FROM owners o LEFT JOIN a ON a.target_id = o.owner_id
UNION ALL
SELECT 'not_found', target_id, phone_number, address_city, NULL, seq FROM p
WHERE target_id NOT IN (SELECT owner_id FROM owners)""")
def q_patch_coalesce(spark, sf_dir):
    """The owners after their patches, and the patches whose owner does not exist."""
    out, missing = patches.patch_coalesce(fx.owners(spark, sf_dir), _owner_patches(spark, sf_dir), "owner_id",
                                          ["phone_number", "address_city"], STAMP)
    cols = ["kind", "owner_id", "phone_number", "address_city", "updated_at", "seq"]
    found = out.withColumns({"kind": F.lit("owner"), "seq": F.lit(-1).cast("long")}).select(*cols)
    lost = missing.select(F.col("reason").alias("kind"), F.col("target_id").alias("owner_id"), "phone_number",
                          "address_city", F.lit(None).cast("timestamp").alias("updated_at"), "seq")
    return found.unionByName(lost)


@query("patch_nullable", with_fixtures("authorizations", "lineitem_pairs") + """,
p AS (SELECT 'A-' || CAST(l_orderkey AS VARCHAR) AS target_id, l_linenumber AS seq,
        l_returnflag IN ('R', 'A') AS present,
        CASE WHEN l_returnflag = 'A' THEN 'P-' || CAST(l_partkey AS VARCHAR) END AS val FROM lineitem_pairs),
a AS (SELECT target_id, arg_max_null(val, seq) FILTER (WHERE present) AS val, max(seq) FILTER (WHERE present) AS s
      FROM p GROUP BY target_id)
SELECT x.authorization_id, CASE WHEN a.s IS NOT NULL THEN a.val ELSE x.pilot_id END AS pilot_id
FROM authorizations x LEFT JOIN a ON a.target_id = x.authorization_id""")
def q_patch_nullable(spark, sf_dir):
    """Pilot link patches as raw JSON: R clears (explicit null), A sets, N omits the key."""
    p = fx.lineitem_pairs(spark, sf_dir)
    raw = (F.when(F.col("l_returnflag") == "R", F.lit('{"pilotId":null}'))
            .when(F.col("l_returnflag") == "A",
                  F.concat(F.lit('{"pilotId":"P-'), F.col("l_partkey").cast("string"), F.lit('"}')))
            .otherwise(F.lit('{"maxAltitudeFt":100}')))
    pt = p.select(F.concat(F.lit("A-"), F.col("l_orderkey").cast("string")).alias("target_id"),
                  F.col("l_linenumber").cast("long").alias("seq"), raw.alias("raw"))
    out = patches.patch_nullable(fx.authorizations(spark, sf_dir), pt, "authorization_id", "pilot_id", "pilotId",
                                 STAMP)
    return out.select("authorization_id", "pilot_id")


@query("authorization_lifecycle", with_fixtures("authorizations", "lifecycle_patches", "pilots").replace(
    "WITH ", "WITH RECURSIVE ", 1) + """,
q AS (SELECT l.*, a.owner_id, CASE WHEN l.pilot_pick = 'own' THEN 'P-' || substr(a.owner_id, 3) ELSE l.pilot_pick END AS pilot_id,
             row_number() OVER (PARTITION BY target_id ORDER BY seq) AS rn
      FROM lifecycle_patches l LEFT JOIN authorizations a ON a.authorization_id = l.target_id),
p AS (SELECT q.*, pilot_id IS NULL OR EXISTS (SELECT 1 FROM pilots x WHERE x.pilot_id = q.pilot_id
        AND x.organization_owner_id = q.owner_id) AS pilot_ok FROM q),
fold(target_id, rn, s, st, en, seq, outcome, status_after) AS (
  SELECT authorization_id, CAST(0 AS BIGINT), status, start_time, end_time, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR),
         CAST(NULL AS VARCHAR) FROM authorizations
  UNION ALL
  SELECT target_id, rn, CASE WHEN outcome = 'accepted' THEN coalesce(pst, s) ELSE s END,
         CASE WHEN outcome = 'accepted' THEN coalesce(pstart, st) ELSE st END,
         CASE WHEN outcome = 'accepted' THEN coalesce(pend, en) ELSE en END, seq, outcome,
         CASE WHEN outcome = 'accepted' THEN coalesce(pst, s) ELSE s END
  FROM (SELECT f.target_id, p.rn, f.s, f.st, f.en, p.seq, p.status AS pst, p.start_time AS pstart, p.end_time AS pend,
               CASE WHEN NOT p.pilot_ok THEN 'pilot_not_found'
                    WHEN f.s = 'rescinded' THEN 'rescinded_terminal'
                    WHEN f.s = 'approved' AND NOT coalesce(p.status = 'rescinded' AND p.max_altitude_ft IS NULL
                         AND p.start_time IS NULL AND p.end_time IS NULL AND NOT p.pilot_present, false)
                      THEN 'approved_immutable'
                    WHEN coalesce(p.end_time, f.en) <= coalesce(p.start_time, f.st) THEN 'end_before_start'
                    ELSE 'accepted' END AS outcome
        FROM fold f JOIN p ON p.target_id = f.target_id AND p.rn = f.rn + 1) x)
SELECT target_id, seq, outcome, status_after FROM fold WHERE seq IS NOT NULL""")
def q_authorization_lifecycle(spark, sf_dir):
    """M18 with the pilot check under the authorization's owner and the window check."""
    return _auth_outcomes(spark, sf_dir).select("target_id", "seq", "outcome", "status_after")


def _auth_outcomes(spark, sf_dir):
    a = fx.authorizations(spark, sf_dir)
    p = fx.lifecycle_patches(spark, sf_dir, "A-")
    p = p.join(a.select(F.col("authorization_id").alias("target_id"), F.col("owner_id").alias("_owner")), "target_id", "left")
    p = p.withColumn("pilot_id", F.when(F.col("pilot_pick") == "own", F.concat(F.lit("P-"), F.expr("substring(_owner, 3)")))
                     .otherwise(F.col("pilot_pick")))
    # saved: the window checks and the gate both read the patches, those with a pilot apart
    p = refs.ref_pilot_under_owner(saved_rows(p.drop("pilot_pick")), fx.pilots(spark, sf_dir), "pilot_id", "_owner", saved=True)
    return patches.lifecycle_outcomes(a, p, "authorization_id", ["max_altitude_ft"], pilot_ok=F.col("pilot_found"),
                                      present_cols=["pilot_present"])


def _waiver_patches(spark, sf_dir):
    p = fx.lineitem_pairs(spark, sf_dir)
    status = F.when(F.col("l_returnflag") == "R", "rescinded").when(F.col("l_returnflag") == "A", "approved")
    st = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit("2024-01-01 00:00:00")))
                             + (F.col("l_partkey") % 720) * 3600)
    return p.select(F.concat(F.lit("WV-"), F.col("l_orderkey").cast("string")).alias("target_id"),
                    F.col("l_linenumber").cast("long").alias("seq"), status.alias("status"),
                    F.when(F.col("l_linestatus") == "O", F.concat(F.lit("cond "), F.col("l_suppkey").cast("string")))
                     .alias("conditions"),
                    F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N"), st).alias("start_time"),
                    F.when((F.col("l_returnflag") == "N") & (F.col("l_partkey") % 3 == 0), F.timestamp_seconds(
                        F.unix_seconds(F.to_timestamp(F.lit("2024-01-01 00:00:00"))) + (F.col("l_suppkey") * 11 % 760) * 3600))
                     .alias("end_time"))


@query("waiver_lifecycle", with_fixtures("waivers", "lineitem_pairs").replace("WITH ", "WITH RECURSIVE ", 1) + """,
wp AS (SELECT 'WV-' || CAST(l_orderkey AS VARCHAR) AS target_id, CAST(l_linenumber AS BIGINT) AS seq,
              CASE l_returnflag WHEN 'R' THEN 'rescinded' WHEN 'A' THEN 'approved' END AS status,
              CASE WHEN l_linestatus = 'O' THEN 'cond ' || CAST(l_suppkey AS VARCHAR) END AS conditions,
              CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N'
                   THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(l_partkey % 720) END AS start_time,
              CASE WHEN l_returnflag = 'N' AND l_partkey % 3 = 0
                   THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(l_suppkey * 11 % 760) END AS end_time,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn
       FROM lineitem_pairs),
fold(target_id, rn, s, c, st, en, seq, outcome, status_after) AS (
  SELECT waiver_id, CAST(0 AS BIGINT), status, conditions, start_time, end_time, CAST(NULL AS BIGINT),
         CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM waivers
  UNION ALL
  SELECT target_id, prn,
         CASE WHEN oc = 'accepted' THEN coalesce(pstatus, s) ELSE s END,
         CASE WHEN oc = 'accepted' THEN coalesce(pc, c) ELSE c END,
         CASE WHEN oc = 'accepted' THEN coalesce(pst, st) ELSE st END,
         CASE WHEN oc = 'accepted' THEN coalesce(pen, en) ELSE en END,
         pseq, oc, CASE WHEN oc = 'accepted' THEN coalesce(pstatus, s) ELSE s END
  FROM (SELECT f.target_id, f.s, f.c, f.st, f.en, p.rn AS prn, p.seq AS pseq, p.status AS pstatus,
               p.conditions AS pc, p.start_time AS pst, p.end_time AS pen,
               CASE WHEN f.s = 'rescinded' THEN 'rescinded_terminal'
                    WHEN f.s = 'approved' AND NOT coalesce(p.status = 'rescinded' AND p.conditions IS NULL
                         AND p.start_time IS NULL AND p.end_time IS NULL, false) THEN 'approved_immutable'
                    WHEN coalesce(p.end_time, f.en) <= coalesce(p.start_time, f.st) THEN 'end_before_start'
                    ELSE 'accepted' END AS oc
        FROM fold f JOIN wp p ON p.target_id = f.target_id AND p.rn = f.rn + 1) x)
SELECT target_id, seq, outcome, status_after FROM fold WHERE seq IS NOT NULL""")
def q_waiver_lifecycle(spark, sf_dir):
    out = patches.lifecycle_fold(fx.waivers(spark, sf_dir), _waiver_patches(spark, sf_dir), "waiver_id",
                                 "conditions")
    return out.select("target_id", "seq", "outcome", "status_after")


@query("authorization_lifecycle_table", _judged("authorization_lifecycle") + f""",
k AS (SELECT p.target_id, arg_max(p.status, p.seq) FILTER (WHERE p.status IS NOT NULL) AS ns,
             arg_max(p.max_altitude_ft, p.seq) FILTER (WHERE p.max_altitude_ft IS NOT NULL) AS alt,
             arg_max(p.start_time, p.seq) FILTER (WHERE p.start_time IS NOT NULL) AS st,
             arg_max(p.end_time, p.seq) FILTER (WHERE p.end_time IS NOT NULL) AS en,
             max(p.seq) FILTER (WHERE p.pilot_present) AS ps,
             arg_max_null(p.pilot_id, p.seq) FILTER (WHERE p.pilot_present) AS pilot
      FROM p JOIN j ON j.target_id = p.target_id AND j.seq = p.seq WHERE j.outcome = 'accepted' GROUP BY 1)
SELECT a.authorization_id, coalesce(k.ns, a.status) AS status, coalesce(k.alt, a.max_altitude_ft) AS max_altitude_ft,
       CASE WHEN k.ps IS NOT NULL THEN k.pilot ELSE a.pilot_id END AS pilot_id,
       coalesce({iso('k.st')}, {iso('a.start_time')}) AS start_time, coalesce({iso('k.en')}, {iso('a.end_time')}) AS end_time,
       CASE WHEN k.ns = 'rescinded' AND a.status <> 'rescinded' THEN '{STAMP}.000000'
            WHEN a.status = 'rescinded' THEN {iso('a.start_time')} END AS rescinded_at,
       CASE WHEN k.target_id IS NOT NULL THEN '{STAMP}.000000' ELSE {iso('a.created_at')} END AS updated_at
FROM authorizations a LEFT JOIN k ON k.target_id = a.authorization_id""")
def q_authorization_lifecycle_table(spark, sf_dir):
    """The authorizations after their accepted patches."""
    out = patches.apply_accepted(fx.authorizations(spark, sf_dir), _auth_outcomes(spark, sf_dir), "authorization_id",
                                 ["status", "max_altitude_ft", "start_time", "end_time"], STAMP,
                                 cleared={"pilot_id": "pilot_present"})
    return out.select("authorization_id", "status", "max_altitude_ft", "pilot_id", "start_time", "end_time", "rescinded_at",
                      "updated_at")


@query("waiver_lifecycle_table", _judged("waiver_lifecycle") + f""",
k AS (SELECT p.target_id, arg_max(p.status, p.seq) FILTER (WHERE p.status IS NOT NULL) AS ns,
             arg_max(p.conditions, p.seq) FILTER (WHERE p.conditions IS NOT NULL) AS c,
             arg_max(p.start_time, p.seq) FILTER (WHERE p.start_time IS NOT NULL) AS st,
             arg_max(p.end_time, p.seq) FILTER (WHERE p.end_time IS NOT NULL) AS en
      FROM wp p JOIN j ON j.target_id = p.target_id AND j.seq = p.seq WHERE j.outcome = 'accepted' GROUP BY 1)
SELECT w.waiver_id, coalesce(k.ns, w.status) AS status, coalesce(k.c, w.conditions) AS conditions,
       coalesce({iso('k.st')}, {iso('w.start_time')}) AS start_time,
       coalesce({iso('k.en')}, {iso('w.end_time')}) AS end_time,
       CASE WHEN k.ns = 'rescinded' AND w.status <> 'rescinded' THEN '{STAMP}.000000'
            WHEN w.status = 'rescinded' THEN {iso('w.start_time')} END AS rescinded_at,
       CASE WHEN k.target_id IS NOT NULL THEN '{STAMP}.000000' ELSE {iso('w.created_at')} END AS updated_at
FROM waivers w LEFT JOIN k ON k.target_id = w.waiver_id""")
def q_waiver_lifecycle_table(spark, sf_dir):
    """The waivers after their accepted patches."""
    w, ps = fx.waivers(spark, sf_dir), _waiver_patches(spark, sf_dir)
    judged = patches.lifecycle_fold(w, ps, "waiver_id", "conditions").select("target_id", "seq", "outcome")
    out = patches.apply_accepted(w, ps.join(judged, ["target_id", "seq"]), "waiver_id",
                                 ["status", "conditions", "start_time", "end_time"], STAMP)
    return out.select("waiver_id", "status", "conditions", "start_time", "end_time", "rescinded_at", "updated_at")


def _profiles(spark, sf_dir):
    p = fx.sensor_profiles_raw(spark, sf_dir)
    return p.select("sensor_id", "profile_json", "created_at", F.col("created_at").alias("updated_at"))


@query("profile_upsert", with_fixtures("sensor_profiles", "sensors", "lineitem_pairs") + f""",
old AS (SELECT sensor_id, created_at FROM sensor_profiles),
u AS (SELECT 'S-' || CAST(l_suppkey + CASE WHEN l_partkey % 11 = 0 THEN 200000 ELSE 0 END AS VARCHAR) AS sensor_id,
             l_orderkey * 1024 + l_linenumber AS seq,
             '{{"pollIntervalMs":{{"min":' || CAST(1000 + l_partkey AS VARCHAR) || ',"max":9000}}}}' AS profile_json
      FROM lineitem_pairs),
last AS (SELECT sensor_id, arg_max(profile_json, seq) AS pj FROM u
         WHERE sensor_id IN (SELECT sensor_id FROM sensors) GROUP BY sensor_id)
SELECT coalesce(o.sensor_id, l.sensor_id) AS sensor_id,
       CASE WHEN l.pj IS NOT NULL THEN l.pj ELSE
         (SELECT '{{"pollIntervalMs":{{"min":' || CAST(poll_min AS VARCHAR) || ',"max":5000}},"latencyMs":{{"min":200,"max":'
                 || CAST(latency_max AS VARCHAR) || '}},"label":"' || label || '"}}'
          FROM sensor_profiles sp WHERE sp.sensor_id = o.sensor_id) END AS profile_json,
       coalesce({iso('o.created_at')}, '{STAMP}.000000') AS created_at, 'profile' AS kind
FROM old o FULL OUTER JOIN last l ON l.sensor_id = o.sensor_id
UNION ALL
SELECT sensor_id, profile_json, NULL, 'unknown_sensor' FROM u WHERE sensor_id NOT IN (SELECT sensor_id FROM sensors)""")
def q_profile_upsert(spark, sf_dir):
    """Every order line upserts the profile of sensor ``l_suppkey`` (every 11th part that of
    an unknown sensor); the last write wins, unknown sensors are refused."""
    p = fx.lineitem_pairs(spark, sf_dir)
    ups = p.select(F.concat(F.lit("S-"), (F.col("l_suppkey") + F.when(F.col("l_partkey") % 11 == 0, 200000).otherwise(0))
                            .cast("string")).alias("sensor_id"),
                   (F.col("l_orderkey") * 1024 + F.col("l_linenumber")).alias("seq"),
                   F.concat(F.lit('{"pollIntervalMs":{"min":'), (F.lit(1000) + F.col("l_partkey")).cast("string"),
                            F.lit(',"max":9000}}')).alias("profile_json"))
    out, refused = patches.profile_upsert(_profiles(spark, sf_dir), fx.sensors(spark, sf_dir), ups, STAMP)
    return (out.select("sensor_id", "profile_json", "created_at", F.lit("profile").alias("kind"))
            .unionByName(refused.select("sensor_id", "profile_json", F.lit(None).cast("timestamp").alias("created_at"),
                                        F.col("reason").alias("kind"))))


@query("delete_reporting", with_fixtures("pilots") + """,
d AS (SELECT 'P-' || CAST(c_custkey AS VARCHAR) AS pilot_id,
             'O-' || CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 1000 ELSE c_custkey END AS VARCHAR) AS owner_id
      FROM customer)
SELECT 'delete' AS kind, d.pilot_id, d.owner_id, EXISTS (SELECT 1 FROM pilots p WHERE p.pilot_id = d.pilot_id
                                       AND p.organization_owner_id = d.owner_id) AS done FROM d
UNION ALL SELECT 'remaining', pilot_id, organization_owner_id, false FROM pilots p
WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.pilot_id = p.pilot_id AND d.owner_id = p.organization_owner_id)""")
def q_delete_reporting(spark, sf_dir):
    """A delete per customer; even keys name the right owner, odd keys another one."""
    c = fx.load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    d = c.select(F.concat(F.lit("P-"), k.cast("string")).alias("pilot_id"),
                 F.concat(F.lit("O-"), F.when(k % 2 == 0, k % 1000).otherwise(k).cast("string")).alias("owner_id"))
    left, report = patches.delete_reporting(fx.pilots(spark, sf_dir), d)
    return (report.select(F.lit("delete").alias("kind"), "pilot_id", "owner_id", F.col("deleted").alias("done"))
            .unionByName(left.select(F.lit("remaining").alias("kind"), "pilot_id",
                                     F.col("organization_owner_id").alias("owner_id"), F.lit(False).alias("done"))))


@query("delete_idempotent", with_fixtures("sensor_profiles") + """
SELECT sensor_id FROM sensor_profiles WHERE sensor_id NOT IN
  (SELECT 'S-' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 2 = 0
   UNION ALL SELECT 'S-' || CAST(s_suppkey + 100000 AS VARCHAR) FROM supplier)""")
def q_delete_idempotent(spark, sf_dir):
    """Delete the profiles of even suppliers plus ids that never existed; absent is fine."""
    s = fx.load(spark, sf_dir, "supplier")
    d = (s.filter(F.col("s_suppkey") % 2 == 0).select(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string"))
                                                       .alias("sensor_id"))
         .union(s.select(F.concat(F.lit("S-"), (F.col("s_suppkey") + 100000).cast("string")).alias("sensor_id"))))
    return patches.delete_idempotent(_profiles(spark, sf_dir), d).select("sensor_id")


# ============================================================ listings F2-F8, F10-F12, P6, T6, G1, G2, M24

@query("list_authorizations", with_fixtures("authorizations") + f"""
SELECT authorization_id, status, {iso('created_at')} AS created_at FROM authorizations
WHERE status = 'approved' AND start_time <= TIMESTAMP '2024-01-20 12:00:00'
  AND end_time >= TIMESTAMP '2024-01-20 12:00:00'""")
def q_list_authorizations(spark, sf_dir):
    out = listings.list_authorizations(fx.authorizations(spark, sf_dir), status="approved",
                                       active="2024-01-20 12:00:00")
    return out.select("authorization_id", "status", "created_at")


@query("list_flight_plans", with_fixtures("flight_plans", "waypoints") + """
SELECT f.flight_plan_id, f.plan_type,
       (SELECT count(*) FROM waypoints w WHERE w.flight_plan_id = f.flight_plan_id) AS n_waypoints,
       coalesce((SELECT string_agg(CAST(w.radius_meters AS BIGINT)::VARCHAR, ','
            ORDER BY w.sequence_number) FROM waypoints w WHERE w.flight_plan_id = f.flight_plan_id), '') AS radii
FROM flight_plans f WHERE f.start_time <= TIMESTAMP '2024-01-20 12:00:00' AND f.end_time >= TIMESTAMP '2024-01-20 12:00:00'""")
def q_list_flight_plans(spark, sf_dir):
    out = listings.list_flight_plans(fx.flight_plans(spark, sf_dir), fx.waypoints(spark, sf_dir),
                                     active="2024-01-20 12:00:00")
    return out.select("flight_plan_id", "plan_type", F.size("waypoints").alias("n_waypoints"),
                      F.array_join(F.transform("waypoints", lambda w: w["radiusMeters"].cast("bigint").cast("string")),
                                   ",").alias("radii")).withColumn("n_waypoints", F.col("n_waypoints").cast("long"))


@query("list_waivers", with_fixtures("waivers") + """
SELECT waiver_id, waiver_type, pilot_id, owner_id FROM waivers WHERE waiver_type = 'night_operations'""")
def q_list_waivers(spark, sf_dir):
    return listings.list_waivers(fx.waivers(spark, sf_dir), waiver_type="night_operations").select(
        "waiver_id", "waiver_type", "pilot_id", "owner_id")


@query("join_waivers_active", with_fixtures("waivers", "live_positions") + """,
probes AS (SELECT report_id AS probe_id, 'P-' || CAST(event_id % 1500 - event_id % 1500 % 3 AS VARCHAR) AS pilot_id,
                  'O-' || CAST(event_id % 1500 AS VARCHAR) AS owner_id, recorded_at AS at FROM live_positions)
SELECT p.probe_id, w.waiver_id FROM probes p JOIN waivers w ON w.pilot_id = p.pilot_id
  AND w.start_time <= p.at AND w.end_time >= p.at
UNION ALL
SELECT p.probe_id, w.waiver_id FROM probes p JOIN waivers w ON w.owner_id = p.owner_id
  AND w.start_time <= p.at AND w.end_time >= p.at""")
def q_join_waivers_active(spark, sf_dir):
    """Each position asks for the waivers of a pilot and an owner active at its instant."""
    e = fx.live_positions(spark, sf_dir).withColumn("_k", F.expr("cast(substring(report_id, 3) as bigint)") % 1500)
    probes = e.select(F.col("report_id").alias("probe_id"),
                      F.concat(F.lit("P-"), (F.col("_k") - F.col("_k") % 3).cast("string")).alias("pilot_id"),
                      F.concat(F.lit("O-"), F.col("_k").cast("string")).alias("owner_id"),
                      F.col("recorded_at").alias("at"))
    out = listings.join_waivers_active(probes, fx.waivers(spark, sf_dir))
    return out.select("probe_id", F.col("w_waiver_id").alias("waiver_id"))


@query("list_owners", with_fixtures("owners") + f"""
SELECT owner_id, owner_type, company_name, {iso('created_at')} AS created_at FROM owners""")
def q_list_owners(spark, sf_dir):
    return listings.list_by_created(fx.owners(spark, sf_dir), "owner_id").select(
        "owner_id", "owner_type", "company_name", "created_at")


@query("list_sensors", with_fixtures("sensors") + f"""
SELECT sensor_id, status, notes, {iso('created_at')} AS created_at FROM sensors""")
def q_list_sensors(spark, sf_dir):
    return listings.list_by_created(fx.sensors(spark, sf_dir), "sensor_id").select(
        "sensor_id", "status", "notes", "created_at")


@query("limit_n", with_fixtures("owners") + f"""
SELECT owner_id, {iso('created_at')} AS created_at FROM owners ORDER BY created_at, owner_id LIMIT 100""")
def q_limit_n(spark, sf_dir):
    """The oldest 100 owners (a top-k report: the limit is the feature)."""
    from ..operators.asof import limit_n
    return limit_n(fx.owners(spark, sf_dir), ["created_at", "owner_id"], 100).select("owner_id", "created_at")


@query("list_pilots_for_owner", with_fixtures("owners", "pilots") + """,
probes AS (SELECT DISTINCT 'O-' || CAST(c_custkey % 1200 AS VARCHAR) AS owner_id FROM customer)
SELECT p.owner_id, o.owner_id IS NOT NULL AS owner_found, x.pilot_id
FROM probes p LEFT JOIN owners o ON o.owner_id = p.owner_id
LEFT JOIN pilots x ON o.owner_id IS NOT NULL AND x.organization_owner_id = p.owner_id""")
def q_list_pilots_for_owner(spark, sf_dir):
    c = fx.load(spark, sf_dir, "customer")
    probes = c.select(F.concat(F.lit("O-"), (F.col("c_custkey") % 1200).cast("string")).alias("owner_id")).distinct()
    out = listings.list_pilots_for_owner(fx.owners(spark, sf_dir), fx.pilots(spark, sf_dir), probes)
    return out.select("owner_id", "owner_found", "pilot_id")


@query("lookup_by_key", with_fixtures("pilots") + """,
k AS (SELECT 'P-' || CAST(o_custkey AS VARCHAR) AS pilot_id, 'O-' || CAST(o_custkey % 1000 AS VARCHAR) AS owner_id,
             o_orderkey FROM orders)
SELECT k.o_orderkey, k.pilot_id, p.pilot_id IS NOT NULL AS found, p.name
FROM k LEFT JOIN pilots p ON p.pilot_id = k.pilot_id AND p.organization_owner_id = k.owner_id""")
def q_lookup_by_key(spark, sf_dir):
    """F8 (pilot scoped under an owner): one lookup per order."""
    o = fx.load(spark, sf_dir, "orders")
    keys = o.select("o_orderkey", F.concat(F.lit("P-"), F.col("o_custkey").cast("string")).alias("pilot_id"),
                    F.concat(F.lit("O-"), (F.col("o_custkey") % 1000).cast("string")).alias("owner_id"))
    out = listings.lookup_by_key(fx.pilots(spark, sf_dir), keys, "pilot_id",
                                 scope=("owner_id", "organization_owner_id"))
    return out.select("o_orderkey", "pilot_id", "found", F.col("t_name").alias("name"))


@query("history_live", with_fixtures("live_positions") + f"""
SELECT drone_serial_number, report_id, {iso('recorded_at')} AS recorded_at FROM (
  SELECT *, row_number() OVER (PARTITION BY drone_serial_number ORDER BY recorded_at, report_id) rn
  FROM live_positions WHERE recorded_at >= TIMESTAMP '2024-01-05 00:00:00'
    AND recorded_at <= TIMESTAMP '2024-01-25 00:00:00') WHERE rn <= 20""")
def q_history_live(spark, sf_dir):
    """F10 for every drone: from/to inclusive, the oldest 20 per drone."""
    out = listings.history(fx.live_positions(spark, sf_dir), "drone_serial_number",
                           keys=fx.live_positions(spark, sf_dir).select("drone_serial_number"),
                           from_ts="2024-01-05 00:00:00", to_ts="2024-01-25 00:00:00", limit=20)
    return out.select("drone_serial_number", "report_id", "recorded_at")


@query("history_sensor", with_fixtures("sensor_positions") + f"""
SELECT drone_serial_number, report_id, sensor_id, {iso('recorded_at')} AS recorded_at
FROM sensor_positions WHERE recorded_at >= TIMESTAMP '2024-01-10 00:00:00'
  AND recorded_at <= TIMESTAMP '2024-01-12 00:00:00'""")
def q_history_sensor(spark, sf_dir):
    """all sensors' reports of every drone in a range, no limit."""
    sp = fx.sensor_positions(spark, sf_dir)
    out = listings.history(sp, "drone_serial_number", keys=sp.select("drone_serial_number"),
                           from_ts="2024-01-10 00:00:00", to_ts="2024-01-12 00:00:00")
    return out.select("drone_serial_number", "report_id", "sensor_id", "recorded_at")


@query("history_zone", with_fixtures("zone_reports") + f"""
SELECT zone_id, kind, report_id, {iso('recorded_at')} AS recorded_at FROM (
  SELECT *, row_number() OVER (PARTITION BY zone_id, kind ORDER BY recorded_at, report_id) rn
  FROM zone_reports WHERE recorded_at >= TIMESTAMP '2024-01-10 00:00:00') WHERE rn <= 50""")
def q_history_zone(spark, sf_dir):
    """per zone and kind, the oldest 50 reports from Jan 10 on."""
    z = fx.zone_reports(spark, sf_dir).withColumn("zk", F.concat_ws("/", "zone_id", "kind"))
    out = listings.history(z, "zk", keys=z.select("zk"), from_ts="2024-01-10 00:00:00", limit=50)
    return out.select("zone_id", "kind", "report_id", "recorded_at")


@query("nest_waypoints", with_fixtures("waypoints") + """
SELECT flight_plan_id, count(*) AS n_waypoints,
       string_agg(CAST(CAST(altitude_min_ft AS BIGINT) AS VARCHAR), ',' ORDER BY sequence_number) AS floors
FROM waypoints GROUP BY flight_plan_id""")
def q_nest_waypoints(spark, sf_dir):
    out = listings.nest_waypoints(fx.waypoints(spark, sf_dir))
    return out.select("flight_plan_id", F.size("waypoints").cast("long").alias("n_waypoints"),
                      F.array_join(F.transform("waypoints", lambda w: w["altitudeMinFt"].cast("bigint").cast("string")),
                                   ",").alias("floors"))


@query("plan_explode_waypoints", with_fixtures("waypoints") + """
SELECT flight_plan_id, sequence_number, lat AS latitude, lon AS longitude FROM waypoints""")
def q_plan_explode_waypoints(spark, sf_dir):
    """Nested plan bodies back to ordered child rows (round trip through G1)."""
    nested = listings.nest_waypoints(fx.waypoints(spark, sf_dir))
    out = listings.explode_plan_waypoints(nested)
    return out.select("flight_plan_id", "sequence_number", "latitude", "longitude")


@query("union_plan_shapes", with_fixtures("flight_plans") + f"""
SELECT flight_plan_id, plan_type, {iso('created_at')} AS created_at FROM flight_plans""")
def q_union_plan_shapes(spark, sf_dir):
    """Polygon plans and waypoint plans concatenated and ordered by creation."""
    fp = fx.flight_plans(spark, sf_dir).select("flight_plan_id", "plan_type", "created_at")
    return listings.union_plan_shapes(fp.filter(F.col("plan_type") == "polygon"),
                                      fp.filter(F.col("plan_type") == "waypoints"))


@query("in_list", with_fixtures("waypoints", "flight_plans") + """
SELECT w.flight_plan_id, w.sequence_number FROM waypoints w
WHERE w.flight_plan_id IN (SELECT flight_plan_id FROM flight_plans WHERE airspace_authorization_id IS NOT NULL)""")
def q_in_list(spark, sf_dir):
    """Waypoints of the plans linked to an authorization (``= ANY`` as a semi-join)."""
    fp = fx.flight_plans(spark, sf_dir).filter(F.col("airspace_authorization_id").isNotNull())
    return listings.in_list(fx.waypoints(spark, sf_dir), "flight_plan_id", fp, "flight_plan_id").select(
        "flight_plan_id", "sequence_number")


def _plan_patches(spark, sf_dir):
    """Patches per return flag: R clears the pilot, links an authorization and, on even lines,
    moves the start; A links a registration; N sets the pilot and the end, clears the registration."""
    p = fx.lineitem_pairs(spark, sf_dir, ("target_id", "concat('FP-', CAST(l_orderkey AS STRING))"))
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")

    def day(n):
        at = (F.when(ln % 4 == 1, "T00:00Z").when(ln % 4 == 3, "T00:00:00.123456789Z").otherwise("T00:00:00Z"))
        return F.concat(F.lit('"2024-01-'), F.lpad((ln % 7 + n).cast("string"), 2, "0"), at, F.lit('"'))
    raw = (F.when(F.col("l_returnflag") == "R",
                  F.concat(F.lit('{"pilotId":null,"airspaceAuthorizationId":"'),
                           F.when(ln == 3, F.lit("A-X")).otherwise(F.lit("A-")), pk.cast("string"), F.lit('"'),
                           F.when(ln % 2 == 0, F.concat(F.lit(',"startTime":'), day(10))).otherwise(F.lit("")), F.lit("}")))
            .when(F.col("l_returnflag") == "A",
                  F.concat(F.lit('{"registrationId":"R-'), (sk * 7).cast("string"), F.lit('"}')))
            .otherwise(F.concat(F.lit('{"pilotId":"P-'), (pk - pk % 3).cast("string"),
                                F.lit('","registrationId":null,"endTime":'), day(13), F.lit("}"))))
    return p.select("target_id", ln.cast("long").alias("seq"), raw.alias("raw"))


_PLAN_FOLD = with_fixtures("flight_plans", "pilots", "registrations", "authorizations",
                          "lineitem_pairs").replace("WITH ", "WITH RECURSIVE ", 1) + """,
p AS (SELECT 'FP-' || CAST(l_orderkey AS VARCHAR) AS target_id, CAST(l_linenumber AS BIGINT) AS seq, l_returnflag AS fl,
             l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln FROM lineitem_pairs),
v AS (SELECT p.*, f.flight_plan_id IS NOT NULL AS found, f.owner_id,
        CASE WHEN fl = 'N' THEN 'P-' || CAST(pk - pk % 3 AS VARCHAR) END AS set_pilot,
        CASE WHEN fl = 'A' THEN 'R-' || CAST(sk * 7 AS VARCHAR) END AS set_reg,
        CASE WHEN fl = 'R' THEN (CASE WHEN ln = 3 THEN 'A-X' ELSE 'A-' END) || CAST(pk AS VARCHAR) END AS set_auth,
        CASE WHEN fl = 'R' AND ln % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(ln % 7 + 9)
             + to_microseconds(CASE WHEN ln % 4 = 3 THEN 123456 ELSE 0 END) END AS set_start,
        CASE WHEN fl = 'N' THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(ln % 7 + 12)
             + to_microseconds(CASE WHEN ln % 4 = 3 THEN 123456 ELSE 0 END) END AS set_end
      FROM p LEFT JOIN flight_plans f ON f.flight_plan_id = p.target_id),
c AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY seq) AS rn,
  CASE WHEN NOT found THEN 'not_found'
       WHEN set_pilot IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pilots x WHERE x.pilot_id = set_pilot
            AND x.organization_owner_id = v.owner_id) THEN 'pilot_not_found'
       WHEN set_reg IS NOT NULL AND set_reg NOT IN (SELECT registration_id FROM registrations)
            THEN 'registration_not_found'
       WHEN set_reg IS NOT NULL AND (SELECT r.owner_id FROM registrations r WHERE r.registration_id = set_reg)
            <> v.owner_id THEN 'registration_owner_mismatch' END AS before,
  set_auth IS NOT NULL AND set_auth NOT IN (SELECT authorization_id FROM authorizations) AS no_auth FROM v),
fold(target_id, rn, st, en, seq, outcome) AS (
  SELECT flight_plan_id, CAST(0 AS BIGINT), start_time, end_time, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM flight_plans
  UNION ALL
  SELECT target_id, rn, CASE WHEN oc = 'accepted' THEN coalesce(set_start, st) ELSE st END,
         CASE WHEN oc = 'accepted' THEN coalesce(set_end, en) ELSE en END, seq, oc
  FROM (SELECT f.target_id, c.rn, f.st, f.en, c.set_start, c.set_end, c.seq,
          CASE WHEN c.before IS NOT NULL THEN c.before
               WHEN coalesce(c.set_end, f.en) <= coalesce(c.set_start, f.st) THEN 'end_before_start'
               WHEN c.no_auth THEN 'authorization_not_found' ELSE 'accepted' END AS oc
        FROM fold f JOIN c ON c.target_id = f.target_id AND c.rn = f.rn + 1) x),
j AS (SELECT target_id, seq, outcome FROM fold WHERE seq IS NOT NULL
      UNION ALL SELECT target_id, seq, before FROM c WHERE NOT found)
"""


@query("flight_plan_patch", _PLAN_FOLD + "SELECT target_id, seq, outcome FROM j")
def q_flight_plan_patch(spark, sf_dir):
    """A link/window patch per order line, those of a plan in order."""
    return _plan_outcomes(spark, sf_dir).select("target_id", "seq", "outcome")


def _plan_outcomes(spark, sf_dir):
    return patches.flight_plan_patch(fx.flight_plans(spark, sf_dir), _plan_patches(spark, sf_dir),
                                     fx.pilots(spark, sf_dir), fx.registrations(spark, sf_dir),
                                     fx.authorizations(spark, sf_dir), keep=["target_id", "seq"])


@query("flight_plan_patch_table", _PLAN_FOLD + f""",
k AS (SELECT c.target_id, count(*) AS n,
        max(c.seq) FILTER (WHERE c.fl IN ('R', 'N')) AS ps, arg_max_null(c.set_pilot, c.seq) FILTER (WHERE c.fl IN ('R', 'N')) AS pilot,
        max(c.seq) FILTER (WHERE c.fl IN ('A', 'N')) AS rs, arg_max_null(c.set_reg, c.seq) FILTER (WHERE c.fl IN ('A', 'N')) AS reg,
        arg_max(c.set_auth, c.seq) FILTER (WHERE c.set_auth IS NOT NULL) AS auth,
        arg_max(c.set_start, c.seq) FILTER (WHERE c.set_start IS NOT NULL) AS st,
        arg_max(c.set_end, c.seq) FILTER (WHERE c.set_end IS NOT NULL) AS en
      FROM c JOIN j ON j.target_id = c.target_id AND j.seq = c.seq WHERE j.outcome = 'accepted' GROUP BY 1)
SELECT f.flight_plan_id, CASE WHEN k.ps IS NOT NULL THEN k.pilot ELSE f.pilot_id END AS pilot_id,
       CASE WHEN k.rs IS NOT NULL THEN k.reg ELSE f.registration_id END AS registration_id,
       coalesce(k.auth, f.airspace_authorization_id) AS airspace_authorization_id,
       coalesce({iso('k.st')}, {iso('f.start_time')}) AS start_time, coalesce({iso('k.en')}, {iso('f.end_time')}) AS end_time,
       CASE WHEN k.n > 0 THEN '{STAMP}.000000' ELSE {iso('f.created_at')} END AS updated_at
FROM flight_plans f LEFT JOIN k ON k.target_id = f.flight_plan_id""")
def q_flight_plan_patch_table(spark, sf_dir):
    """The plans after their accepted patches."""
    out = patches.apply_accepted(
        fx.flight_plans(spark, sf_dir), _plan_outcomes(spark, sf_dir), "flight_plan_id", ["start_time", "end_time"], STAMP,
        cleared={"pilot_id": "has_pilot", "registration_id": "has_registration",
                 "airspace_authorization_id": "has_authorization"})
    return out.select("flight_plan_id", "pilot_id", "registration_id", "airspace_authorization_id", "start_time",
                      "end_time", "updated_at")
