"""Filters, listings, key lookups and history ranges.

Optional filters are added to the plan only when given (the reference's
``param IS NULL OR col = param``), so Catalyst pushes each one to the scan.
Lookups take a DataFrame of keys and return a ``found`` flag per key: the bulk
form of a 404.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import WINDOW_BUCKET_US, with_instants, with_windows


def _ts(x: str) -> Column:
    return F.to_timestamp(F.lit(x))


def active_at(start_col: str, end_col: str, at) -> Column:
    """closed containment ``start <= at <= end`` (instants or dates)."""
    a = _ts(at) if isinstance(at, str) else at
    return (F.col(start_col) <= a) & (F.col(end_col) >= a)


def _eq_filters(df: DataFrame, **eq) -> DataFrame:
    for c, v in eq.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df


def list_authorizations(auths: DataFrame, owner_id=None, pilot_id=None, status=None, active=None) -> DataFrame:
    """owner, pilot, status and activeAt filters; oldest first."""
    df = _eq_filters(auths, owner_id=owner_id, pilot_id=pilot_id, status=status)
    if active is not None:
        df = df.filter(active_at("start_time", "end_time", active))
    return df.orderBy("created_at", "authorization_id")


def nest_waypoints(waypoints: DataFrame) -> DataFrame:
    """G1: one row per plan with its waypoints ordered by sequence number (seq dropped)."""
    g = waypoints.groupBy("flight_plan_id").agg(F.array_sort(F.collect_list(F.struct(
        "sequence_number", "lat", "lon", "altitude_min_ft", "altitude_max_ft", "radius_meters"))).alias("_w"))
    return g.select("flight_plan_id", F.transform("_w", lambda w: F.struct(
        w["lat"].alias("latitude"), w["lon"].alias("longitude"), w["altitude_min_ft"].alias("altitudeMinFt"),
        w["altitude_max_ft"].alias("altitudeMaxFt"), w["radius_meters"].alias("radiusMeters"))).alias("waypoints"))


def list_flight_plans(plans: DataFrame, waypoints: DataFrame, owner_id=None, registration_id=None,
                      pilot_id=None, airspace_authorization_id=None, active=None) -> DataFrame:
    """filters as F2; waypoints nested (G1) by one grouped join, not one lookup per plan."""
    df = _eq_filters(plans, owner_id=owner_id, registration_id=registration_id, pilot_id=pilot_id,
                     airspace_authorization_id=airspace_authorization_id)
    if active is not None:
        df = df.filter(active_at("start_time", "end_time", active))
    nested = nest_waypoints(waypoints.join(df.select("flight_plan_id"), "flight_plan_id", "left_semi"))
    out = df.join(nested, "flight_plan_id", "left")
    # a polygon plan (or a waypoint plan without rows) lists no waypoints: an empty array
    out = out.withColumn("waypoints", F.coalesce(F.col("waypoints"), F.array().cast(nested.schema["waypoints"].dataType)))
    return out.orderBy("created_at", "flight_plan_id")


def list_waivers(waivers: DataFrame, pilot_id=None, owner_id=None, waiver_type=None, status=None,
                 active=None) -> DataFrame:
    """pilot, owner, type, status, activeAt (no default instant)."""
    df = _eq_filters(waivers, pilot_id=pilot_id, owner_id=owner_id, waiver_type=waiver_type, status=status)
    if active is not None:
        df = df.filter(active_at("start_time", "end_time", active))
    return df.orderBy("created_at", "waiver_id")


def join_waivers_active(probes: DataFrame, waivers: DataFrame, at_col: str = "at") -> DataFrame:
    """Per (pilot_id, owner_id, at) probe, waivers of that pilot or that owner active at ``at``.

    Two equi-joins, on (pilot, time bucket) and (owner, time bucket), unioned: a pilot or owner
    with very many waivers meets only those of about the probe's time.
    """
    w = waivers.select(*[F.col(c).alias("w_" + c) for c in waivers.columns]).filter("w_start_time <= w_end_time")
    us = F.unix_micros
    timed, levels = with_windows(w, us("w_start_time"), us("w_end_time"), WINDOW_BUCKET_US, w)
    asked = with_instants(probes, us(F.col(at_col)), levels, WINDOW_BUCKET_US)
    rng = (F.col("w_start_time") <= F.col(at_col)) & (F.col("w_end_time") >= F.col(at_col))
    out = []
    for who in ("pilot_id", "owner_id"):
        side = timed.filter(F.col("w_" + who).isNotNull()).withColumn(who, F.col("w_" + who))
        out.append(asked.filter(F.col(who).isNotNull()).join(side, [who, "g_tl", "g_tb"]).filter(rng)
                   .select(*probes.columns, *w.columns))
    return out[0].unionByName(out[1])


def list_by_created(df: DataFrame, id_col: str) -> DataFrame:
    """all rows, oldest first (owners, sensors)."""
    return df.orderBy("created_at", id_col)


def list_pilots_for_owner(owners: DataFrame, pilots: DataFrame, owner_probes: DataFrame) -> DataFrame:
    """pilots of each probed owner by created_at; ``owner_found`` tells unknown from none."""
    o = owner_probes.join(owners.select(F.col("owner_id").alias("_oid")).distinct(),
                          F.col("owner_id") == F.col("_oid"), "left")
    o = o.withColumn("owner_found", F.col("_oid").isNotNull()).drop("_oid")
    p = pilots.select(F.col("organization_owner_id").alias("_po"), "pilot_id", "name", "created_at")
    return o.join(p, F.col("owner_found") & (F.col("owner_id") == F.col("_po")), "left").drop("_po")


def lookup_by_key(table: DataFrame, keys: DataFrame, key: str, scope: tuple[str, str] | None = None) -> DataFrame:
    """F8: get by id for a DataFrame of keys; ``found`` is the 404 analogue.

    ``scope`` = (key column in ``keys``, column in ``table``) restricts the match, e.g. a pilot
    looked up under an owner: a pilot under another owner is not found.
    """
    t = table.select(*[F.col(c).alias("t_" + c) for c in table.columns])
    cond = F.col(key) == F.col("t_" + key)
    if scope is not None:
        cond = cond & (F.col(scope[0]) == F.col("t_" + scope[1]))
    out = keys.join(t, cond, "left")
    return out.withColumn("found", F.col("t_" + key).isNotNull())


def history(reports: DataFrame, key_col: str, keys: DataFrame | None = None, key: str | None = None,
            from_ts: str | None = None, to_ts: str | None = None, limit: int | None = None,
            at: str | None = None) -> DataFrame:
    """reports of one key (``key``) or of many keys (``keys`` DataFrame),
    ``from``/``to`` both inclusive, ascending; ``limit`` keeps the oldest n per key. ``at``
    overrides all three: the newest report per key at or before it, however old.

    Many keys: ``row_number() <= limit`` per key (partial WindowGroupLimit).
    """
    r = reports
    if at is not None:
        r = r.filter(F.col("recorded_at") <= _ts(at))
        r = r.filter(F.col(key_col) == key) if key is not None else r
        r = r.join(keys.select(key_col).distinct(), key_col, "left_semi") if keys is not None else r
        w = Window.partitionBy(key_col).orderBy(F.col("recorded_at").desc(), "report_id")
        return r.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    if from_ts is not None:
        r = r.filter(F.col("recorded_at") >= _ts(from_ts))
    if to_ts is not None:
        r = r.filter(F.col("recorded_at") <= _ts(to_ts))
    if key is not None:
        r = r.filter(F.col(key_col) == key)
    if keys is not None:
        r = r.join(keys.select(key_col).distinct(), key_col, "left_semi")
    if limit is None:
        return r.orderBy("recorded_at", "report_id")
    if key is not None:
        return r.orderBy("recorded_at", "report_id").limit(int(limit))
    w = Window.partitionBy(key_col).orderBy("recorded_at", "report_id")
    return r.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def union_plan_shapes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concatenate two result sets and sort by created_at, id."""
    return a.unionByName(b, allowMissingColumns=True).orderBy("created_at", "flight_plan_id")


def in_list(df: DataFrame, col: str, values: DataFrame, values_col: str) -> DataFrame:
    """``col = ANY(values)`` as a semi-join."""
    return df.join(values.select(F.col(values_col).alias(col)).distinct(), col, "left_semi")


def explode_plan_waypoints(plans_raw: DataFrame, waypoints_col: str = "waypoints") -> DataFrame:
    """Plan header rows to ordered child rows, ``sequence_number`` from 0."""
    return plans_raw.select("flight_plan_id", F.posexplode(waypoints_col).alias("sequence_number", "_w")) \
                    .select("flight_plan_id", F.col("sequence_number").cast("int"), "_w.*")
