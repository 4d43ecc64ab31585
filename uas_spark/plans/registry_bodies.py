"""Registered body sources (S5, S6): every body type written as JSON lines and read from the files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..sources import json_sources as js
from .oracle_fixtures import iso, with_fixtures
from .registry import query


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def _through_files(rows: DataFrame, schema: str) -> DataFrame:
    """One JSON body per row and line (absent when null), read back with the body's schema."""
    path = f"{ensure_checkpoint_dir(rows.sparkSession).rstrip('/')}/bodies/{uuid.uuid4().hex}"
    rows.select(F.to_json(F.struct(*[F.col(c).alias(_camel(c)) for c in rows.columns]))).write.text(path)
    read = js.read_bodies(rows.sparkSession, path, schema)
    return read.select(*[F.col(_camel(c)).alias(c) for c in rows.columns])


_OWNER = ["owner_id", "owner_type", "company_name", "first_name", "last_name", "phone_number", "address_line1",
          "address_line2", "address_city", "address_state", "address_zip", "email"]


@query("src_registry", with_fixtures("owners") + f"""
SELECT {", ".join(_OWNER)} FROM owners""")
def q_src_registry(spark, sf_dir):
    """Owner bodies, all fields."""
    return _through_files(fx.owners(spark, sf_dir).select(*_OWNER), js.OWNER_BODY)


@query("src_pilots", with_fixtures("pilots") + """
SELECT pilot_id, name, phone_number, license_number FROM pilots""")
def q_src_pilots(spark, sf_dir):
    """Pilot bodies."""
    return _through_files(fx.pilots(spark, sf_dir).select("pilot_id", "name", "phone_number", "license_number"),
                          js.PILOT_BODY)


@query("src_registrations", with_fixtures("registrations") + """
SELECT registration_id, serial_number, owner_id, CAST(start_date AS VARCHAR) AS start_date,
       CAST(end_date AS VARCHAR) AS end_date FROM registrations""")
def q_src_registrations(spark, sf_dir):
    """Registration bodies; dates are ISO text."""
    out = _through_files(fx.registrations(spark, sf_dir).select(
        "registration_id", "serial_number", "make", "model_number", "owner_id", "start_date", "end_date"),
        js.REGISTRATION_BODY)
    return out.select("registration_id", "serial_number", "owner_id", F.col("start_date").cast("string"),
                      F.col("end_date").cast("string"))


_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


@query("src_airspace_authorizations", with_fixtures("authorizations") + f"""
SELECT authorization_id, owner_id, pilot_id, max_altitude_ft, {iso('start_time')} AS start_time,
       {iso('end_time')} AS end_time, cx - h AS first_lon, cy - h AS first_lat,
       CAST(CASE shape WHEN 'tri' THEN 4 ELSE 5 END AS BIGINT) AS n_vertices FROM authorizations""")
def q_src_airspace_authorizations(spark, sf_dir):
    """Authorization bodies; the area is a GeoJSON object inside the body."""
    a = fx.authorizations(spark, sf_dir)
    # the area goes in as an object, as clients send it
    body = F.concat(F.regexp_replace(F.to_json(F.struct(
        F.col("authorization_id").alias("authorizationId"), F.col("owner_id").alias("ownerId"),
        F.col("pilot_id").alias("pilotId"), F.col("max_altitude_ft").alias("maxAltitudeFt"),
        F.date_format("start_time", _ISO).alias("startTime"), F.date_format("end_time", _ISO).alias("endTime"))),
        "[}]$", ""), F.lit(',"area":'), js.geojson_encode(F.col("area")), F.lit("}"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bodies/{uuid.uuid4().hex}"
    a.select(body).write.text(path)
    r = js.read_bodies(spark, path, js.AUTH_BODY).withColumn("rings", js.geojson_decode(F.col("area")))
    return r.select(F.col("authorizationId").alias("authorization_id"), F.col("ownerId").alias("owner_id"),
                    F.col("pilotId").alias("pilot_id"), F.col("maxAltitudeFt").alias("max_altitude_ft"),
                    js.to_instant(F.col("startTime")).alias("start_time"), js.to_instant(F.col("endTime")).alias("end_time"),
                    F.expr("rings[0][0].lon").alias("first_lon"), F.expr("rings[0][0].lat").alias("first_lat"),
                    F.size(F.flatten("rings")).cast("long").alias("n_vertices"))


@query("src_waivers", with_fixtures("waivers") + f"""
SELECT waiver_id, waiver_type, pilot_id, owner_id, conditions, {iso('start_time')} AS start_time,
       (pilot_id IS NULL) <> (owner_id IS NULL) AS one_subject FROM waivers""")
def q_src_waivers(spark, sf_dir):
    """S6 with V5: waiver bodies; exactly one of pilot and owner is set."""
    from ..operators import validate as v
    w = fx.waivers(spark, sf_dir).select("waiver_id", "waiver_type", "pilot_id", "owner_id", "conditions",
                                         F.date_format("start_time", _ISO).alias("start_time"),
                                         F.date_format("end_time", _ISO).alias("end_time"))
    out = _through_files(w, js.WAIVER_BODY)
    return out.select("waiver_id", "waiver_type", "pilot_id", "owner_id", "conditions",
                      js.to_instant(F.col("start_time")).alias("start_time"),
                      v.exactly_one(F.col("pilot_id"), F.col("owner_id")).alias("one_subject"))
