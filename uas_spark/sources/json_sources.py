"""JSON request bodies as sources.

Every body can be read from JSON-lines files (``spark.read.text`` then parsed, or
``readStream`` for continuous ingest) or parsed from a text column; parsing is
``from_json`` with an explicit schema (no inference), so malformed bodies become
nulls that the validation rules reject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import to_instant  # noqa: F401  (part of reading bodies)

POSITION_BODY = ("reportId string, recordedAt string, latitude double, longitude double, altitudeFt double, "
                 "sensorId string")
ZONE_BODY = ("reportId string, zoneId string, recordedAt string, state string, ceilingFt double, "
             "polygon string")
OWNER_BODY = ("ownerId string, ownerType string, companyName string, firstName string, lastName string, "
              "phoneNumber string, addressLine1 string, addressLine2 string, addressCity string, "
              "addressState string, addressZip string, email string")
PILOT_BODY = "pilotId string, name string, phoneNumber string, licenseNumber string"
REGISTRATION_BODY = ("registrationId string, serialNumber string, make string, modelNumber string, ownerId string, "
                     "startDate date, endDate date")
WAIVER_BODY = ("waiverId string, waiverType string, pilotId string, ownerId string, conditions string, "
               "startTime string, endTime string")
AUTH_BODY = ("authorizationId string, ownerId string, pilotId string, maxAltitudeFt double, startTime string, "
             "endTime string, status string, area string")
PLAN_BODY = ("flightPlanId string, planType string, ownerId string, registrationId string, pilotId string, "
             "airspaceAuthorizationId string, startTime string, endTime string, "
             "waypoints array<struct<latitude:double,longitude:double,altitudeMinFt:double,altitudeMaxFt:double,"
             "radiusMeters:double>>, polygonArea string, polygonMaxAltitudeFt double")
SENSOR_BODY = ("sensorId string, name string, notes string, latitude double, longitude double, "
               "sensingRadiusMeters double, status string")
GEOJSON_POLYGON = "type string, coordinates array<array<array<double>>>"


def one_or_many(body: Column, schema: str) -> Column:
    """A body holding one object or an array of them, as an array of structs."""
    t = F.trim(body)
    return F.when(t.startswith("["), F.from_json(t, f"array<struct<{schema}>>")) \
            .otherwise(F.array(F.from_json(t, f"struct<{schema}>")))


def parse_bodies(df: DataFrame, body_col: str, schema: str, keep: list[str] | None = None) -> DataFrame:
    """Explode one-or-many bodies into one row per item, with the item's position."""
    keep = keep or []
    return df.select(*keep, F.posexplode(one_or_many(F.col(body_col), schema)).alias("item_pos", "item")) \
             .select(*keep, "item_pos", "item.*")


def read_bodies(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines files of bodies (one body per line) as rows."""
    return parse_bodies(spark.read.text(path).withColumnRenamed("value", "body"), "body", schema)


# ------------------------------------------------------------------ S8, S9: GeoJSON

def geojson_decode(text: Column) -> Column:
    """GeoJSON Polygon text to rings (``array<array<struct<lon,lat>>>``); x is lon. A position of
    fewer or more than two numbers becomes null, which V1 and V2 refuse."""
    g = F.from_json(text, GEOJSON_POLYGON)
    rings = F.transform(g["coordinates"], lambda r: F.transform(
        r, lambda p: F.when(F.size(p) == 2, F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat")))))
    return F.when(g["type"] == "Polygon", rings)


def geojson_encode(rings: Column) -> Column:
    """Rings back to GeoJSON Polygon text (positions as [lon, lat])."""
    coords = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"])))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")))


# ------------------------------------------------------------------ S7: sensors and profiles

def sensors_from_bodies(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Sensor bodies; status defaults to offline."""
    s = df.select(F.from_json(F.col(body_col), f"struct<{SENSOR_BODY}>").alias("s")).select("s.*")
    return s.withColumn("status", F.coalesce(F.col("status"), F.lit("offline")))


def profile_variant(text: Column) -> Column:
    """Opaque JSON profile as VARIANT (null when not valid JSON)."""
    return F.try_parse_json(text)


def store_profiles(profiles: DataFrame, path: str, text_col: str = "profile_json", col: str = "profile") -> None:
    """Profile texts parsed once and stored as VARIANT in Parquet under ``col``."""
    (profiles.withColumn(col, profile_variant(F.col(text_col))).drop(text_col)
     .write.mode("overwrite").parquet(path))


def profile_is_object(v: Column) -> Column:
    """A profile must be a JSON object."""
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def profile_extract(v: Column, path: str, type_: str = "int") -> Column:
    """Nested tuning value from a profile, e.g. ``$.pollIntervalMs.min``."""
    return F.try_variant_get(v, path, type_)


def number_field(raw_json: Column, path: str, coerce_text: bool) -> Column:
    """A numeric field of a raw JSON body as DOUBLE.

    Weather and authorization inputs coerce numeric text ("47.6") to a number; the flight
    logs do not (text there is invalid, so the result is null and validation rejects it).
    The JSON type is read from the VARIANT, which tells a string from a number.
    """
    v = F.try_parse_json(raw_json)
    if coerce_text:
        return F.try_variant_get(v, path, "double")
    is_text = F.schema_of_variant(F.variant_get(v, path, "variant")).startswith("STRING")
    return F.when(~F.coalesce(is_text, F.lit(False)), F.try_variant_get(v, path, "double"))
