"""Validation of raw rows as one bulk job.

A rule is (path, message, ok-column). ``validate`` evaluates every rule as a
Catalyst boolean column and splits the input into accepted rows and rejected rows
carrying all issues (``array<struct<path, message>>``) and the joined report text
(V12). No per-row Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import to_instant

# The reference's enumerations and instant/date text patterns.
ENUMS = {
    "visibility_state": ["clear", "cloudy", "foggy", "rainy", "stormy"],
    "wind_state": ["calm", "slight_winds", "heavy_winds", "dangerous_winds"],
    "sensor_status": ["online", "offline"],
    "owner_type": ["individual", "organization"],
    "waiver_type": ["operations_from_moving_vehicle", "night_operations", "beyond_visual_line_of_sight",
                    "operations_over_people"],
    "status": ["proposed", "approved", "rescinded"],
}
# Fixed value: the message of a ceiling that does not fit the state.
CEILING_MESSAGE = "ceilingFt is required when state is 'foggy', and not allowed otherwise"
ISO_INSTANT_RE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z$"
ISO_DATE_RE = r"^\d{4}-\d{2}-\d{2}$"


@dataclass(frozen=True)
class Rule:
    path: str
    message: str
    ok: Column


# ------------------------------------------------------------------ rule builders

def coordinates_ok(lat: Column, lon: Column) -> Column:
    """V1: ``-90 < lat < 90`` (poles excluded), ``-180 <= lon <= 180`` (included); null fails."""
    return F.coalesce((lat > -90) & (lat < 90) & (lon >= -180) & (lon <= 180), F.lit(False))


def vertices_ok(rings: Column) -> Column:
    """V1 for every vertex of a polygon."""
    return F.coalesce(F.forall(F.flatten(rings), lambda v: coordinates_ok(v["lat"], v["lon"])), F.lit(False))


def polygon_ok(rings: Column) -> Column:
    """V2: at least one ring; each ring has at least 4 positions, all of two numbers (others are
    decoded to null), and is closed (no self-intersection check, as in the reference)."""
    def whole(v):
        return v["lon"].isNotNull() & v["lat"].isNotNull()

    return F.coalesce((F.size(rings) >= 1) & F.forall(rings, lambda r: (F.size(r) >= 4) & F.forall(r, whole) & (
        (F.get(r, 0)["lon"] == F.try_element_at(r, F.lit(-1))["lon"])
        & (F.get(r, 0)["lat"] == F.try_element_at(r, F.lit(-1))["lat"]))), F.lit(False))


# Fixed values: (path, message) of each fault of a spatial probe.
PROBE_FAULTS = {
    "both": ("", "Provide either lat/lon or lat1/lon1/lat2/lon2, not both"),
    "point": ("lon", "lat and lon must both be provided"),
    "extent": ("lat1", "lat1, lon1, lat2, and lon2 must all be provided"),
    "none": ("", "Provide either a point (lat/lon) or an extent (lat1/lon1/lat2/lon2)"),
    "height": ("lat2", "The extent must have nonzero height (lat1 and lat2 must differ)"),
    "width": ("lon2", "The extent must have nonzero width (lon1 and lon2 must differ)"),
}


def all_or_none(group: list[Column]) -> Column:
    """All columns of a group are given, or none."""
    given = [c.isNotNull() for c in group]
    return reduce(and_, given) | ~reduce(or_, given)


def any_given(group: list[Column]) -> Column:
    return reduce(or_, [c.isNotNull() for c in group])


def spatial_probe_issues(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """V3: a probe is a complete point or a complete extent, never both, neither or partial;
    an extent needs nonzero height and width (both may be reported). Returns the issue list.

    Precedence: whether one kind is given comes first; then whether the kind given is complete;
    then, of a complete extent, whether its corners differ.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in (lat, lon, lat1, lon1, lat2, lon2)]
    point, extent = cols[:2], cols[2:]
    only_point, only_extent = any_given(point) & ~any_given(extent), any_given(extent) & ~any_given(point)

    def fault(name: str, ok: Column) -> Rule:
        return Rule(*PROBE_FAULTS[name], ok)

    return issues([
        fault("both", ~(any_given(point) & any_given(extent))),
        fault("none", any_given(point) | any_given(extent)),
        fault("point", ~only_point | all_or_none(point)),
        fault("extent", ~only_extent | all_or_none(extent)),
        fault("height", ~only_extent | ~all_or_none(extent) | (cols[2] != cols[4])),
        fault("width", ~only_extent | ~all_or_none(extent) | (cols[3] != cols[5])),
    ])


def spatial_filter_kind(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """X10: 'point' when a point is given (preferred), else 'extent', else null (an error)."""
    c = (lambda x: F.col(x) if isinstance(x, str) else x)
    return (F.when(c(lat).isNotNull() & c(lon).isNotNull(), "point")
             .when(c(lat1).isNotNull() & c(lon1).isNotNull() & c(lat2).isNotNull() & c(lon2).isNotNull(), "extent"))


def enum_ok(value: Column, enum: str) -> Column:
    """V4."""
    return F.coalesce(value.isin(*ENUMS[enum]), F.lit(False))


def iff_present(flag: Column, value: Column) -> Column:
    """V5: ``value`` is present exactly when ``flag`` holds (ceiling iff foggy, company iff organization)."""
    return F.coalesce(flag, F.lit(False)) == value.isNotNull()


def exactly_one(a: Column, b: Column) -> Column:
    """V5: exactly one of two is present (waiver pilot / owner)."""
    return a.isNotNull() != b.isNotNull()


def interval_ok(start: Column, end: Column, closed: bool) -> Column:
    """V6: ``end >= start`` for registrations (closed), ``end > start`` for other windows."""
    return F.coalesce(end >= start if closed else end > start, F.lit(False))


def altitude_ok(alt: Column) -> Column:
    """V7: 0..2000 ft inclusive."""
    return F.coalesce((alt >= 0) & (alt <= 2000), F.lit(False))


def band_ok(lo: Column, hi: Column) -> Column:
    """V7: waypoint band inside 0..2000 with ``max > min`` strictly."""
    return altitude_ok(lo) & altitude_ok(hi) & F.coalesce(hi > lo, F.lit(False))


def unknown_keys(raw_json: Column, allowed: list[str]) -> Column:
    """V8 (strict objects): keys of the raw JSON object not in ``allowed``."""
    return F.array_except(F.coalesce(F.json_object_keys(raw_json), F.array().cast("array<string>")),
                          F.array(*[F.lit(k) for k in allowed]))


def plan_shape_ok(raw_json: Column) -> Column:
    """V8: a waypoint plan has at least one waypoint and no polygon fields; a polygon plan has
    both polygon fields and no waypoints; unknown keys are rejected."""
    keys = F.coalesce(F.json_object_keys(raw_json), F.array().cast("array<string>"))
    plan_type = F.get_json_object(raw_json, "$.planType")
    n_wp = F.json_array_length(F.get_json_object(raw_json, "$.waypoints"))
    has = (lambda k: F.array_contains(keys, k))
    wp_ok = (plan_type == "waypoints") & F.coalesce(n_wp >= 1, F.lit(False)) & ~has("polygonArea") & ~has(
        "polygonMaxAltitudeFt")
    poly_ok = (plan_type == "polygon") & has("polygonArea") & has("polygonMaxAltitudeFt") & ~has("waypoints")
    allowed = ["flightPlanId", "planType", "ownerId", "registrationId", "pilotId", "airspaceAuthorizationId",
               "startTime", "endTime", "waypoints", "polygonArea", "polygonMaxAltitudeFt"]
    return F.coalesce(wp_ok | poly_ok, F.lit(False)) & (F.size(unknown_keys(raw_json, allowed)) == 0)


def text_ok(value: Column) -> Column:
    """V9: nonempty text."""
    return F.coalesce(F.length(value) > 0, F.lit(False))


def positive_ok(value: Column) -> Column:
    """V9: a positive number (a sensor's radius)."""
    return F.coalesce(value > 0, F.lit(False))


def iso_instant_ok(text: Column) -> Column:
    """ISO-8601 UTC instant (``Z`` only, seconds optional, any number of fraction digits) that parses."""
    return F.coalesce(text.rlike(ISO_INSTANT_RE) & to_instant(text).isNotNull(), F.lit(False))


def iso_date_ok(text: Column) -> Column:
    """``YYYY-MM-DD`` that is a real date (a datetime is not a date)."""
    return F.coalesce(text.rlike(ISO_DATE_RE) & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def positive_int_text(text: Column) -> Column:
    """``limit`` given as text must be a positive integer."""
    v = text.try_cast("int")
    return F.coalesce(text.rlike(r"^\d+$") & (v > 0), F.lit(False))


# ------------------------------------------------------------------ bulk validation

def issues(rules: list[Rule]) -> Column:
    """All failing rules as ``array<struct<path, message>>``."""
    items = [F.when(~F.coalesce(r.ok, F.lit(False)),
                    F.struct(F.lit(r.path).alias("path"), F.lit(r.message).alias("message"))) for r in rules]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def reject_report(issue_list: Column) -> Column:
    """Issues as ``path: message`` joined by ``; ``."""
    return F.array_join(F.transform(issue_list, lambda i: F.concat(i["path"], F.lit(": "), i["message"])), "; ")


def validate(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Split rows into (accepted, rejected with ``issues`` and ``reason``)."""
    x = df.withColumn("issues", issues(rules))
    ok = x.filter(F.size("issues") == 0).drop("issues")
    bad = x.filter(F.size("issues") > 0).withColumn("reason", reject_report(F.col("issues")))
    return ok, bad
