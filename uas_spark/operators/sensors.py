"""Sensor network operators (N1-N3), re-aimed from the documented sensor simulator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def active_sensors(sensors: DataFrame, profiles: DataFrame) -> DataFrame:
    """Sensors that have a profile."""
    return sensors.join(profiles.select("sensor_id", "profile_json"), "sensor_id", "inner")


def sensor_reconcile(previous: DataFrame, current: DataFrame, version_col: str = "profile_version") -> DataFrame:
    """Diff two discovery snapshots (sensor_id, profile version): new sensors start, changed
    ones restart, vanished ones stop; unchanged ones keep running.

    Returns (sensor_id, action, status) with status online/offline after the action.
    """
    p = previous.select("sensor_id", F.col(version_col).alias("_pv"))
    c = current.select("sensor_id", F.col(version_col).alias("_cv"))
    j = p.join(c, "sensor_id", "full_outer")
    action = (F.when(F.col("_pv").isNull(), "start")
               .when(F.col("_cv").isNull(), "stop")
               .when(~F.col("_pv").eqNullSafe(F.col("_cv")), "restart")
               .otherwise("keep"))
    return j.select("sensor_id", action.alias("action"),
                    F.when(action == "stop", "offline").otherwise("online").alias("status"))


def downsample_track(positions: DataFrame, every: str = "5 minutes", key: str = "drone_serial_number") -> DataFrame:
    """Per drone and tumbling window, the first report (coarser sample of the true track).

    ``min_by`` is a partial aggregate, so a drone with a third of all reports is combined
    map-side before the shuffle.
    """
    g = positions.groupBy(key, F.window("recorded_at", every).alias("w")).agg(
        F.min_by(F.struct("report_id", "recorded_at", "latitude", "longitude", "altitude_ft"),
                 F.struct("recorded_at", "report_id")).alias("first"))
    return g.select(key, F.col("w.start").alias("window_start"), "first.*")
