"""Partial updates, lifecycle gates, upserts and deletes.

Patches are DataFrames of (target id, seq, fields...). Several patches to one id are
applied in ``seq`` order. Where the outcome of a patch does not depend on values set
by earlier patches, the operator uses partial aggregates per id joined back to the
patches (skew-safe). Where it does (time windows re-checked after each patch), the patches
are folded in segments that do not depend on each other (``folds.window_checks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import to_instant
from ..session import saved_rows
from .folds import window_checks


def _stamp(stamp: str) -> Column:
    return F.to_timestamp(F.lit(stamp))


# ------------------------------------------------------------------ M15, M16

def patch_coalesce(base: DataFrame, patches: DataFrame, key: str, fields: list[str], stamp: str,
                   target_col: str = "target_id", seq_col: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Absent (null) fields keep their value; a patch cannot set null. Several patches to
    one id: per field the last non-null value by ``seq`` (a partial aggregate). Every matched
    row gets ``updated_at = stamp``, even for an empty patch.

    Returns (patched table, patches whose target does not exist).
    """
    agg = patches.groupBy(F.col(target_col).alias("_tid")).agg(
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(seq_col))).alias("_p_" + f) for f in fields])
    out = base.join(agg, base[key] == agg["_tid"], "left")
    cols = []
    for c in base.columns:
        if c in fields:
            cols.append(F.coalesce(F.col("_p_" + c), F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(F.col("_tid").isNotNull(), _stamp(stamp)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    missing = patches.join(base.select(F.col(key).alias("_k")), F.col(target_col) == F.col("_k"), "left_anti")
    return out.select(*cols), missing.withColumn("reason", F.lit("not_found"))


def json_has_key(raw_json: Column, name: str) -> Column:
    """The raw JSON object lists ``name`` as a key (also when its value is null)."""
    return F.coalesce(F.array_contains(F.json_object_keys(raw_json), name), F.lit(False))


def patch_nullable(base: DataFrame, patches: DataFrame, key: str, field: str, json_key: str, stamp: str,
                   raw_col: str = "raw", target_col: str = "target_id", seq_col: str = "seq") -> DataFrame:
    """Absent keeps, explicit null clears, a value sets. Presence is read from the raw
    JSON keys, since a typed read loses the difference. Last present patch by ``seq`` wins."""
    p = patches.withColumn("_present", json_has_key(F.col(raw_col), json_key)) \
               .withColumn("_val", F.get_json_object(F.col(raw_col), f"$.{json_key}"))
    agg = p.groupBy(F.col(target_col).alias("_tid")).agg(
        F.max(F.when(F.col("_present"), F.col(seq_col))).alias("_last_seq"),
        F.max_by(F.col("_val"), F.when(F.col("_present"), F.col(seq_col))).alias("_new"))
    out = base.join(agg, base[key] == agg["_tid"], "left")
    cols = []
    for c in base.columns:
        if c == field:
            cols.append(F.when(F.col("_last_seq").isNotNull(), F.col("_new")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(F.col("_tid").isNotNull(), _stamp(stamp)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols)


# ------------------------------------------------------------------ M18: lifecycle by aggregates

def lifecycle_outcomes(base: DataFrame, patches: DataFrame, key: str, other_fields: list[str],
                       pilot_ok: Column | None = None, target_col: str = "target_id",
                       seq_col: str = "seq", present_cols: list[str] | None = None) -> DataFrame:
    """``proposed`` takes any patch; ``approved`` only a pure rescind; ``rescinded``
    nothing. A patch failing the pilot check is refused first and changes nothing. Where patches
    have ``start_time`` and ``end_time``, one that the gate lets pass must leave a window that ends
    after its start; else it is refused with 'end_before_start' and changes nothing. A patch
    touches a field if it gives a value, or if a column of ``present_cols`` says that it lists
    the field's key (an explicit null clears the field and is a touch too).

    The status moves at most twice, so each patch's outcome follows from per-id minima over
    the effective patches (one partial aggregate, no fold): k1, the first status move, with
    its status, and k2, the first pure rescind. A pure rescind is itself a move, so k2 >= k1
    always, and after an approval at k1 the next accepted patch is k2. Windows move only while the
    status is proposed, so they are checked (``window_checks``) as if it stayed so: up to k1 that is
    what happens, and after it the gate decides alone.
    Returns the patches with ``outcome`` and ``status_after``. The patches are read twice, by the window checks
    and by the gate: callers save what is costly to make (``session.saved_rows``).
    """
    windowed = {"start_time", "end_time"} <= set(patches.columns)
    if windowed:
        other_fields = [*dict.fromkeys([*other_fields, "start_time", "end_time"])]
    touches = None
    for f in other_fields:
        c = F.col(f).isNotNull()
        touches = c if touches is None else touches | c
    for f in present_cols or []:
        c = F.coalesce(F.col(f), F.lit(False))
        touches = c if touches is None else touches | c
    touches = touches if touches is not None else F.lit(False)
    eff = pilot_ok if pilot_ok is not None else F.lit(True)
    p = patches.withColumn("_eff", eff)
    if windowed:
        p = _with_window_check(p, base.select(F.col(key).alias("_tid"), F.col("start_time").alias("_st0"),
                                              F.col("end_time").alias("_en0")), target_col, seq_col, F.col("_eff"))
    else:
        p = p.withColumn("_bad", F.lit(False))
    moves = F.col("_eff") & ~F.col("_bad") & F.col("status").isin("approved", "rescinded")
    pure = F.col("_eff") & (F.col("status") == "rescinded") & ~touches
    agg = p.groupBy(F.col(target_col).alias("_tid")).agg(
        F.min(F.when(moves, F.col(seq_col))).alias("_k1"),
        F.min_by(F.col("status"), F.when(moves, F.col(seq_col))).alias("_k1_status"),
        F.min(F.when(pure, F.col(seq_col))).alias("_k2"))
    b = base.select(F.col(key).alias("_bid"), F.col("status").alias("_s0"))
    agg = agg.join(b, F.col("_tid") == F.col("_bid"), "left").drop("_bid")
    p = p.join(agg, F.col(target_col) == F.col("_tid"), "left")
    seq = F.col(seq_col)
    proposed = F.col("_s0") == "proposed"
    approved_from = (F.when(F.col("_s0") == "approved", F.lit(-1 << 62))
                      .when(proposed & (F.col("_k1_status") == "approved"), F.col("_k1")))
    rescinded_from = (F.when(F.col("_s0") == "rescinded", F.lit(-1 << 62))
                       .when(proposed & (F.col("_k1_status") == "rescinded"), F.col("_k1"))
                       .when(approved_from.isNotNull(), F.col("_k2")))
    outcome = (F.when(F.col("_s0").isNull(), "not_found")
                .when(~F.col("_eff"), "pilot_not_found")
                .when(rescinded_from.isNotNull() & (seq > rescinded_from), "rescinded_terminal")
                .when(approved_from.isNotNull() & (seq > approved_from) & (seq != F.coalesce(F.col("_k2"), F.lit(-1))),
                      "approved_immutable")
                .when(F.col("_bad"), "end_before_start")
                .otherwise("accepted"))
    status_after = (F.when(F.col("_s0").isNull(), F.lit(None))
                     .when(rescinded_from.isNotNull() & (seq >= rescinded_from), "rescinded")
                     .when(approved_from.isNotNull() & (seq >= approved_from), "approved")
                     .otherwise("proposed"))
    return p.withColumn("outcome", outcome).withColumn("status_after", status_after) \
            .drop("_tid", "_s0", "_k1", "_k1_status", "_k2", "_eff", "_bad")


def _with_window_check(patches: DataFrame, base: DataFrame, target_col: str, seq_col: str, ok: Column) -> DataFrame:
    """``patches`` with ``_bad`` (see ``window_checks``); a patch without times is not bad."""
    checked = window_checks(patches.select(F.col(target_col).alias("_tid"), F.col(seq_col).alias("_seq"),
                                           F.col("start_time").alias("_st"), F.col("end_time").alias("_en"),
                                           ok.alias("_ok")), base)
    out = patches.join(checked, (F.col(target_col) == F.col("_tid")) & (F.col(seq_col) == F.col("_seq")), "left")
    return out.withColumn("_bad", F.coalesce("_bad", F.lit(False))).drop("_tid", "_seq")


def apply_accepted(base: DataFrame, judged: DataFrame, key: str, fields: list[str], stamp: str,
                   target_col: str = "target_id", seq_col: str = "seq",
                   cleared: dict[str, str] | None = None) -> DataFrame:
    """The table after its accepted patches (M17-M20): per id and field the last value given by
    an accepted patch, ``updated_at = stamp``, and ``rescinded_at = stamp`` where a patch moved
    the status to rescinded. One partial aggregate per id, joined back; rows without an accepted
    patch are unchanged.

    ``judged``: the patches with ``outcome``. ``fields`` are columns of both sides in which null
    keeps the stored value; ``cleared`` maps a nullable column to a column of ``judged`` that is
    true where the patch lists the field, so that a listed null clears it.
    """
    ok = judged.filter("outcome = 'accepted'")
    fields = [f for f in fields if f in base.columns]
    cleared = cleared or {}
    seq = F.col(seq_col)
    agg = ok.groupBy(F.col(target_col).alias("_tid")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), seq)).alias("_p_" + f) for f in fields],
        *[F.max_by(F.struct(F.col(f).alias("v")), F.when(F.col(c), seq)).alias("_c_" + f) for f, c in cleared.items()])
    out, cols = base.join(agg, base[key] == agg["_tid"], "left"), []
    for c in base.columns:
        if c in cleared:
            col = F.when(F.col("_c_" + c).isNotNull(), F.col("_c_" + c)["v"]).otherwise(F.col(c))
        elif c in fields:
            col = F.coalesce(F.col("_p_" + c), F.col(c))
        elif c == "updated_at":
            col = F.when(F.col("_n") > 0, _stamp(stamp)).otherwise(F.col(c))
        elif c == "rescinded_at" and "status" in fields:
            moved = (F.col("_p_status") == "rescinded") & (F.col("status") != "rescinded")
            col = F.when(moved, _stamp(stamp)).otherwise(F.col(c))
        else:
            col = F.col(c)
        cols.append(col.alias(c))
    return out.select(*cols)


# ------------------------------------------------------------------ M19

def lifecycle_fold(base: DataFrame, patches: DataFrame, key: str, field: str,
                   target_col: str = "target_id", seq_col: str = "seq") -> DataFrame:
    """M19 (waivers): the gate of M18 and the check of the merged window, for patches that may set
    ``field``, ``start_time``, ``end_time`` and ``status``.

    Returns one row per patch: (target_id, seq, outcome, status_after); ``apply_accepted`` joined
    with the patches gives the table afterwards.
    """
    out = lifecycle_outcomes(base, patches, key, [field], target_col=target_col, seq_col=seq_col)
    return out.select(target_col, F.col(seq_col).cast("bigint").alias(seq_col), "outcome", "status_after")


# ------------------------------------------------------------------ M21-M23

def profile_upsert(profiles: DataFrame, sensors: DataFrame, upserts: DataFrame, stamp: str,
                   seq_col: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Create or replace the whole profile document; the last write per sensor wins; an
    unknown sensor is refused; a replaced row keeps its ``created_at``.

    ``upserts``: sensor_id, profile_json, seq. Returns (profiles after, refused upserts).
    """
    known = upserts.join(sensors.select("sensor_id"), "sensor_id", "left_semi")
    refused = upserts.join(sensors.select("sensor_id"), "sensor_id", "left_anti") \
                     .withColumn("reason", F.lit("unknown_sensor"))
    last = known.groupBy("sensor_id").agg(F.max_by("profile_json", seq_col).alias("_new"))
    old = profiles.select("sensor_id", F.col("profile_json").alias("_old"), F.col("created_at").alias("_c"),
                          F.col("updated_at").alias("_u"))
    j = old.join(last, "sensor_id", "full_outer")
    st = _stamp(stamp)
    out = j.select("sensor_id", F.coalesce(F.col("_new"), F.col("_old")).alias("profile_json"),
                   F.coalesce(F.col("_c"), st).alias("created_at"),
                   F.when(F.col("_new").isNotNull(), st).otherwise(F.col("_u")).alias("updated_at"))
    return out, refused


def delete_reporting(pilots: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete a pilot only under its owner. Returns (remaining pilots, deletes with
    ``deleted`` telling whether a row matched; a pilot under another owner is not found)."""
    keyed = pilots.select(F.col("pilot_id").alias("_p"), F.col("organization_owner_id").alias("_o"))
    cond = (F.col("pilot_id") == F.col("_p")) & (F.col("owner_id") == F.col("_o"))
    report = deletes.join(keyed.withColumn("_hit", F.lit(True)), cond, "left") \
                    .withColumn("deleted", F.coalesce(F.col("_hit"), F.lit(False))).drop("_p", "_o", "_hit")
    d = deletes.select(F.col("pilot_id").alias("_p"), F.col("owner_id").alias("_o"))
    remaining = pilots.join(d, (F.col("pilot_id") == F.col("_p")) & (F.col("organization_owner_id") == F.col("_o")),
                            "left_anti")
    return remaining, report


def delete_idempotent(profiles: DataFrame, deletes: DataFrame, key: str = "sensor_id") -> DataFrame:
    """Delete profiles; deleting an absent one is fine."""
    return profiles.join(deletes.select(key), key, "left_anti")


# ------------------------------------------------------------------ M20

def flight_plan_patch(plans: DataFrame, patches: DataFrame, pilots: DataFrame, registrations: DataFrame,
                      auths: DataFrame, raw_col: str = "raw", target_col: str = "target_id",
                      seq_col: str = "seq", keep: list[str] | None = None) -> DataFrame:
    """link/unlink (``registrationId``, ``pilotId``, ``airspaceAuthorizationId``: absent
    keeps, null clears, value sets) and window patches (absent keeps), applied to a plan in
    ``seq`` order. Shape and owner are immutable. Reasons in the reference's order: not_found,
    pilot_not_found, registration_not_found, registration_owner_mismatch, end_before_start (the
    row's own check), authorization_not_found (its foreign key); else accepted.

    The link checks look at values being set only, so they do not depend on earlier patches;
    the window does, and a plan's patches that give a time are checked in order (``window_checks``).
    The others only need to know the window as of their turn, which cannot be bad. Returns the patches (their
    columns ``keep``, default all) with ``outcome``, the links and times they give and which links they list
    (``has_*``).
    """
    from .refs import ref_authorization_exists, ref_pilot_under_owner, ref_registration_owner
    raw = F.col(raw_col)
    p = patches.select(
        "*",
        json_has_key(raw, "pilotId").alias("has_pilot"), F.get_json_object(raw, "$.pilotId").alias("pilot_id"),
        json_has_key(raw, "registrationId").alias("has_registration"),
        F.get_json_object(raw, "$.registrationId").alias("registration_id"),
        json_has_key(raw, "airspaceAuthorizationId").alias("has_authorization"),
        F.get_json_object(raw, "$.airspaceAuthorizationId").alias("airspace_authorization_id"),
        to_instant(F.get_json_object(raw, "$.startTime")).alias("start_time"),
        to_instant(F.get_json_object(raw, "$.endTime")).alias("end_time"))
    base = plans.select(F.col("flight_plan_id").alias("_fid"), F.col("owner_id").alias("_owner"),
                        F.col("start_time").alias("_st0"), F.col("end_time").alias("_en0"))
    p = p.join(base, F.col(target_col) == F.col("_fid"), "left")
    given = ["pilot_id", "registration_id", "airspace_authorization_id", "start_time", "end_time", "has_pilot",
             "has_registration", "has_authorization"]
    keep = patches.columns if keep is None else keep
    needed = list(dict.fromkeys([*keep, target_col, seq_col, *given]))
    # saved: each look-up reads the rows that give its link apart from the others, which it does not shuffle
    p = saved_rows(p.select(*needed, "_fid", "_owner"))
    p = ref_pilot_under_owner(p, pilots, "pilot_id", "_owner", saved=True)
    p = ref_registration_owner(p, registrations, "registration_id", "_owner", saved=True)
    p = ref_authorization_exists(p, auths, "airspace_authorization_id", saved=True)
    p = p.withColumn("_before", F.when(F.col("_fid").isNull(), "not_found")
                     .when(~F.col("pilot_found"), "pilot_not_found")
                     .otherwise(F.col("registration_check"))).withColumn("_auth_ok", F.col("authorization_found"))
    windows = base.select(F.col("_fid").alias("_tid"), "_st0", "_en0")
    # saved again: the window checks and the outcomes both read the patches, with what was looked up for them
    p = saved_rows(p.select(*needed, "_before", "_auth_ok"))
    p = _with_window_check(p, windows, target_col, seq_col, F.col("_before").isNull() & F.col("_auth_ok"))
    outcome = (F.when(F.col("_before").isNotNull(), F.col("_before"))
                .when(F.col("_bad"), "end_before_start")
                .when(~F.col("_auth_ok"), "authorization_not_found").otherwise("accepted"))
    return p.select(*keep, outcome.alias("outcome"), *given)
