"""Reference checks across datasets (M7-M12) and the flight-plan create check.

The reference checks references with HTTP calls to a sibling service, one request
at a time; here each check is a join against the referenced table, so a whole batch
is checked at once. Checks only add columns; callers decide what to reject.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


SPREAD = 1 << 20


def _look_up(df: DataFrame, r: DataFrame, left_keys: list[str], ref_keys: list[str],
             by: list[str] | None = None, saved: bool = False) -> DataFrame:
    """``df`` left joined with ``r`` on the keys. Rows with a null key, often most of them, meet
    nothing; they would all be dealt to one task, so a second key spreads them by the columns ``by`` (default:
    all that are not nested). Where ``df`` is ``saved``, so that it costs little to read it twice, they go
    around the join instead and are not shuffled."""
    whole = reduce(and_, [F.col(k).isNotNull() for k in left_keys])
    if saved:
        cond = reduce(and_, [F.col(a) == F.col(b) for a, b in zip(left_keys, ref_keys)])
        alone = df.filter(~whole).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in r.schema.fields])
        return df.filter(whole).join(r, cond, "left").unionByName(alone)
    by = by or [f.name for f in df.schema.fields if not isinstance(f.dataType, _NESTED)]
    out = df.withColumn("_ls", F.when(whole, 0).otherwise(1 + F.pmod(F.xxhash64(*by), F.lit(SPREAD)).cast("int")))
    r = r.filter(reduce(and_, [F.col(k).isNotNull() for k in ref_keys])).withColumn(
        "_rs", F.when(F.col(ref_keys[0]).isNotNull(), 0))  # not a literal: that would be folded out of the join's keys
    cond = reduce(and_, [F.col(a) == F.col(b) for a, b in zip(left_keys, ref_keys)])
    return out.join(r, cond & (F.col("_ls") == F.col("_rs")), "left").drop("_ls", "_rs")


def _found(df: DataFrame, ref: DataFrame, left_keys: list[str], ref_keys: list[str], flag: str,
           by: list[str] | None = None, saved: bool = False) -> DataFrame:
    """Add boolean ``flag``: the (non-null) key combination exists in ``ref``.

    A left semi-style join: ``ref`` keys are de-duplicated first, so the row count is kept.
    """
    names = [f"_r{i}" for i in range(len(ref_keys))]
    r = ref.select(*[F.col(k).alias(n) for k, n in zip(ref_keys, names)]).distinct().withColumn(flag, F.lit(True))
    out = _look_up(df, r, left_keys, names, by, saved)
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).drop(*names)


def ref_owner_exists(df: DataFrame, owners: DataFrame, owner_col: str = "owner_id") -> DataFrame:
    """M7: ``owner_found``."""
    return _found(df, owners, [owner_col], ["owner_id"], "owner_found")


def ref_pilot_under_owner(df: DataFrame, pilots: DataFrame, pilot_col: str = "pilot_id",
                          owner_col: str = "owner_id", by: list[str] | None = None, saved: bool = False) -> DataFrame:
    """M8: ``pilot_found`` = pilot exists AND belongs to that owner (null pilot: true)."""
    out = _found(df, pilots, [pilot_col, owner_col], ["pilot_id", "organization_owner_id"], "_pf", by, saved)
    return out.withColumn("pilot_found", F.col(pilot_col).isNull() | F.col("_pf")).drop("_pf")


def ref_pilot_standalone(df: DataFrame, pilots: DataFrame, pilot_col: str = "pilot_id") -> DataFrame:
    """M9: ``pilot_found`` = the pilot exists under any owner (null pilot: true)."""
    out = _found(df, pilots, [pilot_col], ["pilot_id"], "_pf")
    return out.withColumn("pilot_found", F.col(pilot_col).isNull() | F.col("_pf")).drop("_pf")


def ref_registration_owner(df: DataFrame, registrations: DataFrame, reg_col: str = "registration_id",
                           owner_col: str = "owner_id", by: list[str] | None = None, saved: bool = False) -> DataFrame:
    """``registration_check`` in (null = fine or absent, 'registration_not_found',
    'registration_owner_mismatch')."""
    r = registrations.select(F.col("registration_id").alias("_rid"), F.col("owner_id").alias("_rowner"))
    out = _look_up(df, r, [reg_col], ["_rid"], by, saved)
    check = (F.when(F.col(reg_col).isNull(), F.lit(None).cast("string"))
              .when(F.col("_rid").isNull(), "registration_not_found")
              .when(F.col("_rowner") != F.col(owner_col), "registration_owner_mismatch"))
    return out.withColumn("registration_check", check).drop("_rid", "_rowner")


def ref_authorization_exists(df: DataFrame, auths: DataFrame, auth_col: str = "airspace_authorization_id",
                             by: list[str] | None = None, saved: bool = False) -> DataFrame:
    """``authorization_found`` (null link: true)."""
    out = _found(df, auths, [auth_col], ["authorization_id"], "_af", by, saved)
    return out.withColumn("authorization_found", F.col(auth_col).isNull() | F.col("_af")).drop("_af")


def pilot_owner_is_organization(pilots: DataFrame, owners: DataFrame) -> DataFrame:
    """Pilots may only be created under organization owners.

    Adds ``reason``: null, 'owner_not_found' or 'owner_not_organization'.
    """
    o = owners.select(F.col("owner_id").alias("_oid"), F.col("owner_type").alias("_otype"))
    out = pilots.join(o, F.col("organization_owner_id") == F.col("_oid"), "left")
    reason = (F.when(F.col("_oid").isNull(), "owner_not_found")
               .when(F.col("_otype") != "organization", "owner_not_organization"))
    return out.withColumn("reason", reason).drop("_oid", "_otype")


def flight_plan_create_check(plans: DataFrame, owners: DataFrame, pilots: DataFrame,
                             registrations: DataFrame, auths: DataFrame, existing: DataFrame,
                             arrival: list) -> DataFrame:
    """Create check of flight plans with the reference's reason precedence: owner, pilot,
    registration missing, registration mismatch, duplicate id, authorization missing.
    Adds ``outcome`` ('accepted' or the first failing reason)."""
    from .ingest import insert_if_absent
    x = ref_owner_exists(plans, owners)
    by = ["flight_plan_id"]
    x = ref_pilot_under_owner(x, pilots, by=by)
    x = ref_registration_owner(x, registrations, by=by)
    x = ref_authorization_exists(x, auths, by=by)
    x = insert_if_absent(existing, x, "flight_plan_id", arrival).withColumnRenamed("outcome", "_dup")
    outcome: Column = (F.when(~F.col("owner_found"), "owner_not_found")
                        .when(~F.col("pilot_found"), "pilot_not_found")
                        .when(F.col("registration_check").isNotNull(), F.col("registration_check"))
                        .when(F.col("_dup") == "duplicate_id", "duplicate_id")
                        .when(~F.col("authorization_found"), "authorization_not_found")
                        .otherwise("accepted"))
    return x.withColumn("outcome", outcome).drop("_dup")
