"""Latest, as-of and nearest-in-time operators (T1-T6, P1, P2) and validity intervals.

Every "newest per key" pick is a ``row_number() == 1`` window, which Catalyst
plans as a partial ``WindowGroupLimit`` before the shuffle and a final one after
it: a hot key sends at most one row per map partition across the network.

Probe joins (P1, P2) never partition by the key alone. Rows are cut into
(key, time bucket) partitions; each probe bucket is seeded with the last report
of the earlier buckets, found on a per-bucket summary (one row per key and
non-empty bucket). A key holding a third of all rows is therefore spread over its
buckets. The bucket (default one hour) bounds the largest window partition by a
key's rows per hour; the summary a key sorts alone grows only with the time span
(8,760 rows per key-year).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def _us(c) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def top1(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key under ``order`` (``DISTINCT ON``)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


# ------------------------------------------------------------------ single-time forms

def latest_position(reports: DataFrame, key: str = "drone_serial_number") -> DataFrame:
    """Newest report per drone, no staleness limit; ties by report_id."""
    return top1(reports, [key], [F.col("recorded_at").desc(), F.col("report_id")])


def minutes_ago(stamp, minutes: int) -> Column:
    """``stamp - minutes``."""
    s = F.to_timestamp(F.lit(stamp)) if isinstance(stamp, str) else stamp
    return s - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(minutes)))


def time_distance_us(a, b) -> Column:
    """Absolute distance of two instants in microseconds."""
    return F.abs(_us(a) - _us(b))


def zone_latest_fresh(observed: DataFrame, stamp: str | Column, stale_minutes: int = 30) -> DataFrame:
    """Newest observed report per zone recorded at or after ``stamp - stale`` (no upper bound)."""
    fresh = observed.filter(F.col("recorded_at") >= minutes_ago(stamp, stale_minutes))
    return top1(fresh, ["zone_id"], [F.col("recorded_at").desc(), F.col("report_id")])


def zone_asof(observed: DataFrame, at: str) -> DataFrame:
    """Newest observed report per zone at or before ``at``, no staleness."""
    past = observed.filter(F.col("recorded_at") <= F.to_timestamp(F.lit(at)))
    return top1(past, ["zone_id"], [F.col("recorded_at").desc(), F.col("report_id")])


def zone_forecast_nearest(forecast: DataFrame, at: str) -> DataFrame:
    """T4: per zone the forecast nearest ``at`` on either side; ties by newest ingested_at, report_id."""
    a = F.to_timestamp(F.lit(at))
    return top1(forecast, ["zone_id"],
                [time_distance_us(F.col("recorded_at"), a), F.col("ingested_at").desc(), F.col("report_id")])


def limit_n(df: DataFrame, order: list, n: int | None) -> DataFrame:
    """``ORDER BY ... LIMIT n``; ``None`` means no limit."""
    out = df.orderBy(*order)
    return out if n is None else out.limit(int(n))


# ------------------------------------------------------------------ bucketed as-of join

def _asof_last(probes: DataFrame, reports: DataFrame, key: str, probe_us: Column, report_us: Column,
               report_rank: list[tuple[Column, bool]], bucket_us: int) -> DataFrame:
    """For every probe, the last report with ``report_us <= probe_us`` in the same key.

    ``report_rank`` is a list of (value, descending) pairs ordering reports that share an
    instant; the last one in that order wins. Returns the probe columns plus a struct
    column ``rep`` (null when nothing precedes the probe).
    """
    pcols, rcols = probes.columns, reports.columns
    n_rank = len(report_rank)
    okeys = [f"_o{i}" for i in range(n_rank)]

    def fwd(i):  # order of the sweep
        return F.col(okeys[i]).desc() if report_rank[i][1] else F.col(okeys[i]).asc()

    def rev(i):  # reverse order: winner first
        return F.col(okeys[i]).asc() if report_rank[i][1] else F.col(okeys[i]).desc()

    p = probes.select(F.col(key).alias("_k"), probe_us.alias("_t"),
                      F.struct(*[F.col(c) for c in pcols]).alias("prb"))
    r = reports.select(F.col(key).alias("_k"), report_us.alias("_t"),
                       F.struct(*[F.col(c) for c in rcols]).alias("rep"),
                       *[c.alias(okeys[i]) for i, (c, _) in enumerate(report_rank)])
    p = p.withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us)))
    r = r.withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us)))

    # last report of each (key, bucket): partial + final WindowGroupLimit
    last_in_bucket = top1(r, ["_k", "_b"], [F.col("_t").desc()] + [rev(i) for i in range(n_rank)])
    # seed of each probe bucket: last report of any strictly earlier bucket (small table:
    # one row per key and bucket)
    rep_t = r.schema["rep"].dataType
    marks = p.select("_k", "_b").distinct().select("_k", "_b", F.lit(0).alias("_side"),
                                                    F.lit(None).cast(rep_t).alias("rep"))
    summ = last_in_bucket.select("_k", "_b", F.lit(1).alias("_side"), "rep")
    wz = (Window.partitionBy("_k").orderBy("_b", "_side")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seeds = (marks.unionByName(summ)
             .withColumn("_seed", F.last("rep", ignorenulls=True).over(wz))
             .filter(F.col("_side") == 0)
             .select("_k", "_b", F.col("_seed").alias("rep")))

    null_prb = F.lit(None).cast(p.schema["prb"].dataType)
    null_rep = F.lit(None).cast(rep_t)
    rank_nulls = [F.lit(None).cast(r.schema[o].dataType).alias(o) for o in okeys]
    u = (seeds.select("_k", "_b", F.lit(None).cast("long").alias("_t"), F.lit(0).alias("_side"), "rep",
                      null_prb.alias("prb"), *rank_nulls)
         .unionByName(r.select("_k", "_b", "_t", F.lit(1).alias("_side"), "rep", null_prb.alias("prb"), *okeys))
         .unionByName(p.select("_k", "_b", "_t", F.lit(2).alias("_side"), null_rep.alias("rep"), "prb",
                               *rank_nulls)))
    w = (Window.partitionBy("_k", "_b")
         .orderBy(F.col("_t").asc_nulls_first(), "_side", *[fwd(i) for i in range(n_rank)])
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = (u.withColumn("_hit", F.last("rep", ignorenulls=True).over(w))
             .filter(F.col("_side") == 2))
    return out.select(*[F.col("prb." + c).alias(c) for c in pcols], F.col("_hit").alias("rep"))


def join_zone_asof(probes: DataFrame, observed: DataFrame, at_col: str = "at",
                   bucket_us: int = HOUR_US) -> DataFrame:
    """Zone state at each probe time (T3 for many (zone_id, at) probes).

    Newest report with ``recorded_at <= at``; same-instant ties go to the smallest report_id.
    """
    return _asof_last(probes, observed, "zone_id", _us(at_col), _us("recorded_at"),
                      [(F.col("report_id"), True)], bucket_us)


def forecast_instants(forecast: DataFrame) -> DataFrame:
    """One forecast per (zone, target instant): the newest issued, then smallest report_id."""
    return top1(forecast, ["zone_id", "recorded_at"], [F.col("ingested_at").desc(), F.col("report_id")])


def _beats(a: Column, b: Column) -> Column:
    """Forecast ``a`` wins a distance tie against ``b``: newer ingested_at, then smaller report_id."""
    return ((a["ingested_at"] > b["ingested_at"])
            | ((a["ingested_at"] == b["ingested_at"]) & (a["report_id"] < b["report_id"])))


def _asof_both(probes: DataFrame, reports: DataFrame, key: str, probe_us: Column, report_us: Column,
               bucket_us: int) -> DataFrame:
    """For every probe, the last report at or before it (``prev``) and the first one after it (``next``)
    in the same key; reports of a key have distinct instants.

    One deal by (key, bucket) serves both: its rows are swept forwards and backwards, each way
    seeded with the nearest report of the buckets on that side, found on the summary of buckets.
    """
    p = probes.select(F.col(key).alias("_k"), probe_us.alias("_t"), F.struct(*[F.col(c) for c in probes.columns]).alias("prb"))
    r = reports.select(F.col(key).alias("_k"), report_us.alias("_t"), F.struct(*[F.col(c) for c in reports.columns]).alias("rep"))
    p = p.withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us)))
    r = r.withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us)))
    ends = r.groupBy("_k", "_b").agg(F.min_by("rep", "_t").alias("_first"), F.max_by("rep", "_t").alias("_last"))
    marks = p.select("_k", "_b").distinct().withColumn("_side", F.lit(0))
    ends = marks.unionByName(ends.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    # in either order a bucket's mark comes before its own summary
    up = Window.partitionBy("_k").orderBy("_b", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("_k").orderBy(F.desc("_b"), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seeds = ends.select("_k", "_b", "_side", F.last("_last", ignorenulls=True).over(up).alias("_before"),
                        F.last("_first", ignorenulls=True).over(down).alias("_after")).filter("_side = 0")
    # order of the sweep: the seed from before, reports and probes by time (a report first), the seed from after
    u = (seeds.select("_k", "_b", F.lit(0).alias("_part"), F.lit(0).alias("_side"), F.col("_before").alias("rep"))
         .unionByName(seeds.select("_k", "_b", F.lit(2).alias("_part"), F.lit(0).alias("_side"), F.col("_after").alias("rep")))
         .unionByName(r.select("_k", "_b", F.lit(1).alias("_part"), F.lit(1).alias("_side"), "rep", "_t"), allowMissingColumns=True)
         .unionByName(p.select("_k", "_b", F.lit(1).alias("_part"), F.lit(2).alias("_side"), "prb", "_t"), allowMissingColumns=True))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    fwd = Window.partitionBy("_k", "_b").orderBy("_part", "_t", "_side").rowsBetween(*so_far)
    back = Window.partitionBy("_k", "_b").orderBy(F.desc("_part"), F.desc("_t"), F.desc("_side")).rowsBetween(*so_far)
    out = u.withColumn("prev", F.last("rep", ignorenulls=True).over(fwd)).withColumn(
        "next", F.last("rep", ignorenulls=True).over(back)).filter("_side = 2")
    return out.select(*[F.col("prb." + c).alias(c) for c in probes.columns], "prev", "next")


def join_zone_forecast_nearest(probes: DataFrame, forecast: DataFrame, at_col: str = "at",
                               bucket_us: int = HOUR_US) -> DataFrame:
    """T4 for many (zone_id, at) probes: nearest forecast either side of ``at``."""
    j = _asof_both(probes, forecast_instants(forecast), "zone_id", _us(at_col), _us("recorded_at"), bucket_us)
    t = _us(at_col)
    dp = t - _us(F.col("prev.recorded_at"))
    dn = _us(F.col("next.recorded_at")) - t
    pick_prev = (F.col("next").isNull()
                 | (F.col("prev").isNotNull() & ((dp < dn) | ((dp == dn) & _beats(F.col("prev"), F.col("next"))))))
    return j.select(*probes.columns, F.when(pick_prev, F.col("prev")).otherwise(F.col("next")).alias("rep"))


# ------------------------------------------------------------------ validity intervals

def _next_start(rows: DataFrame, key: str, t_us: Column, rank: list[Column], bucket_us: int) -> DataFrame:
    """Add ``_to`` = the instant of the next row in (t, rank) order within the key.

    Computed per (key, bucket) with ``lead``; the last row of a bucket takes the first
    instant of the next non-empty bucket from a one-row-per-bucket summary.
    """
    r = rows.withColumn("_t", t_us).withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us)))
    w = Window.partitionBy(key, "_b").orderBy("_t", *rank)
    r = r.withColumn("_lead", F.lead("_t").over(w))
    firsts = r.groupBy(key, "_b").agg(F.min("_t").alias("_first"))
    wz = Window.partitionBy(key).orderBy("_b")
    nxt = firsts.select(key, "_b", F.lead("_first").over(wz).alias("_next_first"))
    return (r.join(nxt, [key, "_b"], "left")
             .withColumn("_to", F.coalesce(F.col("_lead"), F.col("_next_first")))
             .drop("_lead", "_next_first"))


def observed_intervals(observed: DataFrame, bucket_us: int = HOUR_US) -> DataFrame:
    """Each observed report holds from its instant until the zone's next report.

    Adds ``valid_from_us`` (inclusive) and ``valid_to_us`` (exclusive, null = open).
    Reports sharing an instant: only the smallest report_id gets a nonempty interval.
    """
    r = _next_start(observed, "zone_id", _us("recorded_at"), [F.col("report_id").desc()], bucket_us)
    return (r.withColumnRenamed("_t", "valid_from_us").withColumnRenamed("_to", "valid_to_us")
             .drop("_b"))


def forecast_intervals(forecast: DataFrame, bucket_us: int = HOUR_US) -> DataFrame:
    """Each per-instant winning forecast holds where it is the nearest one.

    Bounds are kept doubled (``lo2``/``hi2`` in microseconds x 2) so midpoints stay integral;
    ``lo_in``/``hi_in`` say whether a probe exactly on the midpoint belongs here.
    """
    inst = forecast_instants(forecast)
    w = Window.partitionBy("zone_id", "_b").orderBy("_t")
    r = inst.withColumn("_t", _us("recorded_at")).withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us)))
    info = F.struct(F.col("_t").alias("t"), F.col("ingested_at").alias("ingested_at"),
                    F.col("report_id").alias("report_id"))
    r = r.withColumn("_me", info).withColumn("_prev_in", F.lag("_me").over(w)).withColumn("_next_in", F.lead("_me").over(w))
    ends = r.groupBy("zone_id", "_b").agg(F.min_by("_me", "_t").alias("_first"), F.max_by("_me", "_t").alias("_last"))
    wz = Window.partitionBy("zone_id").orderBy("_b")
    nb = ends.select("zone_id", "_b", F.lag("_last").over(wz).alias("_prev_b"),
                     F.lead("_first").over(wz).alias("_next_b"))
    r = r.join(nb, ["zone_id", "_b"], "left")
    prev = F.coalesce(F.col("_prev_in"), F.col("_prev_b"))
    nxt = F.coalesce(F.col("_next_in"), F.col("_next_b"))
    me = F.col("_me")
    return (r.withColumn("lo2", prev["t"] + me["t"]).withColumn("lo_in", _beats(me, prev))
             .withColumn("hi2", me["t"] + nxt["t"]).withColumn("hi_in", _beats(me, nxt))
             .withColumn("valid_from_us", F.when(prev.isNull(), None).otherwise(F.floor((prev["t"] + me["t"]) / 2)))
             .withColumn("valid_to_us", F.when(nxt.isNull(), None).otherwise(F.floor((me["t"] + nxt["t"]) / 2) + 1))
             .drop("_t", "_b", "_me", "_prev_in", "_next_in", "_prev_b", "_next_b"))


def in_forecast_interval(t_us: Column) -> Column:
    """Probe instant ``t_us`` falls in a row of ``forecast_intervals``."""
    t2 = t_us * 2
    lo_ok = F.col("lo2").isNull() | (t2 > F.col("lo2")) | ((t2 == F.col("lo2")) & F.col("lo_in"))
    hi_ok = F.col("hi2").isNull() | (t2 < F.col("hi2")) | ((t2 == F.col("hi2")) & F.col("hi_in"))
    return lo_ok & hi_ok
