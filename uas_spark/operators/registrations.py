"""Drone registrations: overlap, sequential acceptance, as-of lookup.

Dates are days, so what a serial's many registrations come to is summed up per (serial, date)
first, in aggregates that split a hot serial; what is then sorted or folded per serial has a few
rows a calendar day at most, however many registrations or probes the serial has.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .folds import ordered_fold


def registration_overlap(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Per candidate, the id of a stored registration of the same serial, other than the
    candidate itself, whose closed date range overlaps (touching dates overlap); null if there
    is none. Of several, the one that ends last, then the largest id.

    Candidates need registration_id, serial_number, start_date and end_date; adds
    ``overlapping_id``.
    """
    cols = ["registration_id", "serial_number", "start_date", "end_date"]
    key = candidates.withColumn("_pk", F.xxhash64(*cols))  # equal candidates share their answer
    hit = other_overlaps(key.select("_pk", *cols).distinct(), stored)
    return key.join(hit, "_pk", "left").drop("_pk")


def self_overlap(registrations: DataFrame) -> DataFrame:
    """M13 over a whole stored table: does each registration overlap (closed ranges, touching
    dates overlap) one of the same serial with another id? Adds boolean ``overlap``."""
    out = registration_overlap(registrations, registrations)
    return out.withColumn("overlap", F.col("overlapping_id").isNotNull()).drop("overlapping_id")


_RANGE = ["serial_number", "start_date", "end_date"]
_NEVER = -1 << 62


def sequential_accept(requests: DataFrame, owners: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Registrations judged one after the other in ``arrival`` order; a rejected request
    never blocks a later one. Check order: owner, overlap, duplicate id. An id is a global key:
    it conflicts with stored ids and with any earlier accepted request, of any serial.

    Requests whose owner is unknown change nothing. Ids that several requests give are settled in
    rounds: a request whose id an earlier request took in the last round counts as one with a
    stored id. Every decision depends on earlier arrivals only, so each round settles at least
    the next of these requests, and the rounds end when nothing changes, however many it takes. Without an id that
    occurs twice there is one round. Returns (registration_id, serial_number, arrival, outcome).
    """
    r = requests.join(owners.select(F.col("owner_id").alias("_oid")).distinct(),
                      F.col("owner_id") == F.col("_oid"), "left")
    r = r.select("registration_id", *_RANGE, F.col("arrival").cast("bigint").alias("arrival"),
                 F.col("_oid").isNotNull().alias("owner_ok"))
    no_owner = r.filter(~F.col("owner_ok")).select("registration_id", "serial_number", "arrival",
                                                   F.lit("owner_not_found").alias("outcome"))
    r = r.filter("owner_ok").drop("owner_ok")
    ranges = r.filter("false").select(*_RANGE)
    if stored is not None:
        known = stored.select(F.col("registration_id").alias("_sid")).distinct()
        r = r.join(known, F.col("registration_id") == F.col("_sid"), "left") \
             .withColumn("stored_id", F.col("_sid").isNotNull()).drop("_sid")
        ranges = stored.select(*_RANGE).distinct()
    else:
        r = r.withColumn("stored_id", F.lit(False))
    r = cut_lineage(r)
    twice = r.groupBy("registration_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("registration_id")
    if twice.isEmpty():
        return _accept_round(r.withColumnRenamed("stored_id", "gone"), ranges).unionByName(no_owner)
    twice = cut_lineage(twice)
    taken = r.filter("false").select("registration_id", "arrival")
    while True:
        gone = taken.withColumn("_taken", F.lit(True))
        out = cut_lineage(_accept_round(
            r.join(gone, ["registration_id", "arrival"], "left")
             .withColumn("gone", F.col("stored_id") | F.col("_taken").isNotNull()).drop("_taken", "stored_id"), ranges))
        first = (out.filter("outcome = 'accepted'").join(twice, "registration_id", "left_semi")
                 .groupBy("registration_id").agg(F.min("arrival").alias("_first")))
        late = cut_lineage(r.join(first, "registration_id").filter(F.col("arrival") > F.col("_first"))
                           .select("registration_id", "arrival").distinct())
        if late.exceptAll(taken).isEmpty() and taken.exceptAll(late).isEmpty():
            return out.unionByName(no_owner)
        taken = late


def _accept_round(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """One round of M14: registration_id, serial_number, start_date, end_date, arrival, gone.

    Most requests are settled without the fold. Of equal ranges only the first to arrive can be
    accepted; and one that holds the whole range of an earlier request can't: if that one was accepted they
    overlap, if not, they overlap what it overlapped. So per serial and start date only requests
    shorter than all earlier ones are left: for one serial a few per calendar day, however many
    requests it has. Both steps are aggregates over (serial, start date). The rest are folded per
    serial in arrival order against the accepted ranges, which are disjoint and found by bisection.
    A gone request (its id is taken) is never accepted; it is an overlap if its range met an
    accepted one by its arrival.
    """
    clean = requests.filter(~F.col("gone"))
    proper = F.col("start_date") <= F.col("end_date")
    first = clean.filter(proper).groupBy(*_RANGE).agg(F.min(F.struct("arrival", "registration_id")).alias("k"))
    shorter = Window.partitionBy("serial_number", "start_date").orderBy("end_date").rowsBetween(
        Window.unboundedPreceding, -1)
    left = first.withColumn("_k", F.min("k").over(shorter)).filter(F.col("_k").isNull() | (F.col("k") < F.col("_k")))
    left = left.select(*_RANGE, "k.arrival", "k.registration_id").unionByName(
        clean.filter(~proper).select(*_RANGE, "arrival", "registration_id"))
    rows = (left.withColumn("kind", F.lit(1))
            .unionByName(stored.withColumn("kind", F.lit(0)), allowMissingColumns=True)
            .unionByName(requests.filter("gone").select(*_RANGE).distinct().withColumn("kind", F.lit(2)),
                         allowMissingColumns=True))
    rows = rows.select("serial_number", F.unix_date("start_date").alias("s"), F.unix_date("end_date").alias("e"),
                       "kind", "arrival", "registration_id")

    class Taken:
        """Disjoint accepted ranges by start, when each came, and those that end before they start."""

        def __init__(self) -> None:
            self.s: list[int] = []
            self.e: list[int] = []
            self.by: list[tuple] = []
            self.odd: list[tuple] = []
            self.asked: list[tuple] = []

        def meets(self, s: int, e: int) -> bool:
            i = bisect_right(self.s, e)
            return (i > 0 and self.e[i - 1] >= s) or any(a <= e and s <= b for a, b, _ in self.odd)

        def add(self, s: int, e: int, by: tuple) -> None:
            if s > e:
                self.odd.append((s, e, by))
                return
            lo, hi = bisect_right(self.e, s - 1), bisect_right(self.s, e)
            if lo < hi:  # stored ranges may overlap one another: they become one
                s, e = min(s, self.s[lo]), max(e, self.e[hi - 1])
            self.s[lo:hi], self.e[lo:hi], self.by[lo:hi] = [s], [e], [by]

        def since(self, s: int, e: int) -> tuple | None:
            met = [*self.by[bisect_right(self.e, s - 1):bisect_right(self.s, e)], *(k for a, b, k in self.odd if a <= e and s <= b)]
            return min(met, default=None)

    def step(taken: Taken, row: tuple) -> Iterator[tuple]:
        serial, s, e, kind, arrival, rid = row
        if kind == 0:
            taken.add(s, e, (_NEVER, ""))
        elif kind == 2:
            taken.asked.append((serial, s, e))
        elif not taken.meets(s, e):
            taken.add(s, e, (arrival, rid))
            yield serial, s, e, 1, arrival, rid

    def end(taken: Taken) -> Iterator[tuple]:
        for serial, s, e in taken.asked:
            by = taken.since(s, e)
            if by is not None:
                yield serial, s, e, 2, *by

    done = cut_lineage(ordered_fold(rows, ["serial_number"], ["kind", "arrival", "registration_id", "s", "e"],
                                    "serial_number string, s int, e int, kind int, arrival bigint, registration_id string",
                                    lambda row: Taken(), step, end))
    done = done.select("serial_number", F.date_from_unix_date("s").alias("start_date"),
                       F.date_from_unix_date("e").alias("end_date"), "kind", "arrival", "registration_id")
    won = done.filter("kind = 1").drop("kind").withColumn("_won", F.lit(True))
    out = clean.join(won, [*_RANGE, "arrival", "registration_id"], "left").select(
        "registration_id", "serial_number", "arrival",
        F.when(F.col("_won"), "accepted").otherwise("registration_overlap").alias("outcome"))
    met = done.filter("kind = 2").select(*_RANGE, F.struct("arrival", "registration_id").alias("_since"))
    lost = requests.filter("gone").join(met, _RANGE, "left").select(
        "registration_id", "serial_number", "arrival",
        F.when(F.struct("arrival", "registration_id") > F.col("_since"), "registration_overlap")
         .otherwise("duplicate_id").alias("outcome"))
    return out.unionByName(lost)


def other_overlaps(ranges: DataFrame, stored: DataFrame, key: str = "_pk") -> DataFrame:
    """(key, overlapping_id) of the ranges that overlap a stored range of the same serial with another id.

    ``ranges``: key, registration_id, serial_number, start_date, end_date. No pairs: some other
    registration starts by the range's end and ends on or after its start exactly if the largest
    end among the others that start by then reaches the start. Each (serial, start date) yields its
    two largest ends with their ids, limited before the shuffle; a running maximum over a serial's
    dates, at most one row a calendar day, carries the two largest so far. A serial with many
    registrations is thus spread over its dates.
    """
    x = F.struct("end_date", "registration_id")
    top = Window.partitionBy("serial_number", "start_date").orderBy(F.desc("end_date"), F.desc("registration_id"))
    best = stored.select("serial_number", "start_date", "end_date", "registration_id").withColumn(
        "_rn", F.row_number().over(top)).filter("_rn <= 2")
    days = best.groupBy("serial_number", F.col("start_date").alias("_day")).agg(
        F.max(F.when(F.col("_rn") == 1, x)).alias("_x1"), F.max(F.when(F.col("_rn") == 2, x)).alias("_x2"))
    asked = ranges.select("serial_number", F.col("end_date").alias("_day")).distinct()
    days = days.join(asked, ["serial_number", "_day"], "full")
    w = Window.partitionBy("serial_number").orderBy("_day")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.max("_x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # greatest() and least() skip nulls: a date's largest end stands second only beside an earlier one
    second = F.greatest(F.col("_x2"), F.when(F.col("_x1").isNotNull() & before.isNotNull(), F.least(F.col("_x1"), before)))
    days = days.withColumn("_low", second).select("serial_number", "_day", F.max("_x1").over(upto).alias("_m1"),
                                                  F.max("_low").over(upto).alias("_m2"))
    c = ranges.select(key, "serial_number", F.col("end_date").alias("_day"), F.col("start_date").alias("_from"),
                      F.col("registration_id").alias("_self"))
    other = F.when(F.col("_m1.registration_id") == F.col("_self"), F.col("_m2")).otherwise(F.col("_m1"))
    return (c.join(days, ["serial_number", "_day"]).withColumn("_best", other)
            .filter(F.col("_best.end_date") >= F.col("_from"))
            .select(key, F.col("_best.registration_id").alias("overlapping_id")))


def _hull_clusters(rows: DataFrame) -> DataFrame:
    """``rows`` (serial_number, _lo, _hi) with ``_cluster``: hulls in different clusters of a serial never meet.

    One row per serial and first date carries the largest last date; a cluster begins where the
    date passes the running maximum. At most one row a calendar day and serial is sorted.
    """
    days = rows.groupBy("serial_number", "_lo").agg(F.max("_hi").alias("_hi"))
    w = Window.partitionBy("serial_number").orderBy("_lo")
    before = F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumn("_new", F.when(before.isNull() | (F.col("_lo") > before), 1).otherwise(0))
    days = days.select("serial_number", "_lo", F.sum("_new").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_cluster"))
    return rows.join(days, ["serial_number", "_lo"])


def registration_patch_overlap(stored: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches judged one after the other, per serial in ``seq`` order (then by id). A patch that gives a
    date re-runs M13 for its merged range against the other registrations of the serial as the
    patches before it left them; one without a date never overlaps. Absent fields keep their value;
    owner and serial are immutable. Adds ``outcome``: 'not_found', 'registration_overlap',
    'end_before_start' (which the table's own constraint finds after the overlap check) or
    'accepted'; and ``serial_number``.

    A registration can only take dates that it has or that a patch gives it. Those span its hull;
    registrations are folded together only where hulls meet, and only where a patch gives a date.
    """
    base = stored.select("registration_id", "serial_number", F.col("start_date").alias("_s0"), F.col("end_date").alias("_e0"))
    patches = cut_lineage(patches)  # read three times
    p = patches.join(base.select("registration_id", "serial_number"), "registration_id", "left")
    p = p.withColumn("_dated", F.col("serial_number").isNotNull()
                     & (F.col("start_date").isNotNull() | F.col("end_date").isNotNull()))
    given = patches.groupBy("registration_id").agg(F.min("start_date").alias("_ps"), F.max("end_date").alias("_pe"),
                                                   F.count(F.coalesce("start_date", "end_date")).alias("_n"))
    hull = base.join(given, "registration_id", "left")
    hull = hull.select("registration_id", "serial_number", "_s0", "_e0", F.least("_s0", "_e0", "_ps").alias("_lo"),
                       F.greatest("_e0", "_s0", "_pe").alias("_hi"), (F.coalesce("_n", F.lit(0)) > 0).alias("_patched"))
    hull = cut_lineage(_hull_clusters(hull))
    live = hull.filter("_patched").select("serial_number", "_cluster").distinct()
    hull = hull.join(live, ["serial_number", "_cluster"], "left_semi")
    one = hull.select("serial_number", "_cluster", "registration_id", F.lit(None).cast("long").alias("seq"),
                      F.unix_date("_s0").alias("s"), F.unix_date("_e0").alias("e"))
    many = (p.filter("_dated").select("registration_id", F.col("seq").cast("long").alias("seq"),
                                      F.unix_date("start_date").alias("s"), F.unix_date("end_date").alias("e"))
            .join(hull.select("registration_id", "serial_number", "_cluster"), "registration_id"))
    rows = one.unionByName(many).select("serial_number", "_cluster", "registration_id", "seq", "s", "e")

    class Ranges:
        """Current ranges of a cluster, by place; arrays beside the lists once the first patch comes."""

        def __init__(self) -> None:
            self.at: dict[str, int] = {}
            self.s: list[int] = []
            self.e: list[int] = []
            self.now: tuple[np.ndarray, np.ndarray] | None = None

        def patch(self, rid: str, s: int | None, e: int | None) -> str:
            if self.now is None:
                self.now = np.array(self.s, np.int64), np.array(self.e, np.int64)
            (first, last), i = self.now, self.at[rid]
            s0, e0 = self.s[i], self.e[i]
            s, e = s0 if s is None else s, e0 if e is None else e
            if np.count_nonzero((first <= e) & (last >= s)) > (s0 <= e and e0 >= s):  # others than its own
                return "registration_overlap"
            if e < s:
                return "end_before_start"
            self.s[i], self.e[i] = first[i], last[i] = s, e
            return "accepted"

    def step(ranges: Ranges, row: tuple) -> Iterator[tuple]:
        _, _, rid, seq, s, e = row
        if seq is None:
            ranges.at[rid] = len(ranges.s)
            ranges.s.append(s)
            ranges.e.append(e)
        else:
            yield rid, seq, ranges.patch(rid, s, e)

    judged = ordered_fold(rows, ["serial_number", "_cluster"], [F.col("seq").asc_nulls_first(), "registration_id"],
                          "registration_id string, _seq bigint, _outcome string", lambda row: Ranges(), step)
    p = p.join(judged, (p["registration_id"] == judged["registration_id"]) & (p["seq"] == judged["_seq"])
               & p["_dated"], "left").drop(judged["registration_id"])
    outcome = F.when(F.col("serial_number").isNull(), "not_found").otherwise(F.coalesce("_outcome", F.lit("accepted")))
    return p.withColumn("outcome", outcome).drop("_seq", "_outcome", "_dated")


def _stretches(registrations: DataFrame) -> DataFrame:
    """Each serial's ranges cut into disjoint stretches of days, each owned by the covering registration
    of newest start, then smallest id: (serial, _from, _to, rep).

    Of ranges with one start only those are left that outlast all of smaller id. The rest are
    swept by start with a stack: a range stands on those it interrupts, which go on after it.
    """
    r = registrations.filter(F.col("start_date") <= F.col("end_date")).select(
        F.col("serial_number").alias("serial"), F.unix_date("start_date").alias("s"), F.unix_date("end_date").alias("e"),
        "registration_id", "owner_id")
    smaller = Window.partitionBy("serial", "s").orderBy("registration_id").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_e", F.max("e").over(smaller)).filter("_e IS NULL OR e > _e").drop("_e")

    class Sweep:
        def __init__(self) -> None:
            self.stack: list[tuple] = []
            self.at = 0

        def upto(self, day: int | None) -> Iterator[tuple]:
            """Stretches that end before ``day`` (all, if none is given)."""
            while self.stack:
                serial, s, e, rid, owner = self.stack[-1]
                last = e if day is None or e < day else day - 1
                if last >= self.at:
                    yield serial, self.at, last, rid, owner, s, e
                    self.at = last + 1
                if day is not None and e >= day:
                    return
                self.stack.pop()

        def push(self, row: tuple) -> Iterator[tuple]:
            yield from self.upto(row[1])
            self.at = row[1]
            self.stack.append(row)

    out = ordered_fold(r, ["serial"], ["s", F.desc("registration_id")],
                       "serial string, f int, t int, registration_id string, owner_id string, s int, e int",
                       lambda row: Sweep(), Sweep.push, lambda sweep: sweep.upto(None))
    return out.select("serial", F.date_from_unix_date("f").alias("_day"), F.struct(
        F.date_from_unix_date("t").alias("last"), "registration_id", "owner_id",
        F.date_from_unix_date("s").alias("start_date"), F.date_from_unix_date("e").alias("end_date")).alias("rep"))


def active_registration(registrations: DataFrame, probes: DataFrame, serial_col: str = "serial_number",
                        date_col: str = "date", probe_key: str = "probe_id") -> DataFrame:
    """Per probe (serial, date) the registration whose closed range covers the date;
    the newest start wins, then the smallest registration_id. Probes without one are kept
    with null registration columns (``r_*``).

    The distinct (serial, date) of the probes are looked up in the serial's stretches by one sort
    per serial, a few rows a calendar day; each probe then meets exactly one row, in one shuffle.
    """
    st = _stretches(registrations)
    asked = probes.select(F.col(serial_col).alias("serial"), F.col(date_col).alias("_day")).distinct()
    rows = asked.withColumn("_kind", F.lit(1)).unionByName(st.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("serial").orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("rep", F.last("rep", ignorenulls=True).over(w)).filter("_kind = 1")
    hit = F.when(F.col("rep.last") >= F.col("_day"), F.col("rep"))
    found = rows.select("serial", "_day", hit.alias("rep"))
    out = probes.join(found, (F.col(serial_col) == F.col("serial")) & (F.col(date_col) == F.col("_day")), "left")
    return out.select(*probes.columns, *[F.col(f"rep.{c}").alias(f"r_{c}")
                                         for c in ("registration_id", "owner_id", "start_date", "end_date")])


def list_registrations(registrations: DataFrame, serial: str | None = None, owner: str | None = None,
                       as_of: str | None = None) -> DataFrame:
    """optional serial AND owner AND active-as-of filters, oldest first. A filter is added
    only when given."""
    r = registrations
    if serial is not None:
        r = r.filter(F.col("serial_number") == serial)
    if owner is not None:
        r = r.filter(F.col("owner_id") == owner)
    if as_of is not None:
        d = F.to_date(F.lit(as_of))
        r = r.filter((F.col("start_date") <= d) & (F.col("end_date") >= d))
    return r.orderBy("created_at", "registration_id")


def owner_registrations(owners: DataFrame, registrations: DataFrame, owner_probes: DataFrame,
                        as_of: str | None = None) -> DataFrame:
    """per probed owner id, its registrations (optionally those active at ``as_of``);
    ``owner_found`` tells an unknown owner from an owner with none."""
    r = registrations
    if as_of is not None:
        d = F.to_date(F.lit(as_of))
        r = r.filter((F.col("start_date") <= d) & (F.col("end_date") >= d))
    o = owner_probes.join(owners.select(F.col("owner_id").alias("_oid")).distinct(),
                          F.col("owner_id") == F.col("_oid"), "left")
    o = o.withColumn("owner_found", F.col("_oid").isNotNull()).drop("_oid")
    r = r.select(F.col("owner_id").alias("_rowner"), "registration_id", "serial_number", "start_date", "end_date")
    return o.join(r, F.col("owner_found") & (F.col("owner_id") == F.col("_rowner")), "left").drop("_rowner")
