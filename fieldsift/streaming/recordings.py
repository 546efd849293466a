"""Trip recordings as a stream with state that ends, nearness to planned roads and page drift, each with a batch twin.

A report is (trip, seq, micros, lon, lat, accuracy, kind): kind is fix, note, sighting or stop. A trip's first report opens a
recording, named by its time; stop completes it, and silence longer than the gap interrupts it, with the last kept point as
its end. Nothing is invented for the silence. Reports without trip or time take no part, fixes without a place neither.

As a stream, state is one row a trip. It is dropped when the watermark passes the last report by the gap, so it doesn't grow
with the trips ever seen; reports later than the watermark are left out by Spark, reports of one micro-batch are taken in
time order, micro-batches as they come. The batch twin takes all reports in time order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldsift.functions import geo
from fieldsift.operators import lines
from fieldsift.streaming.tracks import decide, metres

#: Legs longer and faster than this are no part of a length; what counts as near without an accuracy.
JUMP_M, JUMP_M_S, NEAR_M = 1000.0, 100.0, 100.0
GAP = 6 * 3_600_000_000

TOTALS = "trip long, began long, finished long, status string, points long, metres double, skipped_legs long, poor_accuracy long, unchanged long, full long, notes long, sightings long"
#: began, last report, last kept lon, lat and time, then the counts of TOTALS.
STATE = "began long, seen long, lon double, lat double, at long, points long, metres double, skipped_legs long, poor_accuracy long, unchanged long, full long, notes long, sightings long"
_FIELDS = [x.split(" ")[0] for x in STATE.split(", ")]
_COUNTED = {"poor-accuracy": "poor_accuracy", "unchanged": "unchanged", "full": "full"}
_REPORT = ["seq", "micros", "lon", "lat", "accuracy", "kind"]


def _told(trip: int, s: dict, status: str, finished: int | None = None) -> tuple:
    end = finished if finished is not None else s["at"] if s["points"] else s["seen"]
    return (trip, s["began"], end, status, *(s[c] for c in _FIELDS[5:]))


def _take(trip: int, s: dict | None, report: tuple, gap: int) -> tuple[dict | None, list[tuple]]:
    """The state after one report, and the recordings that it ends."""
    _, micros, lon, lat, accuracy, kind = report
    micros = int(micros)
    ended = []
    if s is not None and micros - s["seen"] > gap:
        ended.append(_told(trip, s, "INTERRUPTED"))
        s = None
    if kind == "stop":
        if s is not None:
            ended.append(_told(trip, s, "COMPLETED", micros))
        return None, ended
    if s is None:
        s = dict.fromkeys(_FIELDS, 0) | {"began": micros, "seen": micros, "lon": 0.0, "lat": 0.0, "metres": 0.0}
    s["seen"] = max(s["seen"], micros)
    if kind in ("note", "sighting"):
        s[f"{kind}s"] += 1
        return s, ended
    if not (lon is not None and lat is not None and abs(lat) <= 90 and abs(lon) <= 180):
        return s, ended
    last = (s["lon"], s["lat"], s["at"], s["points"]) if s["points"] else None
    kept, reason = decide(last, lon, lat, micros, accuracy)
    if reason in _COUNTED:
        s[_COUNTED[reason]] += 1
        return s, ended
    if last is not None:
        leg, seconds = metres(last[0], last[1], lon, lat), (micros - last[2]) / 1e6
        if leg > JUMP_M and (seconds <= 0 or leg / seconds > JUMP_M_S):
            s["skipped_legs"] += 1
        else:
            s["metres"] += leg
    s["lon"], s["lat"], s["at"], s["points"] = kept
    return s, ended


def _usable(reports: DataFrame) -> DataFrame:
    return reports.where("trip is not null and micros is not null")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in TOTALS.split(", ")])


def recordings(reports: DataFrame, until: int, gap: int = GAP) -> DataFrame:
    """TOTALS of every recording, as they stand at the time until. Trips are folded over Arrow batches; none is held whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trip, s = None, None

        def last() -> list[tuple]:
            return [] if s is None else [_told(trip, s, "INTERRUPTED" if until - s["seen"] > gap else "RECORDING")]

        for batch in batches:
            out = []
            for t, *report in batch[["trip", *_REPORT]].astype(object).where(batch[["trip", *_REPORT]].notna(), None).itertuples(index=False, name=None):
                if t != trip:
                    out += last()
                    trip, s = t, None
                s, ended = _take(trip, s, tuple(report), gap)
                out += ended
            yield _frame(out)
        yield _frame(last())

    return _usable(reports).repartition("trip").sortWithinPartitions("trip", "micros", "seq").mapInPandas(run, TOTALS)


def recording_stream(reports: DataFrame, late: str = "10 minutes", gap: int = GAP) -> DataFrame:
    """Running TOTALS in update mode: a row for each trip that reported, and a last one for each recording that ended."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(_FIELDS, state.get)) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield _frame([_told(key[0], s, "INTERRUPTED")])
            return
        rows = pd.concat(list(batches)).sort_values(["micros", "seq"])[_REPORT]  # one trip's reports of one micro-batch
        out = []
        for report in rows.astype(object).where(rows.notna(), None).itertuples(index=False, name=None):
            s, ended = _take(key[0], s, report, gap)
            out += ended
        ends = None if s is None else (s["seen"] + gap) // 1000 + 1
        if ends is not None and ends <= state.getCurrentWatermarkMs():
            out.append(_told(key[0], s, "INTERRUPTED"))
            s = None
        if s is None:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(type(x)(s[c]) for c, x in zip(_FIELDS, [0, 0, 0.0, 0.0, 0, 0, 0.0, 0, 0, 0, 0, 0, 0])))
            state.setTimeoutTimestamp(ends)
            out.append(_told(key[0], s, "RECORDING"))
        yield _frame(out)

    timed = _usable(reports).withColumn("told", F.timestamp_micros("micros")).withWatermark("told", late)
    return timed.groupBy("trip").applyInPandasWithState(run, TOTALS, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def plan_members(segments: DataFrame, members: DataFrame) -> DataFrame:
    """trip, members: the roads of each plan with their legs. segments: road, ax, ay, bx, by; members: trip, road, rep_lon, rep_lat."""
    legs = segments.groupBy("road").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("legs"))  # a road's own geometry
    held = members.join(legs, "road", "left")
    return held.groupBy("trip").agg(F.collect_list(F.struct("road", "legs", "rep_lon", "rep_lat")).alias("members"))  # a plan is short


def near_roads(fixes: DataFrame, plans: DataFrame) -> DataFrame:
    """fixes (trip, lon, lat, accuracy, ...) with near_id, metres, shown_metres, basis and near of the nearest road of their plan.

    A road is measured to its line (basis road-geometry), or without one to its representative point; roads with neither
    take no part, and ties go to the smaller road. What is shown is rounded to steps of the accuracy, ten metres at least.
    plans comes from plan_members; the join is stateless, so a stream of fixes runs without state.
    """
    lon, lat = F.col("lon"), F.col("lat")

    def to_line(s: Column) -> Column:
        t, _ = lines.foot(lon, lat, s["ax"], s["ay"], s["bx"], s["by"])
        return geo.haversine(lon, lat, s["ax"] + (s["bx"] - s["ax"]) * t, s["ay"] + (s["by"] - s["ay"]) * t)

    def measured(m: Column) -> Column:
        on_road = F.array_min(F.transform(m["legs"], to_line))
        away = geo.haversine(lon, lat, m["rep_lon"], m["rep_lat"])
        basis = F.when(on_road.isNotNull(), "road-geometry").when(away.isNotNull(), "representative-point")
        return F.struct(F.coalesce(on_road, away).alias("metres"), m["road"].alias("road"), basis.alias("basis"))

    best = F.array_min(F.filter(F.transform("members", measured), lambda x: x["metres"].isNotNull()))
    told = fixes.join(plans, "trip", "left").withColumn("_best", best).drop("members")
    step = F.when(F.col("accuracy") > 0, F.greatest("accuracy", F.lit(10.0)))
    metres_ = F.col("_best.metres")
    shown = F.when(step.isNull(), metres_).otherwise(F.greatest(step, F.floor(metres_ / step + 0.5) * step))
    near = metres_ <= F.when(F.col("accuracy") > 0, F.col("accuracy")).otherwise(NEAR_M)
    return told.withColumns({"near_id": F.col("_best.road"), "metres": metres_, "shown_metres": F.when(metres_.isNotNull(), shown), "basis": F.col("_best.basis"), "near": F.coalesce(near, F.lit(False))}).drop("_best")


#: Outcomes of a fetch that say nothing about the source's facts.
UNREAD = ["FAILED", "OPERATOR_ONLY", "NOT_RUN"]


def _instant(text: Column) -> Column:
    """A date as an instant, whatever its spelling; other texts as they are, empty ones as null."""
    said = F.nullif(text, F.lit(""))
    return F.coalesce(F.unix_micros(F.try_to_timestamp(said)).cast("string"), said)


def signature(facts: Column) -> Column:
    """The sorted fact keys of an array of facts (claim, quote, value, starts, ends, recurrence, part): NUL between fields, \\u0001 for null."""
    fields = ("claim", "quote", "value", "starts", "ends", "recurrence", "part")

    def key(f: Column) -> Column:
        said = [F.coalesce(_instant(f[c]) if c in ("starts", "ends") else f[c], F.lit("\u0001")) for c in fields]
        return F.concat_ws("\0", *said)

    return F.array_sort(F.transform(F.coalesce(facts, F.array().cast(_FACTS)), key))


_FACTS = "array<struct<claim: string, quote: string, value: string, starts: string, ends: string, recurrence: string, part: string>>"


def page_drift(fetched: DataFrame, baseline: DataFrame) -> DataFrame:
    """fetched (source, outcome, facts, ...) with state, digest, added and removed against the reviewed baseline (source, facts).

    One row in, one row out and no state, so fetches may be a stream. A page's facts are the phrases declared for it, few.
    """
    base = baseline.select("source", F.coalesce("facts", F.array().cast(_FACTS)).alias("_was"), F.lit(True).alias("_known"))
    rows = fetched.join(base, "source", "left").withColumn("facts", F.coalesce("facts", F.array().cast(_FACTS)))
    now, was = signature(F.col("facts")), signature(F.col("_was"))
    quotes = lambda c: F.transform(c, lambda f: F.coalesce(f["quote"], F.lit("\u0001")))
    others = lambda c, than: F.size(F.filter(quotes(F.col(c)), lambda q: ~F.array_contains(quotes(F.col(than)), q))).cast("long")
    state = (
        F.when(F.col("_known").isNull(), "NO_BASELINE").when(F.col("outcome").isin(UNREAD), "SOURCE_UNAVAILABLE").when(now == was, "UNCHANGED")
        .when(F.size("facts") == 0, "NO_LONGER_MATCHES").otherwise("EVIDENCE_CHANGED")
    )
    rows = rows.withColumn("state", state)
    none = F.lit(0).cast("long")
    judged = F.col("state").isin("NO_LONGER_MATCHES", "EVIDENCE_CHANGED")
    return rows.withColumns(
        {
            "digest": F.when(F.col("state") != "SOURCE_UNAVAILABLE", F.sha2(F.concat_ws("\n", now), 256)),
            "added": F.when(F.col("state") == "NO_BASELINE", F.size("facts").cast("long")).when(judged, others("facts", "_was")).otherwise(none),
            "removed": F.when(judged, others("_was", "facts")).otherwise(none),
        }
    ).drop("_was", "_known", "facts")
