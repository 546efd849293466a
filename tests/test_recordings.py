"""Recording, proximity and drift streams over three micro-batches against their batch twins; state is gone at the end."""

import pytest
from pyspark.sql import functions as F

from fieldsift import stream_queries
from fieldsift.functions import names
from fieldsift.operators import access
from fieldsift.streaming import recordings as rec

SF = "/root/testdata/sf0.001"
REPORT = "trip long, seq long, micros long, lon double, lat double, accuracy double, kind string"
HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def in_files(spark, tmp_path_factory):
    """A DataFrame as a stream of files, one a micro-batch."""

    def make(parts):
        path = str(tmp_path_factory.mktemp("stream"))
        for k, part in enumerate(parts):
            part.coalesce(1).write.parquet(f"{path}/p{k}")
        return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)

    return make


def thirds(rows, column):
    a, b = rows.approxQuantile(column, [0.33, 0.66], 0)
    c = F.col(column)
    return [rows.where(c < a), rows.where((c >= a) & (c < b)), rows.where(c >= b)]


def drain(stream, tmp_path, mode):
    """Rows of the sink, a later one in place of an earlier one of its key, and rows of state left at the end."""
    held = {}

    def each(batch, number):
        for r in batch.collect():
            held[(r["trip"], r["began"])] = r

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(each).start()
    assert query.awaitTermination(200)
    assert sum(1 for p in query.recentProgress if p["numInputRows"]) >= 3
    return held, query.lastProgress["stateOperators"][0]["numRowsTotal"]


@pytest.mark.parametrize("gap", [HOUR, 40 * 24 * HOUR])
def test_recordings_stream_equals_batch_and_state_ends(spark, in_files, tmp_path, gap):
    rows = stream_queries.reports(spark, SF).select(*(x.split(" ")[0] for x in REPORT.split(", ")))
    last = rows.agg(F.max("micros")).first()[0]
    later = last + gap + 2 * HOUR
    closing = spark.createDataFrame([(-1, 0, later, 0.0, 0.0, None, "fix")], REPORT)  # moves the watermark past all silence
    held, left = drain(rec.recording_stream(in_files([*thirds(rows, "micros"), closing]), "10 minutes", gap), tmp_path, "update")
    want = {(r.trip, r.began): r for r in rec.recordings(rows, later, gap).collect()}
    assert left == 1 and held.pop((-1, later)).status == "RECORDING"
    assert {k: tuple(r) for k, r in held.items()} == {k: tuple(r) for k, r in want.items()}
    assert {r.status for r in want.values()} == {"INTERRUPTED", "COMPLETED"}


def test_recording_edges(spark):
    rows = [
        (1, 1, 0, 0.0, 0.0, None, "fix"), (1, 2, 10, 0.01, 0.0, None, "note"), (1, 3, 60_000_000, 0.01, 0.0, 5.0, "fix"), (1, 4, 61_000_000, 1.0, 0.0, None, "fix"), (1, 5, 62_000_000, 1.0, 0.0, 900.0, "fix"),
        (1, 6, 70_000_000, None, None, None, "stop"), (1, 7, 71_000_000, 5.0, 5.0, None, "fix"), (2, 8, 0, 0.0, 95.0, None, "fix"), (2, 9, 5, 0.0, 0.0, None, "sighting"), (3, 1, 9, None, None, None, "stop"),
        (None, 1, 0, 0.0, 0.0, None, "fix"), (4, 1, None, 0.0, 0.0, None, "fix"), (5, 1, 0, 0.0, 0.0, None, "fix"), (5, 2, 7 * HOUR, 0.0, 0.0, None, "fix"),
    ]
    got = {(r.trip, r.began): r for r in rec.recordings(spark.createDataFrame(rows, REPORT), 7 * HOUR).collect()}
    assert set(got) == {(1, 0), (1, 71_000_000), (2, 0), (5, 0), (5, 7 * HOUR)}
    first = got[1, 0]
    assert (first.status, first.finished, first.points, first.skipped_legs, first.poor_accuracy, first.notes) == ("COMPLETED", 70_000_000, 3, 1, 1, 1) and 1100 < first.metres < 1120
    assert (got[2, 0].points, got[2, 0].sightings, got[2, 0].finished, got[2, 0].status) == (0, 1, 5, "INTERRUPTED")
    assert (got[5, 0].status, got[5, 0].finished, got[5, 7 * HOUR].status) == ("INTERRUPTED", 0, "RECORDING")
    assert rec.recordings(spark.createDataFrame([], REPORT), 0).collect() == []


def test_proximity_stream_equals_batch(spark, in_files, tmp_path):
    plans = rec.plan_members(
        spark.createDataFrame([(1, 0.0, 0.0, 0.01, 0.0), (1, 0.01, 0.0, 0.01, 0.01), (4, 0.0, 0.0, 0.0, 0.0)], "road long, ax double, ay double, bx double, by double"),
        spark.createDataFrame([(7, 1, None, None), (7, 2, 0.02, 0.0), (7, 3, None, 1.0), (8, 3, None, None), (9, 4, 1.0, 1.0)], "trip long, road long, rep_lon double, rep_lat double"),
    )
    rows = [(n, trip, lon, 0.0005, acc) for n, (trip, lon, acc) in enumerate([(7, 0.005, None), (7, 0.005, 30.0), (7, 0.0199, 5.0), (8, 0.0, None), (9, 0.0, 200.0), (99, 0.0, None), (7, 0.012, -1.0)])]
    fixes = spark.createDataFrame(rows, "fix long, trip long, lon double, lat double, accuracy double")
    want = {r.fix: tuple(r) for r in rec.near_roads(fixes, plans).collect()}
    got = {}
    stream = rec.near_roads(in_files(thirds(fixes, "fix")), plans)
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).foreachBatch(lambda b, n: got.update({r.fix: tuple(r) for r in b.collect()})).start()
    assert query.awaitTermination(100) and got == want
    told = {r.fix: (r.near_id, r.basis, r.near, None if r.shown_metres is None else round(r.shown_metres)) for r in rec.near_roads(fixes, plans).collect()}
    assert told == {0: (1, "road-geometry", True, 56), 1: (1, "road-geometry", False, 60), 2: (2, "representative-point", False, 60), 3: (None, None, False, None), 4: (4, "road-geometry", True, 200), 5: (None, None, False, None), 6: (1, "road-geometry", False, told[6][3])}


def test_drift_stream_equals_batch(spark, in_files, tmp_path):
    fetched, baseline = stream_queries.page_sides(spark, SF)
    want = {r.source: tuple(r) for r in rec.page_drift(fetched, baseline).collect()}
    held = fetched.withColumn("source", F.col("source").cast("long"))
    got = {}
    stream = rec.page_drift(in_files(thirds(held, "source")), baseline)
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).foreachBatch(lambda b, n: got.update({r.source: tuple(r) for r in b.collect()})).start()
    assert query.awaitTermination(100) and got == want and len({r[2] for r in want.values()}) >= 4


def test_signatures(spark):
    fact = lambda quote, starts, value=None: ("CLOSED", quote, value, starts, None, None, None)
    rows = [("a", [fact("x", "2026-10-07"), fact("y", "")]), ("b", [fact("y", None), fact("x", "2026-10-07T00:00:00Z")]), ("c", [fact("x", "soon"), fact("y", None)]), ("d", [fact("x", "2026-10-07")]), ("e", None), ("f", [fact("x\0", "2026-10-07", "v"), fact("y", None)])]
    df = spark.createDataFrame(rows, f"source string, facts {rec._FACTS}")
    keys = {r.source: r.s for r in df.select("source", rec.signature(F.col("facts")).alias("s")).collect()}
    assert keys["a"] == keys["b"] and len({tuple(k) for k in keys.values()}) == 5 and keys["e"] == []


def test_road_names(spark):
    pairs = {
        ("Oak Road", "Elm Road"): "DIFFERENT", ("NW Cornelius Pass Rd", "Northwest Cornelius Pass Road"): "SAME", ("NE Elm St", "NW Elm St"): "DIRECTION_VARIANT", ("Old Germantown Rd", "Germantown Road"): "CORE_VARIANT",
        ("Germantown Road", "Germantown Road West"): "DIRECTION_VARIANT", ("Road", "Oak Road"): "DIFFERENT", (None, "Oak"): "DIFFERENT", ("One Two Three", "One Four"): "DIFFERENT", ("One Four", "One Two Three"): "CORE_VARIANT",
    }
    df = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "road string, way string, want string")
    assert df.where(names.name_relation(F.col("road"), F.col("way")) != F.col("want")).collect() == []


def test_adversarial_review_of_no_evidence_and_overlaps(spark):
    item = "corridor long, id long, claim string, tier int, org string, scope string, applies_to string, starts int, ends int, dated int, recurrence string"
    rows = [
        (1, 1, "ROAD_MAINTAINED", 1, "county", "CORRIDOR", "Oak Road", None, None, 100, None), (1, 2, "ROAD_MAINTAINED", 2, "state", "CORRIDOR_PART", "NW Oak Rd", None, None, 100, None),
        (1, 3, "ROAD_MAINTAINED", 2, "city", "COUNTY_SEGMENT", "Elm Road", None, None, 100, None), (2, 4, "SEASONAL_CLOSURE", 1, "county", "CORRIDOR", None, None, None, None, "snow"),
        (3, 5, "TEMPORARY_CLOSURE", 1, "county", "CORRIDOR", None, 10, 99, 5, None), (4, 6, "PRIVATE_ROAD", 3, "osm", "CORRIDOR", None, None, None, 99, None), (4, 7, "PUBLIC_ROAD", 1, "county", "CORRIDOR_PART", None, None, None, None, None),
    ]
    roads = spark.createDataFrame([(i,) for i in range(1, 6)], "corridor long")
    found = access.findings(roads, spark.createDataFrame(rows, item), 100)
    assert {r.corridor: r.rule[:2] for r in found.collect()} == {1: "R6", 2: "R4", 3: "R9", 4: "R5", 5: "R1"}
    told = {(r.corridor, r.check): (r.outcome, r.evidence) for r in access.adversarial_review(found).collect()}
    assert len(told) == 45 and told[1, "AUTHORITY_OVERLAP"] == ("CONCERN", 2) and told[5, "EVIDENCE_ABSENCE"] == ("UNRESOLVED", 0)
    assert told[3, "STALE_EVIDENCE"] == ("CONCERN", 1) and told[2, "ACTING_RESTRICTION"] == ("CONCERN", 1) and told[4, "SINGLE_ORGANIZATION"][0] == "CONCERN" and told[2, "NEGATIVE_CASE_CONFIRMED"][0] == "PASS"
