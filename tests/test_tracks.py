"""Streams against their batch twins, and cell tables on disk."""

import pytest
from pyspark.sql import functions as F

from fieldsift.field_queries import fixes
from fieldsift.sources import cells
from fieldsift.streaming import tracks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """The fixes as three files in time order, read one file a micro-batch."""
    path = str(tmp_path_factory.mktemp("fixes"))
    rows = fixes(spark, SF)
    a, b = rows.approxQuantile("micros", [0.33, 0.66], 0)
    for k, part in enumerate((F.col("micros") < a, (F.col("micros") >= a) & (F.col("micros") < b), F.col("micros") >= b)):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{path}/p{k}")
    return lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def drain(stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    return stream.sparkSession.table(name)


def test_sampling_stream_equals_batch(spark, arriving, tmp_path):
    got = {(r.trip, r.seq): r.reason for r in drain(tracks.sample_stream(arriving()), "sampled", tmp_path).collect()}
    want = {(r.trip, r.seq): r.reason for r in tracks.sample_tracks(fixes(spark, SF)).collect()}
    assert got == want and len(set(want.values())) >= 4


def test_sampling_edges(spark):
    rows = [(1, 1, 0, 0.0, 0.0, None), (1, 2, 1, 0.0, 0.0, None), (1, 3, 2, 0.0, 0.0, 900.0), (1, 4, 3, 1.0, 0.0, 5.0), (None, 5, 4, 0.0, 0.0, None), (2, 6, 5, 0.0, 95.0, None), (1, 7, 20_000_000, 1.0003, 0.0, None)]
    schema = "trip long, seq long, micros long, lon double, lat double, accuracy double"
    got = {r.seq: r.reason for r in tracks.sample_tracks(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "first", 2: "unchanged", 3: "poor-accuracy", 4: "moved", 7: "interval"}
    assert tracks.sample_tracks(spark.createDataFrame([], schema)).collect() == []


def test_fan_out_and_fresh_deliveries(arriving, tmp_path):
    seen = []
    stream = tracks.fan_out(arriving(), [lambda b, n: seen.append(("a", b.count())), lambda b, n: seen.append(("b", b.count()))])
    query = stream.option("checkpointLocation", str(tmp_path / "f")).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    assert sum(n for k, n in seen if k == "a") == sum(n for k, n in seen if k == "b") > 0
    timed = arriving().withColumn("ts", F.timestamp_micros("micros"))
    fresh = drain(tracks.fresh_deliveries(timed, ["trip"], "ts"), "fresh", tmp_path)
    assert fresh.select("trip").distinct().count() > 0


def test_cells_round_trip_and_integrity(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("c"), F.col("id") % 5).alias("cell_id"), F.col("id").alias("corridor_id"))
    path = str(tmp_path / "cells")
    assert cells.write_cells(rows, path, "corridor_id") == 1000
    assert cells.read_cells(spark, path, ["c1", "c2", "none"]).count() == 400
    assert cells.read_cells(spark, path, ["none"]).columns == ["corridor_id", "cell_id"]
    (tmp_path / "files").mkdir()
    for name in ("a", "b"):
        (tmp_path / "files" / name).write_bytes(b"xyz")
    digest = "3608bca1e44ea6c4d268eb6db02260269892c0b42b86bbf1e77a6fa16c3c9282"
    listed = spark.createDataFrame([("a", 3, digest), ("c", 3, digest)], "file string, bytes long, sha256 string")
    assert {(r.file, r.problem) for r in cells.verify_files(spark, str(tmp_path / "files"), listed).collect()} == {("b", "unlisted"), ("c", "missing")}
