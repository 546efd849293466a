"""Integrity of cell tables, components that don't settle, nearest at several densities, and digests of groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldsift.operators import relations as rel
from fieldsift.sources import cells


def test_files_of_a_written_table_verify_by_relative_path(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("c "), F.col("id") % 5).alias("cell_id"), F.col("id").alias("corridor_id"))
    path = str(tmp_path / "cells")
    cells.write_cells(rows, path, "corridor_id")
    listed = cells.listed_files(spark, path)
    held = [tuple(r) for r in listed.collect()]
    assert len({r[0] for r in held}) == len(held) and all(r[0].startswith("cell_id=") for r in held)
    manifest = spark.createDataFrame(held, listed.schema)
    assert cells.verify_files(spark, path, manifest).collect() == []
    broken = [(held[0][0], held[0][1], "00"), *held[1:-1], ("cell_id=x/part-0.parquet", 1, "")]
    found = {(r.file, r.problem) for r in cells.verify_files(spark, path, spark.createDataFrame(broken, listed.schema)).collect()}
    assert found == {(held[0][0], "digest"), (held[-1][0], "unlisted"), ("cell_id=x/part-0.parquet", "missing")}


def test_components_of_long_paths_settle_or_raise(spark):
    n = 4000
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    nodes = spark.range(n + 5).withColumnRenamed("id", "k")
    got = rel.connected_components(nodes, "k", edges).collect()
    assert {r.component for r in got if r.k < n} == {0} and {r.component for r in got if r.k >= n} == set(range(n, n + 5))
    with pytest.raises(RuntimeError):
        rel.connected_components(nodes, "k", edges, max_rounds=1)


def haversine(a, b, c, d):
    h = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
    return 12742000 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize(("lat", "spread"), [(0.0, 0.5), (47.0, 0.05), (78.0, 1.0)])
def test_nearest_equals_brute_force(spark, lat, spread):
    rng = random.Random(2)
    at = lambda k: (k, rng.uniform(0, spread), lat + rng.uniform(0, spread))
    points, places = [at(k) for k in range(60)], [(*at(k), f"n{k % 3}") for k in range(80)]
    got = rel.nearest(
        spark.createDataFrame(points, "k long, lon double, lat double"), spark.createDataFrame(places, "p long, lon double, lat double, name string"), "k", "p", 9000.0, tie_order=("name",), tie=200.0
    ).collect()
    wanted = {}
    for k, x, y in points:
        near = [(haversine(x, y, u, v), n, p) for p, u, v, n in places]
        least = min(near)[0]
        if least <= 9000:
            wanted[k] = min((n, p) for m, n, p in near if m <= least + 200 and m <= 9000)[1]
    assert {r.k: r.p for r in got} == wanted
    none = spark.createDataFrame([], "p long, lon double, lat double, name string")
    assert rel.nearest(spark.createDataFrame(points, "k long, lon double, lat double"), none, "k", "p", 9000.0).collect() == []


@pytest.mark.parametrize("lat", [0.0, 45.0, -70.0])
def test_endpoint_edges_join_what_pairs_join(spark, lat):
    rng = random.Random(3)
    points = [(k, rng.choice("ab"), rng.uniform(-0.1, 0.1), lat + rng.uniform(-0.1, 0.1)) for k in range(150)]
    frame = spark.createDataFrame(points, "k long, name string, lon double, lat double")
    got = {r.k: r.component for r in rel.connected_components(frame, "k", rel.endpoint_edges(frame, "k", "name", 1500.0)).collect()}
    label = {k: k for k, *_ in points}
    moved = True
    while moved:
        moved = False
        for a, m, x, y in points:
            for b, n, u, v in points:
                if m == n and label[b] < label[a] and haversine(x, y, u, v) <= 1500:
                    label[a], moved = label[b], True
    assert got == label


def test_changed_groups_see_swaps_and_lost_groups(spark):
    now = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (3, 1, "a"), (3, 1, "a")], "g long, id long, name string")
    before = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (2, 1, "a"), (3, 1, "a"), (4, 1, "a")], "g long, id long, name string")
    assert {(r.g, r.state) for r in rel.changed_groups(now, before, ["g"]).collect()} == {(1, "changed"), (3, "changed"), (4, "lost")}
