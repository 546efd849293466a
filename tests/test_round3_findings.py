"""Faults that showed on larger tables only: each test holds a query or operator to its rule on rows that bring the fault out."""

import math
import random

import duckdb
import pytest

from fieldsift import polygon_queries, registry
from fieldsift.operators import grid, polygons
from fieldsift.operators import relations as rel


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 12_742_000 * math.asin(min(1.0, math.sqrt(h)))


def test_road_groups_take_the_first_part_by_the_rules_key_beyond_a_million(spark, tmp_path):
    db = duckdb.connect()
    db.execute("create table lineitem (l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double)")
    db.execute("insert into lineitem values (1, 1, 2500000, 1, 3), (1, 2, 10, 2, 4), (2, 1, 5, 1, 1), (2, 2, 4, 1, 2)")
    db.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    mine = registry.QUERIES["road_groups"](spark, str(tmp_path))
    want = db.execute(registry.ORACLES["road_groups"]).fetchall()
    assert sorted(map(tuple, mine.select("road_id", "first_part", "features", "names", "metres").collect())) == sorted(want) and dict((r[0], r[1]) for r in want)[1] == 10


def test_a_fix_without_a_road_shows_what_the_rule_shows(spark, tmp_path):
    db = duckdb.connect()
    db.execute("create table lineitem as select 3 * t as l_orderkey, k::int as l_linenumber, k as l_partkey, k * 2 as l_suppkey from range(2) a(t), range(1, 4) b(k)")
    db.execute("create table events as select i as event_id, timestamp '2024-01-01' as ts, i % 4 as user_id, 'view' as event_type, 1e0 as value, '' as props from range(24) r(i)")
    for t in ("lineitem", "events"):
        db.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    mine = registry.QUERIES["nearest_planned_road"](spark, str(tmp_path))
    want = sorted(db.execute(registry.ORACLES["nearest_planned_road"]).fetchall())
    assert sorted(map(tuple, mine.select("fix", "near_id", "basis", "near", "shown_metres").collect())) == want
    assert any(r[1] is None and r[4] is not None for r in want) and any(r[1] is None and r[4] is None for r in want)


@pytest.mark.parametrize("lat", [-45.0, -0.02, 45.0, 75.0])
def test_endpoint_edges_by_shuffle_join_all_points_in_reach(spark, lat):
    r = random.Random(3)
    wide = 0.6 / math.cos(math.radians(lat))
    points = [(k, f"n{k % 3}", r.uniform(0, wide), lat + r.uniform(-0.3, 0.3)) for k in range(400)]
    edges = rel.endpoint_edges(spark.createDataFrame(points, "k long, n string, lon double, lat double"), "k", "n", 5000.0)
    assert "BroadcastHashJoin" not in plan(edges)  # exploded sides are estimated far too small

    def parts(pairs):
        label = list(range(len(points)))
        for a, b in pairs:
            if label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
        return label

    found = [tuple(e) for e in edges.collect()]
    assert all(a > b and points[a][1] == points[b][1] and metres(points[a][2:], points[b][2:]) <= 1e9 for a, b in found)
    near = [(p[0], q[0]) for p in points for q in points if p[0] > q[0] and p[1] == q[1] and metres(p[2:], q[2:]) <= 5000.0]
    assert parts(found) == parts(near)


def test_polygon_joins_go_by_shuffle(spark):
    habitats = spark.range(30).selectExpr("id AS habitat_id", "'c' AS code", "id * 0.01D AS west", "0D AS south", "id * 0.01D + 0.02D AS east", "0.03D AS north")
    edges = polygon_queries.areas(habitats)
    points = spark.range(50).selectExpr("id AS k", "id * 0.005D AS lon", "0.011D AS lat")
    segments = spark.range(50).selectExpr("id AS line_id", "1L AS k", "id * 0.005D AS ax", "0.001D AS ay", "id * 0.005D + 0.01D AS bx", "0.02D AS by")
    for df in (polygons.points_in_polygons(points, edges, "k"), polygons.spans_in_polygons(segments, edges), grid.grid_cells(edges)):
        assert "BroadcastHashJoin" not in plan(df)


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """Small tables four times, with keys shifted so that copies have the coordinates of their first."""
    path = tmp_path_factory.mktemp("copied")
    db = duckdb.connect()
    for table, key, step, n in (("orders", "o_orderkey", 700_000, 900), ("customer", "c_custkey", 100_000, 300), ("part", "p_partkey", 100_000, 400)):
        db.execute(f"copy (select t.* replace ({key} + i * {step} AS {key}) from range(4) r(i), (from '/root/testdata/sf0.01/{table}.parquet' where {key} < {n}) t) to '{path}/{table}.parquet' (format parquet)")
        db.execute(f"create view {table} as select * from '{path}/{table}.parquet'")
    return db, str(path)


@pytest.mark.parametrize("name, seen", [("padded_box_join", "pad_join"), ("nearest_place", "nearest"), ("places_in_polygons", None)])
def test_copies_meet_once_and_all_get_their_rows(spark, copied, monkeypatch, name, seen):
    db, path = copied
    asked = []
    if seen:
        real = getattr(rel, seen)
        monkeypatch.setattr(rel, seen, lambda left, *args, **kw: asked.append(left.count()) or real(left, *args, **kw))
    mine = registry.QUERIES[name](spark, path)
    if not seen:
        assert "BroadcastHashJoin" not in plan(mine)
    want = db.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, mine.select(*columns).collect())) == sorted(want.fetchall())
    assert all(n == 900 for n in asked)
