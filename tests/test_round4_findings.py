"""Findings of round 4: what is broadcast, what meets once, and what a query leaves out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsift import habitat_queries as q
from fieldsift import polygon_queries as pq
from fieldsift import registry
from fieldsift.llm import minhash
from fieldsift.operators import components as comp
from fieldsift.operators import grid
from fieldsift.plans.views import view

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_broadcast_nothing_that_grows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    signed = minhash.signatures(docs, 5).where("set_key is not null").select("doc_id", "set_key", F.col("doc_id").alias("node"), "sig")
    assert "Broadcast" not in plan_of(minhash._postings(signed.select("node", "sig"), 37))
    assert "Broadcast" not in plan_of(minhash.distinct_rows(docs))


@pytest.mark.parametrize("small", [0, 100_000])
def test_components_are_the_same_by_shuffle(spark, monkeypatch, small):
    monkeypatch.setattr(comp, "SMALL", small)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 5), (100, 45)]
    got = {r.node: r.component for r in comp.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 if i < 20 or 40 <= i < 60 else 20 for i in range(60)} | {60: 60, 100: 0}
    assert {k: v for k, v in want.items() if k in got} == got and len(got) == 61


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """sf0.001 twice: the copies' keys are shifted so that they lie upon the rows they come from."""
    out = str(tmp_path_factory.mktemp("copied"))
    for table, keys in (("lineitem", ["l_orderkey"]), ("part", ["p_partkey"])):
        rows = spark.read.parquet(f"{SF}/{table}.parquet")
        shifted = rows.withColumns({k: F.col(k) + 300_000 for k in keys})
        rows.union(shifted).write.parquet(f"{out}/{table}.parquet")
    return out


def test_copies_of_lines_and_areas_are_measured_once(spark, copied):
    plain, twice = (q.road_shapes(view(spark, d, "vertices")) for d in (SF, copied))
    assert plain[0].count() == twice[0].count() < twice[1].count() == 2 * plain[1].count()
    one, two = (q.kinds(view(spark, d, "habitats"))[0] for d in (SF, copied))
    assert one.count() == two.count() and two.agg(F.sum("copies")).first()[0] == 2 * one.agg(F.sum("copies")).first()[0]


@pytest.mark.parametrize("name, measure, digits", [("wetland_buffers", "area", 1.01), ("hydro_buffers", "metres", 0.11)])
def test_each_copy_counts(spark, copied, name, measure, digits):
    rows = lambda d: {(r.line_id, r.distance, r.code): (r.features, r[measure]) for r in registry.QUERIES[name](spark, d).collect()}
    plain, twice = rows(SF), rows(copied)
    assert len(twice) == 2 * len(plain) > 0
    for (line, d, code), (n, m) in plain.items():
        for other in (line, line + 300_000):
            got = twice[other, d, code]
            assert got[0] == 2 * n and got[1] == pytest.approx(2 * m, abs=digits)


def test_nearest_of_copies_is_the_smallest_id(spark, copied):
    rows = lambda d: {(r.line_id, r.code): (r.feature_id, r.metres) for r in registry.QUERIES["nearest_by_class"](spark, d).collect()}
    plain, twice = rows(SF), rows(copied)
    assert plain and twice == plain | {(line + 300_000, code): v for (line, code), v in plain.items()}


def test_an_id_with_several_rows_counts_once(spark):
    rows = [(1, "a", 0.0, 0.0, 1.0, 1.0), (1, "a", 0.0, 0.0, 2.0, 1.0), (2, "a", 0.0, 0.0, 1.0, 1.0)]
    areas, features = q.kinds(spark.createDataFrame(rows, "habitat_id long, code string, west double, south double, east double, north double"))
    assert areas.withColumnRenamed("habitat_id", "feature_id").agg(features).first()[0] == 2


def test_lines_in_copied_areas(spark, copied):
    rows = lambda d: {(r.line_id, r.code): (r.metres, r.areas) for r in registry.QUERIES["area_overlay"](spark, d).collect()}
    plain, twice = rows(SF), rows(copied)
    assert len(twice) == 2 * len(plain) > 0
    for (line, code), (m, n) in plain.items():
        assert twice[line, code] == twice[line + 300_000, code] and twice[line, code][1] == 2 * n and twice[line, code][0] == pytest.approx(2 * m, abs=0.011)


def test_equal_stars_are_one_and_places_on_one_point_too(spark, copied):
    habitats, places = (view(spark, d, n) for d, n in ((copied, "habitats"), (SF, "places")))
    held, _ = pq.stars(habitats)
    assert 2 * held.count() == habitats.count() and held.where("copies <> 2").isEmpty()
    twice = places.union(places.withColumn("place_id", F.col("place_id") + 100_000))
    rows = lambda p, h: {r.place_id: (r.areas, r.first_area) for r in pq.places_in_areas(spark, SF, p, h).collect()}
    plain = rows(places, view(spark, SF, "habitats"))
    got = rows(twice, habitats)
    assert plain and got == {k + add: (2 * n, first) for k, (n, first) in plain.items() for add in (0, 100_000)}


def test_hydro_buffers_tell_waterbodies_too(spark):
    rows = registry.QUERIES["hydro_buffers"](spark, SF).collect()
    area, n = {}, {}
    for r in registry.QUERIES["wetland_buffers"](spark, SF).collect():
        key = r.line_id, r.distance, "flowing" if r.code in {f"Brand#{i}" for i in range(1, 6)} else "standing"
        area[key], n[key] = area.get(key, 0) + r.area, n.get(key, 0) + r.features
    got = {(r.line_id, r.distance, r.code): r for r in rows if r.layer == "waterbody"}
    assert set(got) == set(area) and got and all(r.metres > 0 and r.area == 0 for r in rows if r.layer == "flowline")
    assert all(got[k].features == n[k] and got[k].area == pytest.approx(area[k], abs=0.51 * n[k] + 0.1) for k in got)


def test_overlay_features_has_no_cap_and_both_layers(spark, tmp_path):
    lineitem, part = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "part"))
    lineitem.where("l_orderkey < 40").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.QUERIES["overlay_features"](spark, SF).where("line_id < 40 and layer = 'wetland'").collect()
    copies = spark.range(450).select((F.col("id") * 100_000).alias("add"))
    part.crossJoin(copies).withColumn("p_partkey", F.col("p_partkey") + F.col("add")).drop("add").write.parquet(f"{tmp_path}/part.parquet")
    rows = registry.QUERIES["overlay_features"](spark, str(tmp_path)).collect()
    got = {(r.line_id, r.feature_id): r.area for r in rows if r.layer == "wetland"}
    assert found and got == {(r.line_id, r.feature_id + 100_000 * i): r.area for r in found for i in range(450)}
    assert {r.layer for r in registry.QUERIES["overlay_features"](spark, SF).collect()} == {"wetland", "flowline"}


def test_cells_of_copied_areas(spark, copied):
    rows = lambda d: {(r.x, r.y): r for r in registry.QUERIES["grid_definition"](spark, d).collect()}
    plain, twice = rows(SF), rows(copied)
    assert set(plain) == set(twice) and plain
    for k, r in plain.items():
        assert (r.kind, r.share, 2 * r.areas, r.first_area) == (twice[k].kind, twice[k].share, twice[k].areas, twice[k].first_area)


def test_parts_of_a_dense_cell_hold_few_edges(monkeypatch):
    rng, taken = np.random.default_rng(3), []
    slabs = grid._slabs
    monkeypatch.setattr(grid, "_slabs", lambda edges, *a: taken.append(len(edges)) or slabs(edges, *a))
    corners = np.array([(0, 0), (0.5, 0.25), (1, 0), (0.75, 0.5), (1, 1), (0.5, 0.75), (0, 1), (0.25, 0.5)])
    rings = [corners * 0.1 + at for at in rng.uniform(-0.05, 0.95, (2000, 2))]
    edges = np.concatenate([np.hstack([r, np.roll(r, -1, axis=0)]) for r in rings])
    area, held = grid.union_area(edges, np.repeat(np.arange(len(rings)), len(corners)), (0.0, 0.0, 1.0, 1.0))
    assert max(taken) < 1000 and sum(n * n for n in taken) < 0.01 * len(edges) ** 2 * len(rings) ** 0.5
    xs = rng.uniform(0, 1, (4000, 2))
    sampled = np.mean([grid._hold(edges, np.repeat(np.arange(len(rings)), len(corners)), x, y) for x, y in xs])
    assert abs(area - sampled) < 0.03 and len(held) == 2000
