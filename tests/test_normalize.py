"""Normal forms of shapes, faults of published rows, regions with several names, and batches in spatial order."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsift.functions import geo, kernels, shapes
from fieldsift.operators import normalize
from fieldsift.source_queries import published_wkb

RING = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (1.0, 3.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]


def closed(points, turn=0, back=False):
    p = points[::-1] if back else points
    p = p[turn:] + p[:turn]
    return np.array(p + p[:1])


def told(data, family):
    return shapes.digest(shapes.normal_parts(shapes.family_parts(data, family)), family)


def test_digest_ignores_turns_directions_order_and_bytes():
    whole = kernels.encode_wkb(kernels.MULTI_POLYGON, [[closed(RING), closed(HOLE)], [closed([(9.0, 9.0), (9.0, 8.0), (8.0, 8.0)])]])
    want = told(whole, "polygon")
    for turn in range(4):
        for back in (False, True):
            other = kernels.encode_wkb(kernels.MULTI_POLYGON, [[closed([(9.0, 9.0), (9.0, 8.0), (8.0, 8.0)], turn % 3, back)], [closed(RING, turn, back), closed(HOLE, turn % 3, not back)]])
            assert told(other, "polygon") == want
    moved = kernels.encode_wkb(kernels.MULTI_POLYGON, [[closed(RING), closed([(1.0, 1.0), (2.0, 1.0), (2.0, 2.5)])], [closed([(9.0, 9.0), (9.0, 8.0), (8.0, 8.0)])]])
    assert told(moved, "polygon") != want
    flat = [c for p in RING for c in p]
    forms = {told(published_wkb(flat, 1, big, high, nested), "polygon") for big in (0, 1) for high in (0, 1) for nested in (0, 1, 2)}
    assert forms == {told(kernels.encode_wkb(kernels.POLYGON, [closed(RING)]), "polygon")}


def test_least_rotation_equals_all_rotations():
    rng = np.random.default_rng(3)
    for _ in range(300):
        v = rng.integers(0, 3, rng.integers(1, 9)).tolist()
        assert shapes._least_rotation(v) == min(v[i:] + v[:i] for i in range(len(v)))
    assert len(shapes._least_rotation([(1.0, 1.0)] * 50_000)) == 50_000  # one vertex, repeated


def test_lines_in_both_directions_and_closed_lines():
    line = np.array([(1.0, 1.0), (2.0, 5.0), (0.0, 3.0)])
    enc = lambda a: kernels.encode_wkb(kernels.LINE, [a])
    assert told(enc(line), "line") == told(enc(line[::-1]), "line")
    assert told(enc(closed(RING)), "line") == told(enc(closed(RING, 2, True)), "line")
    assert told(enc(line), "line") != told(enc(line[:2]), "line")


def test_faults_and_families(spark):
    line = kernels.encode_wkb(kernels.LINE, [np.array([(-120.0, 45.0), (-120.0, 45.1)])])
    ring = kernels.encode_wkb(kernels.POLYGON, [closed(RING)])
    open_ring = kernels.encode_wkb(kernels.POLYGON, [np.array(RING)])
    nan = kernels.encode_wkb(kernels.LINE, [np.array([(-120.0, np.nan), (1.0, 1.0)])])
    empty = struct.pack("<BII", 1, kernels.LINE, 0)
    cases = [("a", "line", line, "kept"), ("b", "polygon", line, "other geometry"), ("c", "polygon", ring, "kept"), ("d", "line", ring, "other geometry"), ("e", "line", None, "no geometry"), ("f", "line", b"", "no geometry"), ("g", "line", line[:11], "broken"), ("h", "line", nan, "broken"), ("i", "line", empty, "other geometry"), ("j", "polygon", open_ring, "kept"), ("k", "line", b"\x07" * 30, "broken")]
    rows = spark.createDataFrame([(k, m, bytearray(w) if w is not None else None) for k, m, w, _ in cases], "key string, member string, wkb binary")
    got = {r.key: r for r in normalize.with_shape(rows, "member", "wkb").collect()}
    assert {k: got[k].state for k in got} == {k: s for k, _, _, s in cases}
    assert got["j"].malformed and not got["c"].malformed and got["c"].length_m is None and got["a"].area_m2 is None
    assert got["a"].length_m == pytest.approx(11_110, rel=0.01)
    assert normalize.with_shape(rows.limit(0), "member", "wkb").count() == 0


def test_area_takes_holes_away():
    shell, hole = closed([(-120.0, 45.0), (-119.0, 45.0), (-119.0, 46.0), (-120.0, 46.0)]), closed([(-119.8, 45.2), (-119.2, 45.2), (-119.2, 45.8), (-119.8, 45.8)])
    assert shapes.area([[shell, hole]]) == pytest.approx(shapes.area([[shell]]) - shapes.area([[hole]]))
    assert shapes.area([[hole]]) > 0


def test_signature_and_stats(spark):
    line = kernels.encode_wkb(kernels.LINE, [np.array([(-120.0, 45.0), (-120.0, 45.1)])])
    turned = kernels.encode_wkb(kernels.LINE, [np.array([(-120.0, 45.1), (-120.0, 45.0)])])
    row = lambda unit, i, name, ftype, wkb, ident=" 7 ": (unit, i, "line", ident, "R", name, ftype, 1, 0.5, None, wkb and bytearray(wkb))
    data = [row("u", 1, None, 460, line), row("v", 2, "", 460, turned), row("v", 3, "x", 460, line), row("v", 4, "x", None, line, None), row("v", 5, "x", 390, None)]
    schema = "unit string, objectid long, member string, identifier string, reach_code string, name string, ftype int, fcode int, length_km double, area_km2 double, wkb binary"
    out = normalize.normalize_hydro(spark.createDataFrame(data, schema))
    got = {r.objectid: r for r in out.collect()}
    assert got[1].signature == got[2].signature != got[3].signature and got[1].identifier == "7"
    assert [got[i].water_class for i in (1, 4, 5)] == ["flowing", "other", "standing"] and got[5].signature is None
    stats = {r.unit: r for r in normalize.unit_stats(out).collect()}
    assert (stats["v"].input_rows, stats["v"].output_rows, stats["v"].dropped_empty, stats["v"].blank_identity) == (4, 3, 1, 1)
    assert stats["u"].length_m == pytest.approx(got[1].length_m, abs=0.06)


def test_codes_with_several_names_stay(spark):
    rows = spark.createDataFrame([("42c ", "Coteau", "42", "Plains"), ("42c", "Cotteau", "42", "Plains"), ("1", "Coast", "1", "Coast"), ("1", "Coast ", "1", "Coast"), ("2", None, "1", "x"), ("3", " ", "1", "x")], "code string, name string, upper_code string, upper_name string")
    checked, several = normalize.read_level(rows)
    assert checked.count() == 6 and checked.where("problem is not null").count() == 2
    assert [tuple(r) for r in several.collect()] == [("42c", ["Coteau", "Cotteau"], 2)]


@pytest.mark.parametrize("run", [3, 4096])
def test_chunks_equal_the_serial_order(spark, run):
    rng = np.random.default_rng(5)
    data = [(int(k), float(w), float(s)) for k, w, s in zip(rng.permutation(400), np.where(rng.random(400) < 0.4, -120.05, rng.uniform(-121, -119, 400)), rng.uniform(45, 45.3, 400))]
    rows = spark.createDataFrame(data, "key long, west double, south double").repartition(7)
    got = {r.key: (r.position, r.chunk) for r in normalize.chunk_order(rows, "key", 25, run=run).collect()}
    want = sorted(data, key=lambda r: (np.floor(r[1] / 0.2), np.floor(r[2] / 0.2), r[0]))
    assert got == {k: (i, i // 25) for i, (k, _, _) in enumerate(want)}
    assert normalize.chunk_order(rows.limit(0), "key").count() == 0


def test_projection_comes_back(spark):
    rng = np.random.default_rng(9)
    data = [(float(a), float(b)) for a, b in zip(rng.uniform(-130, -60, 500), rng.uniform(15, 72, 500))]
    rows = spark.createDataFrame(data, "lon double, lat double")
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    there = rows.withColumns({"x": x, "y": y})
    lon, lat = geo.albers_inverse(F.col("x"), F.col("y"))
    back = there.withColumns({"a": lon, "b": lat}).collect()
    assert max(max(abs(r.a - r.lon), abs(r.b - r.lat)) for r in back) < 1e-9
    mine = shapes.albers(np.array(data))
    assert np.abs(mine - np.array([(r.x, r.y) for r in back])).max() < 1e-6
    assert np.abs(shapes.albers_inverse(mine) - np.array(data)).max() < 1e-9


@pytest.mark.parametrize("family", ["line", "polygon"])
def test_rows_of_one_layout_are_measured_as_one_by_one(spark, family):
    r = random.Random(5)
    rows = []
    for i in range(600):
        n = r.choice([1, 2, 3, 4, 5]) + (family == "polygon")
        xy = [r.choice([-120.0, -120.001, -119.9995, 0.0, -0.0]) if r.random() < 0.5 else r.uniform(-121, -119) for _ in range(2 * n)]
        if i % 7 == 0 and n > 2 and family == "line":
            xy[-2:] = xy[:2]
        if i % 50 == 1:
            xy[1] = float("nan")
        data = published_wkb(xy, int(family == "polygon"), i % 2, i // 2 % 2, i % 3)
        if i % 40 == 2:
            data = data[: 5 + i % 11]
        if i % 40 == 3:
            data = published_wkb(xy, int(family != "polygon"), 0, 0, 0)
        rows.append((i, family, None if i % 60 == 4 else data))
    table = spark.createDataFrame(rows, "key long, member string, wkb binary").coalesce(1)
    held = [x[2] for x in rows if x[2]]
    groups, alone = shapes.alike(held, family)
    assert sum(len(g[0]) for g in groups) > 300 and sorted([*alone, *(i for g in groups for i in g[0])]) == list(range(len(held)))
    got = {t.key: t for t in normalize.with_shape(table, "member", "wkb").collect()}
    assert len(got) == 600 and {t.state for t in got.values()} == {"kept", "broken", "no geometry", "other geometry"}
    for key, _, data in rows:
        t, state, parts = got[key], "no geometry", []
        if data:
            try:
                parts = shapes.family_parts(data, family)
                state = "kept" if parts else "other geometry"
            except ValueError:
                state = "broken"
        if state == "kept" and not all(np.isfinite(a).all() for p in parts for a in p):
            state = "broken"
        assert t.state == state, key
        if state != "kept":
            assert t.points is None and t.geometry is None and t.geometry_digest is None
            continue
        xy = np.concatenate([a for p in parts for a in p])
        assert (t.malformed, t.parts, t.points) == (shapes.malformed(parts, family), len(parts), len(xy))
        assert (t.min_lon, t.min_lat, t.max_lon, t.max_lat) == (*xy.min(axis=0), *xy.max(axis=0))
        assert t.geometry_digest == shapes.digest(shapes.normal_parts(parts), family) and bytes(t.geometry) == shapes.stored_wkb(parts, family)
        wanted = shapes.length(parts) if family == "line" else shapes.area(parts)
        assert abs((t.length_m if family == "line" else t.area_m2) - wanted) <= 0.0011 + 1e-12 * wanted and (t.area_m2 if family == "line" else t.length_m) is None
