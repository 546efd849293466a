"""True polygons: spans, points and the grid they define, against plain geometry and sampling."""

import math
import random

import numpy as np
import pytest

from fieldsift.operators import grid, polygons

RING = "poly long, ring int, k int, lon double, lat double"


def box(poly, w, s, e, n, ring=0):
    return [(poly, ring, k, float(x), float(y)) for k, (x, y) in enumerate([(w, s), (e, s), (e, n), (w, n)])]


def edges_of(spark, rows):
    return polygons.ring_edges(spark.createDataFrame(rows, RING))


def test_spans_through_vertices_holes_and_along_edges(spark):
    edges = edges_of(spark, box(1, 0, 0, 1, 1) + box(1, 0.4, 0.4, 0.6, 0.6, ring=1) + [(2, 0, 0, 2.0, 0.0), (2, 0, 1, 3.0, 1.0), (2, 0, 2, 4.0, 0.0)])
    segs = [
        (1, 1, -1.0, 0.5, 2.0, 0.5), (2, 1, 0.1, 0.1, 0.2, 0.2), (3, 1, 5.0, 5.0, 6.0, 6.0), (4, 1, -0.5, -0.5, 1.5, 1.5), (5, 1, 3.0, -1.0, 3.0, 2.0), (6, 1, 2.5, 1.0, 3.5, 1.0), (7, 1, 0.45, 0.45, 0.55, 0.55), (8, 1, 0.5, 0.5, 0.5, 0.5),
    ]
    got = {}
    for r in polygons.spans_in_polygons(spark.createDataFrame(segs, "line_id long, k long, ax double, ay double, bx double, by double"), edges).collect():
        got.setdefault((r.line_id, r.poly), []).append((round(r.enters, 6), round(r.leaves, 6)))
    want = {(1, 1): [(0.333333, 0.466667), (0.533333, 0.666667)], (2, 1): [(0.0, 1.0)], (4, 1): [(0.25, 0.45), (0.55, 0.75)], (5, 2): [(0.333333, 0.666667)]}
    assert {k: sorted(v) for k, v in got.items()} == want


def inside(rings, x, y):
    hits = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            hits += ((ay > y) != (by > y)) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return hits % 2 == 1


def star(rng, cx, cy, size, n):
    return [(cx + math.cos(2 * math.pi * i / n) * size * rng.uniform(0.3, 1), cy + math.sin(2 * math.pi * i / n) * size * rng.uniform(0.3, 1)) for i in range(n)]


@pytest.mark.parametrize("size", [0.03, 0.5])
def test_points_and_spans_against_plain_tests(spark, size):
    rng = random.Random(7)
    shapes = {p: [star(rng, rng.uniform(0, 2), rng.uniform(0, 2), 0.4, rng.randint(3, 30))] for p in range(25)}
    shapes[0].append([(x * 0.2 + shapes[0][0][0][0] - 0.2, y * 0.2 + shapes[0][0][0][1]) for x, y in ((0, 0), (1, 0), (1, 1))])
    edges = edges_of(spark, [(p, r, k, x, y) for p, rings in shapes.items() for r, ring in enumerate(rings) for k, (x, y) in enumerate(ring)])
    points = [(i, rng.uniform(-0.5, 2.5), rng.uniform(-0.5, 2.5)) for i in range(400)]
    got = {(r.id, r.poly) for r in polygons.points_in_polygons(spark.createDataFrame(points, "id long, lon double, lat double"), edges, "id", size).collect()}
    assert got == {(i, p) for i, x, y in points for p, rings in shapes.items() if inside(rings, x, y)} and got
    segs = [(i, 1, *(rng.uniform(0, 2) for _ in range(4))) for i in range(30)]
    spans = polygons.spans_in_polygons(spark.createDataFrame(segs, "line_id long, k long, ax double, ay double, bx double, by double"), edges, size).collect()
    share = {}
    for r in spans:
        share[r.line_id, r.poly] = share.get((r.line_id, r.poly), 0.0) + r.leaves - r.enters
    for i, _, ax, ay, bx, by in segs:
        for p, rings in shapes.items():
            ts = (np.arange(2000) + 0.5) / 2000
            sampled = np.mean([inside(rings, ax + (bx - ax) * t, ay + (by - ay) * t) for t in ts[::4]])
            assert abs(share.get((i, p), 0.0) - sampled) < 0.02


def test_grid_of_states(spark):
    """Two states that share a border inside a cell, one that overlaps, one with a hole of a cell, one that only touches."""
    rows = box(1, 0.0, 0.0, 0.3, 0.4) + box(2, 0.3, 0.0, 0.8, 0.4) + box(3, 0.35, 0.05, 0.45, 0.1) + box(4, 2.0, 2.0, 2.6, 2.6) + box(4, 2.2, 2.2, 2.4, 2.4, ring=1) + box(5, 0.8, 0.4, 0.9, 0.5)
    got = {(r.x, r.y): r for r in grid.grid_cells(edges_of(spark, rows)).collect()}
    assert set(got) == {(x, y) for x in range(4) for y in range(2)} | {(x, y) for x in range(10, 13) for y in range(10, 13) if (x, y) != (11, 11)} | {(4, 2)}
    assert all(r.kind == "full" for k, r in got.items() if k != (4, 2)) and got[4, 2].kind == "edge" and abs(got[4, 2].share - 0.25) < 1e-9
    assert got[1, 0].areas == [1, 2, 3] and got[2, 0].areas == [2, 3] and got[0, 0].areas == [1] and got[4, 2].areas == [5]
    open_ = {(r.x, r.y): r for r in grid.grid_cells(edges_of(spark, [r for r in rows if r[0] != 2])).collect()}
    assert open_[1, 0].kind == "edge" and abs(open_[1, 0].share - (0.5 + 0.05 * 0.05 / 0.04)) < 1e-9
    assert grid.grid_cells(edges_of(spark, [])).collect() == []


@pytest.mark.parametrize("strip", [4, 256])
def test_union_area_against_sampling(monkeypatch, strip):
    monkeypatch.setattr(grid, "STRIP_EDGES", strip)
    rng = random.Random(strip)
    shapes = [star(rng, rng.uniform(0, 1), rng.uniform(0, 1), 0.4, rng.randint(3, 12)) for _ in range(6)]
    edges = np.array([(*a, *b) for ring in shapes for a, b in zip(ring, ring[1:] + ring[:1])])
    owner = np.array([i for i, ring in enumerate(shapes) for _ in ring])
    area, held = grid.union_area(edges, owner, (0.0, 0.0, 1.0, 1.0))
    n = 150
    sampled = np.mean([any(inside([ring], (i + 0.5) / n, (j + 0.5) / n) for ring in shapes) for i in range(n) for j in range(n)])
    assert abs(area - sampled) < 0.01 and (held > 0.01).all() and held.sum() > area
