"""Habitat measures from end to end against the kernels on all pairs, and WKB that can't be read."""

import numpy as np
import pytest

from fieldsift import habitat_queries as q
from fieldsift import registry
from fieldsift.functions import kernels
from fieldsift.plans.views import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planes(spark):
    v, h = view(spark, SF, "vertices"), view(spark, SF, "habitats")
    lines = {r.line_id: np.array(r.xy).reshape(-1, 2) for r in q.roads(v).collect()}
    areas = {r.feature_id: (r.code, [np.array(x).reshape(-1, 2) for x in r.rings]) for r in q.wetlands(h).collect()}
    return lines, areas


def test_buffers_and_nearest_equal_all_pairs(spark, planes):
    lines, areas = planes
    own = {k: lines[k] for k in sorted(lines)[:40]}
    sums, near = {}, {}
    for i, line in own.items():
        for f, (code, rings) in areas.items():
            centre = np.mean(rings[0], axis=0)
            if np.hypot(*(line - centre).T).min() > 20_000:
                continue
            m = kernels.distance(line, rings)
            if m <= 1000:
                near[i] = min(near.get(i, (9e9, 0)), (m, f))
            for d in (250, 500, 1000):
                if m < d and (a := kernels.buffer_area(line, rings, d)) > 0:
                    n, total = sums.get((i, d, code), (0, 0.0))
                    sums[i, d, code] = (n + 1, total + a)
    got = {(r.line_id, r.distance, r.code): (r.features, r.area) for r in registry.QUERIES["wetland_buffers"](spark, SF).collect() if r.line_id in own}
    assert set(got) == set(sums) and sums
    for k, (n, a) in sums.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(a, abs=0.51)
    rows = registry.QUERIES["nearest_by_class"](spark, SF).collect()
    best = {}
    for r in rows:
        if r.line_id in own:
            best[r.line_id] = min(best.get(r.line_id, (9e9, 0)), (r.metres, r.feature_id))
    assert {k: v[1] for k, v in best.items()} == {k: v[1] for k, v in near.items()}


def test_metrics_have_a_row_for_every_road(spark, planes):
    rows = registry.QUERIES["corridor_metrics"](spark, SF).collect()
    assert sorted(r.line_id for r in rows) == sorted(planes[0])
    for r in rows:
        assert r.wetland_area_250 <= r.wetland_area_500 <= r.wetland_area_1000
        assert (r.nearest_wetland is None) == (r.wetland_area_1000 == 0) or r.nearest_wetland > 999
    assert len({r.coverage for r in rows}) > 1


def test_tiles_hold_each_polygon_once(spark):
    share = {}
    for r in registry.QUERIES["serving_tiles"](spark, SF).collect():
        share[r.feature_id] = share.get(r.feature_id, 0) + r.share
        assert r.west >= r.x * 0.01 - 1e-9 and r.north <= (r.y + 1) * 0.01 + 1e-9
    assert all(v == pytest.approx(1) for v in share.values()) and share


def test_decode_reports_what_it_cannot_read(spark):
    rows = registry.QUERIES["geometry_decode"](spark, SF).collect()
    bad = [r for r in rows if r.problem]
    assert {r.problem for r in bad} == {"broken WKB", "no geometry"} and all(r.line_id % 101 == 1 or r.line_id % 103 == 1 for r in bad)
    assert all(r.kind == kernels.LINE and r.parts == 1 and r.west <= r.east for r in rows if not r.problem)
