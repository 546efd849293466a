"""Geometry expressions against closed forms."""

import math

import pytest
from pyspark.sql import functions as F

from fieldsift.functions import geo
from fieldsift.operators import relations as rel


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_haversine_of_a_degree_of_latitude(spark):
    got = value(spark, geo.haversine(F.lit(10.0), F.lit(0.0), F.lit(10.0), F.lit(1.0)))
    assert got == pytest.approx(math.pi * 6_371_000 / 180, rel=1e-9)


def test_bearing_and_compass(spark):
    east = geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))
    assert value(spark, east) == pytest.approx(90)
    assert value(spark, geo.compass(east)) == "E"
    assert value(spark, geo.compass(F.lit(359.0))) == "N"


def test_albers_origin_and_equal_area(spark):
    x, y = geo.albers(F.lit(-96.0), F.lit(23.0))
    assert value(spark, x) == pytest.approx(0, abs=1e-6)
    assert value(spark, y) == pytest.approx(0, abs=1e-6)

    def cell_area(lat, d=0.001):
        corners = [(-100, lat), (-100 + d, lat), (-100 + d, lat + d), (-100, lat + d)]
        p = [tuple(value(spark, c) for c in geo.albers(F.lit(float(a)), F.lit(float(b)))) for a, b in corners]
        return abs(sum(p[i][0] * p[(i + 1) % 4][1] - p[(i + 1) % 4][0] * p[i][1] for i in range(4))) / 2

    a, f, d = 6378137.0, 1 / 298.257222101, math.radians(0.001)
    e2 = f * (2 - f)
    for lat in (30.0, 47.0):
        p = math.radians(lat + 0.0005)
        true = d * d * a * a * (1 - e2) * math.cos(p) / (1 - e2 * math.sin(p) ** 2) ** 2
        assert cell_area(lat) == pytest.approx(true, rel=1e-6)


def test_proximity_of_a_missing_distance_is_zero(spark):
    assert value(spark, geo.proximity(F.lit(None).cast("double"), 1000.0)) == 0.0


def test_guard_and_empty_relation(spark):
    df = spark.range(5)
    assert rel.guard(df, 5).count() == 5
    with pytest.raises(ValueError):
        rel.guard(df, 4)
    assert rel.empty_relation(spark, df.schema).count() == 0


def test_components_do_not_depend_on_partitions(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(101, 100)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(31), 100, 101, 200]], "k long")
    got = {r.k: r.component for r in rel.connected_components(nodes, "k", edges.repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 200}


def test_haversine_of_nothing_is_null(spark):
    from fieldsift.operators import lines

    rows = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 10000, 0), (1, 2, 20000, 0)], "line_id long, nth long, xu long, yu long")
    asked = [geo.haversine(*(F.lit(None).cast("double") if i == gap else F.lit(1.0) for i in range(4))) for gap in range(4)]
    assert list(rows.limit(1).select(*asked).first()) == [None] * 4
    got = lines.normalized(lines.ordered(rows)).first()
    assert abs(got["metres"] - geo.DIAMETER * 3.141592653589793 / 360 * 0.02) < 1e-6
