"""Registered queries of habitat measures. Buffers and polygon clips are no SQL of the oracle: tests hold them to brute force.

What vertices, distances and counts decide has oracle SQL of its own: the projection, segment distances and coverage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.functions import geo, kernels
from fieldsift.operators import comparison
from fieldsift.operators import habitat as hab
from fieldsift.operators import lines
from fieldsift.first_queries import query, rows_only
from fieldsift.line_queries import _O
from fieldsift.operators.relations import BOUNDS
from fieldsift.sources.tables import as_table, shuffled

DISTANCES = [250, 500, 1000]


def wetlands(habitats: DataFrame) -> DataFrame:
    """Four-cornered areas that stand on a corner, with their class."""
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    ring = [(w, (s + n) / 2), ((w + e) / 2, s), (e, (s + n) / 2), ((w + e) / 2, n)]
    return hab.projected_polygons(habitats.withColumnRenamed("habitat_id", "feature_id"), ring)


def roads(vertices: DataFrame) -> DataFrame:
    return hab.projected_lines(vertices.where("line_id % 2 = 1"))


def _unique(habitats: DataFrame) -> bool:
    return habitats.groupBy("habitat_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def kinds(habitats: DataFrame, *marks: str) -> tuple[DataFrame, Column]:
    """Habitats of one code, box and marks once, the smallest habitat_id for all and copies, and how many features rows of them stand for.

    Where an id has several rows, rows don't merge, so that it counts once whatever its boxes are.
    """
    if _unique(habitats):
        return habitats.groupBy("code", *BOUNDS, *marks).agg(F.min("habitat_id").alias("habitat_id"), F.count("*").alias("copies")), F.sum("copies")
    return habitats.select("code", *BOUNDS, *marks, "habitat_id", F.lit(1).cast("long").alias("copies")), F.count_distinct("feature_id")


def road_shapes(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`roads` of equal vertices once, and line_id, shape of every road."""
    return hab.projected_shapes(vertices.where("line_id % 2 = 1"))


def water_shapes(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Even lines, moved onto their odd neighbours, as flowlines: those of equal vertices and class once, and line_id, shape of every one."""
    code = F.concat(F.lit("class "), (F.col("line_id") % 5).cast("string"))
    moved = vertices.where("line_id % 2 = 0").withColumns({"xu": F.col("xu") + 395950, "yu": F.col("yu") + 118225, "code": code})
    shapes, members = hab.projected_shapes(moved, "code")
    return shapes.withColumnsRenamed({"line_id": "feature_id", "xy": "other"}), members


@rows_only("vertices", "habitats")
def wetland_buffers(spark, sf_dir, vertices, habitats):
    own, members = road_shapes(vertices)
    areas, features = kinds(habitats)
    rows = hab.polygon_overlay(own, wetlands(areas), DISTANCES)
    told = rows.groupBy("line_id", "distance", "code").agg(features.alias("features"), geo.half_up(F.sum(F.col("area") * F.col("copies")), 0).alias("area"))
    return lines.of_members(told, members)


def _water_class() -> Column:
    """Water class of an area by its code."""
    return F.when(F.col("code").isin("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"), "flowing").otherwise("standing")


@rows_only("vertices", "habitats")
def hydro_buffers(spark, sf_dir, vertices, habitats):
    """Length of flowlines and area of waterbodies inside every road's buffers, by distance, layer and class."""
    own, members = road_shapes(vertices)
    bodies, features = kinds(habitats.withColumn("code", _water_class()))
    flow = hab.line_overlay(own, water_shapes(vertices)[0], DISTANCES).groupBy("line_id", "distance", "code")
    still = hab.polygon_overlay(own, wetlands(bodies), DISTANCES).groupBy("line_id", "distance", "code")
    metres, area = (geo.half_up(F.sum(F.col(c) * F.col("copies")), 1).alias(c) for c in ("metres", "area"))
    columns = ["line_id", "distance", "layer", "code", "features", "metres", "area"]
    told = [flow.agg(F.sum("copies").alias("features"), metres).withColumns({"layer": F.lit("flowline"), "area": F.lit(0.0)}), still.agg(features.alias("features"), area).withColumns({"layer": F.lit("waterbody"), "metres": F.lit(0.0)})]
    return lines.of_members(told[0].select(columns).union(told[1].select(columns)), members)


@rows_only("vertices")
def water_type_inventory(spark, sf_dir, vertices):
    own, _ = road_shapes(vertices)
    near = as_table(hab.line_overlay(own, water_shapes(vertices)[0], [1000]).select("code", "feature_id", "copies", "line_id"), "near")
    features = near.select("code", "feature_id", "copies").distinct().groupBy("code").agg(F.sum("copies").alias("features"))
    met = near.select("code", "line_id").distinct().join(shuffled(own.select("line_id", "copies")), "line_id")
    return features.join(met.groupBy("code").agg(F.sum("copies").alias("lines")), "code")


def _projection() -> tuple[float, float, float, float]:
    """Cone constant, C, radius of the origin and first eccentricity of EPSG:5070."""
    f = 1 / 298.257222101
    e = math.sqrt(2 * f - f * f)
    south, north, origin = (math.sin(math.radians(d)) for d in (29.5, 45.5, 23.0))
    q = lambda s: (1 - e * e) * (s / (1 - (e * s) ** 2) + math.atanh(e * s) / e)
    m2 = lambda s: (1 - s * s) / (1 - (e * s) ** 2)
    n = (m2(south) - m2(north)) / (q(north) - q(south))
    c = m2(south) + n * q(south)
    return n, c, math.sqrt(c - n * q(origin)) / n, e


def sql_albers(lon: str, lat: str) -> tuple[str, str]:
    """Oracle SQL of EPSG:5070 metres."""
    n, c, origin, e = _projection()
    s = f"sin(radians({lat}))"
    q = f"({1 - e * e!r}e0*({s}/(1 - {e * e!r}e0*{s}*{s}) + ln((1 + {e!r}e0*{s})/(1 - {e!r}e0*{s}))/{2 * e!r}e0))"
    rho, theta = f"(6378137e0*sqrt({c!r}e0 - {n!r}e0*{q})/{n!r}e0)", f"({n!r}e0*(radians({lon}) + {math.radians(96.0)!r}e0))"
    return f"{rho}*sin({theta})", f"{6378137.0 * origin!r}e0 - {rho}*cos({theta})"


def _xy(lon: str, lat: str) -> str:
    x, y = sql_albers(lon, lat)
    return f"{{'x': {x}, 'y': {y}}}"


def _to_segment(px: str, py: str, a: str, b: str) -> str:
    """Oracle SQL of a point's distance to the segment of the columns {a}x, {a}y, {b}x, {b}y."""
    dx, dy = f"({b}x-{a}x)", f"({b}y-{a}y)"
    t = f"greatest(0e0, least(1e0, coalesce((({px}-{a}x)*{dx} + ({py}-{a}y)*{dy})/nullif({dx}*{dx} + {dy}*{dy}, 0), 0e0)))"
    return f"sqrt(pow({px}-{a}x-{t}*{dx}, 2) + pow({py}-{a}y-{t}*{dy}, 2))"


_ROADS = f"{_O}, pv AS MATERIALIZED (SELECT line_id, k, p.x AS x, p.y AS y FROM (SELECT line_id, k, {_xy('lon', 'lat')} AS p FROM o WHERE line_id % 2 = 1))"


@query(
    f"""+ {_ROADS}, s AS (SELECT line_id, x AS ax, y AS ay, coalesce(lead(x) OVER w, x) AS bx, coalesce(lead(y) OVER w, y) AS by_, lead(k) OVER w IS NULL AND k > 1 AS over FROM pv WINDOW w AS (PARTITION BY line_id ORDER BY k)),
c AS MATERIALIZED (SELECT habitat_id, CASE WHEN code IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') THEN 'flowing' ELSE 'standing' END AS code, [{_xy('west', '(south+north)/2')}, {_xy('(west+east)/2', 'south')}, {_xy('east', '(south+north)/2')}, {_xy('(west+east)/2', 'north')}] AS r FROM habitats),
b AS (SELECT *, list_min([v.x for v in r]) AS x0, list_max([v.x for v in r]) AS x1, list_min([v.y for v in r]) AS y0, list_max([v.y for v in r]) AS y1 FROM c),
m AS MATERIALIZED (SELECT line_id, ax, ay, bx, by_ AS by1, habitat_id, code, unnest([{{'p': r[1], 'q': r[2]}}, {{'p': r[2], 'q': r[3]}}, {{'p': r[3], 'q': r[4]}}, {{'p': r[4], 'q': r[1]}}]) AS e FROM s JOIN b ON NOT over AND least(ax, bx) <= x1 + 1000 AND greatest(ax, bx) >= x0 - 1000 AND least(ay, by_) <= y1 + 1000 AND greatest(ay, by_) >= y0 - 1000),
g AS MATERIALIZED (SELECT line_id, habitat_id, code, ax, ay, bx, by1 AS "by", e.p.x AS cx, e.p.y AS cy, e.q.x AS dx, e.q.y AS dy FROM m),
h AS (SELECT line_id, habitat_id, code, ax, ay, bx, "by", count(*) FILTER ((cy > ay) <> (dy > ay) AND ax < (dx-cx)*(ay-cy)/(dy-cy) + cx) % 2 = 1 OR count(*) FILTER ((cy > "by") <> (dy > "by") AND bx < (dx-cx)*("by"-cy)/(dy-cy) + cx) % 2 = 1 AS holds,
bool_or(sign((bx-ax)*(cy-ay) - ("by"-ay)*(cx-ax)) * sign((bx-ax)*(dy-ay) - ("by"-ay)*(dx-ax)) < 0 AND sign((dx-cx)*(ay-cy) - (dy-cy)*(ax-cx)) * sign((dx-cx)*("by"-cy) - (dy-cy)*(bx-cx)) < 0) AS meets,
min(least({_to_segment('ax', 'ay', 'c', 'd')}, {_to_segment('bx', '"by"', 'c', 'd')}, {_to_segment('cx', 'cy', 'a', 'b').replace('by', '"by"')}, {_to_segment('dx', 'dy', 'a', 'b').replace('by', '"by"')})) AS far FROM g GROUP BY ALL),
d AS (SELECT line_id, habitat_id, code, min(CASE WHEN holds OR meets THEN 0e0 ELSE far END) AS metres FROM h GROUP BY ALL)
SELECT line_id, code, arg_min(habitat_id, (metres, habitat_id)) AS feature_id, floor(min(metres)*100+0.5)/100 AS metres FROM d WHERE metres <= 1000 GROUP BY line_id, code""",
    "vertices",
    "habitats",
)
def nearest_by_class(spark, sf_dir, vertices, habitats):
    own, members = road_shapes(vertices)
    areas, _ = kinds(habitats.withColumn("code", _water_class()))
    near = hab.nearest_polygons(own, wetlands(areas), 1000.0)  # of equal areas the smallest id is the nearest
    return lines.of_members(near.select("line_id", "code", "feature_id", geo.half_up(F.col("metres"), 2).alias("metres")), members)


@rows_only("vertices", "habitats")
def overlay_features(spark, sf_dir, vertices, habitats):
    """Every wetland and flowline that meets a road's buffer of 250 m, with its part inside; all of them, without the first 400's cap."""
    own, roads_of = road_shapes(vertices)
    held, _ = kinds(habitats)
    named = habitats.select("habitat_id", "code", *BOUNDS)
    if _unique(habitats):
        areas_of = named.join(shuffled(held.withColumnRenamed("habitat_id", "shape")), ["code", *BOUNDS]).select("habitat_id", "shape")
    else:
        areas_of = named.select("habitat_id", F.col("habitat_id").alias("shape")).distinct()
    water, waters_of = water_shapes(vertices)
    none = F.lit(None).cast("double")

    def told(layer: str, rows: DataFrame, members: DataFrame, area: Column, metres: Column) -> DataFrame:
        each = rows.withColumnRenamed("feature_id", "shape").join(shuffled(members.toDF("feature_id", "shape")), "shape")
        return each.select("line_id", F.lit(layer).alias("layer"), "feature_id", "code", area.alias("area"), metres.alias("metres"))

    wet = told("wetland", hab.polygon_overlay(own, wetlands(held), [250]), areas_of, geo.half_up(F.col("area"), 0), none)
    flow = told("flowline", hab.line_overlay(own, water, [250]), waters_of, none, geo.half_up(F.col("metres"), 1))
    return lines.of_members(wet.union(flow), roads_of)


#: Corners of the published extent in metres of EPSG:5070, counter-clockwise.
EXTENT = [(-2_130_000.0, 2_640_000.0), (-1_830_000.0, 2_560_000.0), (-1_780_000.0, 2_790_000.0), (-2_080_000.0, 2_870_000.0)]


def _gap(p: tuple[float, float], q: tuple[float, float]) -> str:
    return f"(({q[0] - p[0]!r}e0)*(y - ({p[1]!r}e0)) - ({q[1] - p[1]!r}e0)*(x - ({p[0]!r}e0)))/{math.dist(p, q)!r}e0"


_GAPS = f"least({', '.join(_gap(p, q) for p, q in zip(EXTENT, EXTENT[1:] + EXTENT[:1]))})"


@query(f"+ {_ROADS}, g AS (SELECT line_id, min({_GAPS}) AS gap FROM pv GROUP BY line_id) SELECT line_id, gap >= 0 AS inside, gap >= 250 AS covered_250, gap >= 500 AS covered_500, gap >= 1000 AS covered_1000 FROM g", "vertices")
def buffer_coverage(spark, sf_dir, vertices):
    return hab.inside_extent(roads(vertices), EXTENT, DISTANCES)


@rows_only("habitats")
def serving_tiles(spark, sf_dir, habitats):
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    ring = F.array(w, (s + n) / 2, (w + e) / 2, s, e, (s + n) / 2, (w + e) / 2, n)
    return hab.tiles(habitats.select(F.col("habitat_id").alias("feature_id"), "west", "south", "east", "north", ring.alias("ring")), 0.01)


@query(
    f"""+ {_O}, g AS (SELECT line_id, count(*) AS points, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, CASE WHEN line_id % 101 = 1 THEN 'broken WKB' WHEN line_id % 103 = 1 THEN 'no geometry' END AS problem FROM o GROUP BY line_id)
SELECT line_id, CASE WHEN problem IS NULL THEN 2 ELSE 0 END AS kind, CASE WHEN problem IS NULL THEN CAST(1 AS BIGINT) ELSE 0 END AS parts, CASE WHEN problem IS NULL THEN points ELSE 0 END AS points, {', '.join(f"CASE WHEN problem IS NULL THEN {c} END AS {c}" for c in ('west', 'south', 'east', 'north'))}, problem FROM g""",
    "vertices",
)
def geometry_decode(spark, sf_dir, vertices):
    listed = lines.ordered(vertices).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))).alias("p"))
    flat = listed.select("line_id", F.flatten(F.transform("p", lambda v: F.array(v["lon"], v["lat"]))).alias("xy"))

    def encoded(xy: list):
        yield (kernels.encode_wkb(kernels.LINE, [hab._xy(xy)]),)

    stored = hab._measured(flat, ["line_id"], ["xy"], "wkb binary", encoded)
    broken = F.when(F.col("line_id") % 101 == 1, F.substring("wkb", 1, 12)).when(F.col("line_id") % 103 == 1, None).otherwise(F.col("wkb"))
    told = hab.decode(stored.withColumn("wkb", broken), "line_id", "wkb")
    return told.fillna(0, ["kind", "parts", "points"])  # what can't be read has no parts


def road_metrics(picked: DataFrame, vertices: DataFrame, habitats: DataFrame) -> DataFrame:
    """The metrics row of each road of picked (its vertices): wetland area and water length by distance, nearest wetland, coverage; zeros where measured."""
    own, members = road_shapes(picked)
    held, _ = kinds(habitats.withColumn("code", F.lit("wetland")))
    held = wetlands(held)
    areas = hab.polygon_overlay(own, held, DISTANCES).groupBy("line_id").pivot("distance", DISTANCES).agg(F.sum(F.col("area") * F.col("copies")))
    water = hab.line_overlay(own, water_shapes(vertices)[0], DISTANCES).groupBy("line_id").pivot("distance", DISTANCES).agg(F.sum(F.col("metres") * F.col("copies")))
    near = hab.nearest_polygons(own, held, 1000.0).select("line_id", "metres")
    j = own.select("line_id").join(areas.toDF("line_id", *(f"a{d}" for d in DISTANCES)), "line_id", "left").join(water.toDF("line_id", *(f"w{d}" for d in DISTANCES)), "line_id", "left")
    j = j.join(near, "line_id", "left").join(hab.inside_extent(own, EXTENT, DISTANCES), "line_id")
    zero = lambda c, digits: geo.half_up(F.coalesce(c, F.lit(0.0)), digits)
    state = F.when(F.col("covered_1000"), "FULL").when(F.col("covered_250") | F.col("covered_500"), "PARTIAL").otherwise("NONE")
    told = j.select(
        "line_id", *(zero(f"a{d}", 0).alias(f"wetland_area_{d}") for d in DISTANCES), *(zero(f"w{d}", 1).alias(f"water_metres_{d}") for d in DISTANCES), geo.half_up(F.col("metres"), 2).alias("nearest_wetland"), state.alias("coverage")
    )
    return lines.of_members(told, members)


@rows_only("vertices", "habitats")
def corridor_metrics(spark, sf_dir, vertices, habitats):
    return road_metrics(vertices, vertices, habitats)


@rows_only("vertices", "habitats")
def serving_layout(spark, sf_dir, vertices, habitats):
    """Every road's wetland areas within 250 m from whole areas and from their parts on tiles of 2 km."""
    own, members = road_shapes(vertices)
    areas = wetlands(kinds(habitats)[0])
    served = comparison.parts_overlay(own, comparison.serving_parts(areas, 2000.0), [250])
    out = comparison.serving_equivalence(hab.polygon_overlay(own, areas, [250], comparison.fine_area), served)
    return lines.of_members(out.select("line_id", "classes", "mismatches", "ids_equal", "status"), members)


@rows_only("vertices", "habitats")
def sample_remeasure(spark, sf_dir, vertices, habitats):
    """Five stored rows of each coverage and tenth of the ids, measured again from the raw planes (the sample is the feature)."""
    stored = as_table(road_metrics(vertices, vertices, habitats), "metrics")
    sample = comparison.seeded_sample(stored.withColumn("tenth", F.col("line_id") % 10), "line_id", ["coverage", "tenth"], 5, 17).drop("tenth")
    again = road_metrics(vertices.join(sample.select("line_id"), "line_id", "left_semi"), vertices, habitats)
    return comparison.remeasured(sample, again, "line_id").select("line_id", "state", F.array_join("differing", ",").alias("differing"))
