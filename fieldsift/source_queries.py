"""Registered queries of source normalization, spatial batches and the projection's round trip.

The given tables hold no geometry column, so published rows are made of the lines' vertices in many forms of WKB (byte order,
heights, collections, turned copies, faults); the oracle measures the vertices themselves and never sees WKB.
"""

from __future__ import annotations

import struct
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.first_queries import query, sql_haversine
from fieldsift.functions import geo, kernels
from fieldsift.habitat_queries import sql_albers
from fieldsift.line_queries import _O
from fieldsift.operators import comparison, lines, normalize
from fieldsift.operators.habitat import in_batches
from fieldsift.sources.tables import as_table


def published_wkb(xy: list, ring: int, big: int, high: int, nested: int) -> bytes:
    """WKB of flat vertices: a line or closed ring; nested 0 alone, 1 as a collection of its family, 2 after a point."""
    order = ">" if big else "<"
    points = [(xy[i], xy[i + 1]) for i in range(0, len(xy), 2)]
    if ring:
        points.append(points[0])
    head = lambda kind: struct.pack(order + "BI", 0 if big else 1, kind + 1000 * high)
    flat = b"".join(struct.pack(order + ("ddd" if high else "dd"), *p, *([7.5] if high else [])) for p in points)
    kind = kernels.POLYGON if ring else kernels.LINE
    own = head(kind) + (struct.pack(order + "I", 1) if ring else b"") + struct.pack(order + "I", len(points)) + flat
    if nested == 1:
        return head(kernels.MULTI_POLYGON if ring else kernels.MULTI_LINE) + struct.pack(order + "I", 1) + own
    if nested == 2:
        return head(kernels.COLLECTION) + struct.pack(order + "I", 2) + head(1) + struct.pack(order + ("ddd" if high else "dd"), *([1.0] * (2 + high))) + own
    return own


def published_together(xy: list, *forms: list) -> list[list]:
    """The column of published_wkb of many rows: rows of one form and length are written at once after a first one's header."""
    out: list = [None] * len(xy)
    groups = defaultdict(list)
    for i, key in enumerate(zip(map(len, xy), *forms)):
        groups[key].append(i)
    for (size, ring, big, high, nested), at in groups.items():
        points = np.array([xy[i] for i in at], float).reshape(len(at), size // 2, 2)
        if ring:
            points = np.concatenate([points, points[:, :1]], axis=1)
        if high:
            points = np.concatenate([points, np.full((*points.shape[:2], 1), 7.5)], axis=2)
        data, wide = points.astype(">f8" if big else "<f8").tobytes(), points[0].size * 8
        head = published_wkb(xy[at[0]], ring, big, high, nested)[:-wide]
        for n, i in enumerate(at):
            out[i] = head + data[n * wide : (n + 1) * wide]
    return [out]


def published(vertices: DataFrame) -> DataFrame:
    """Source rows of all lines; every sixth is published by a second unit, turned and in the other byte order."""
    listed = lines.ordered(vertices).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))).alias("p"))  # one line's vertices
    flat = lambda p: F.flatten(F.transform(p, lambda v: F.array(v["lon"], v["lat"])))
    ring = (F.col("line_id") % 4 == 0) & (F.size("p") > 2)
    back = F.reverse("p")
    turned = F.when(ring, F.concat(F.slice(back, 2, F.size("p") - 1), F.slice(back, 1, 1))).otherwise(back)
    rows = listed.withColumn("ring", ring.cast("int"))
    own = rows.select("line_id", F.lit("own").alias("unit"), "ring", (F.col("line_id") % 2).cast("int").alias("big"), flat("p").alias("xy"))
    copy = rows.where("line_id % 6 = 0").select("line_id", F.lit("copy").alias("unit"), "ring", (1 - F.col("line_id") % 2).cast("int").alias("big"), flat(turned).alias("xy"))
    rows = own.union(copy).withColumns({"high": (F.col("line_id") % 3 == 0).cast("int"), "nested": F.when(F.col("line_id") % 7 == 0, 2).when(F.col("line_id") % 5 == 0, 1).otherwise(0)})
    stored = in_batches(rows, ["line_id", "unit", "ring"], ["xy", "ring", "big", "high", "nested"], "wkb binary", published_together)
    i = F.col("line_id")
    point = F.unhex(F.lit("0101000000" + "00" * 16))
    wkb = F.when(i % 101 == 1, None).when(i % 103 == 1, F.substring("wkb", 1, 12)).when(i % 97 == 1, point).otherwise(F.col("wkb"))
    kinds = F.array(*map(F.lit, (460, 390, 336, 566)))
    return stored.select(
        i.alias("objectid"), "unit", F.when(F.col("ring") == 1, "polygon").otherwise("line").alias("member"), F.when(i % 13 != 0, F.concat(F.lit(" "), i.cast("string"))).alias("identifier"),
        F.concat(F.lit("R"), (i % 1000).cast("string")).alias("reach_code"), F.when((i % 18 == 0) & (F.col("unit") == "copy"), "other name").alias("name"),
        F.get(kinds, (i % 5).cast("int")).alias("ftype"), (i % 3).alias("fcode"), (i / 7.0).alias("length_km"), F.lit(None).cast("double").alias("area_km2"), wkb.alias("wkb"),
    )


_X, _Y = sql_albers("lon", "lat")
_ROT = "list_min(list_transform(range(0, len({l})), lambda i: array_to_string(list_concat({l}[i+1:], {l}[:i]), ' ')))"
_CYCLE = lambda l: f"least({_ROT.format(l=l)}, {_ROT.format(l=f'list_reverse({l})')})"
_SOURCE = f"""{_O}, m AS MATERIALIZED (SELECT line_id, k, xu, yu, lon, lat, {_X} AS x, {_Y} AS y FROM o),
s AS (SELECT *, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS leg, (x - first(x) OVER w)*(lead(y) OVER w - first(y) OVER w) - (lead(x) OVER w - first(x) OVER w)*(y - first(y) OVER w) AS twice FROM m WINDOW w AS (PARTITION BY line_id ORDER BY k)),
t AS (SELECT line_id, count(*) AS n, line_id % 4 = 0 AND count(*) > 2 AS ring, coalesce(sum(leg), 0e0) AS metres, abs(coalesce(sum(twice), 0e0))/2 AS area, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, list(concat(xu, ',', yu) ORDER BY k) AS l FROM s GROUP BY line_id),
k AS MATERIALIZED (SELECT * EXCLUDE (l), CASE WHEN ring THEN {_CYCLE('l')} WHEN n > 2 AND l[1] = l[n] THEN concat('o ', {_CYCLE('l[:n-1]')}) ELSE least(array_to_string(l, ' '), array_to_string(list_reverse(l), ' ')) END AS shape,
CASE WHEN line_id % 101 = 1 THEN 'no geometry' WHEN line_id % 103 = 1 THEN 'broken' WHEN line_id % 97 = 1 THEN 'other geometry' ELSE 'kept' END AS state FROM t),
h AS MATERIALIZED (SELECT line_id AS objectid, 'own' AS unit, CAST(NULL AS VARCHAR) AS name, * FROM k UNION ALL SELECT line_id, 'copy', CASE WHEN line_id % 18 = 0 THEN 'other name' END, * FROM k WHERE line_id % 6 = 0)"""


@query(
    f"""+ {_SOURCE} SELECT objectid, unit, state, CASE line_id % 5 WHEN 0 THEN 'flowing' WHEN 1 THEN 'standing' WHEN 2 THEN 'flowing' ELSE 'other' END AS water_class,
CASE WHEN state = 'kept' THEN n + CAST(ring AS BIGINT) ELSE 0 END AS points, CASE WHEN state = 'kept' AND NOT ring THEN floor(metres*1000+0.5)/1000 END AS length_m, CASE WHEN state = 'kept' AND ring THEN floor(floor(area*1000+0.5)/1000+0.5) END AS area_m2,
{', '.join(f"CASE WHEN state = 'kept' THEN {c} END AS {c}" for c in ('min_lon', 'min_lat', 'max_lon', 'max_lat'))},
CASE WHEN state = 'kept' THEN count(*) OVER (PARTITION BY state, ring, shape) ELSE 0 END AS same_shape, CASE WHEN state = 'kept' THEN count(*) OVER (PARTITION BY state, ring, shape, line_id, name) ELSE 0 END AS agreeing FROM h""",
    "vertices",
)
def hydro_normalization(spark, sf_dir, vertices):
    """Every published row normalised, with the number of rows of its digest and of its whole signature and objectid."""
    out = as_table(normalize.normalize_hydro(published(vertices)), "hydro")  # the published table, read by both counts
    shape = out.where("state = 'kept'").groupBy("member", "geometry_digest").agg(F.count("*").alias("same_shape"))
    agreed = out.where("state = 'kept'").groupBy("objectid", "signature").agg(F.count("*").alias("agreeing"))
    out = out.join(shape, ["member", "geometry_digest"], "left").join(agreed, ["objectid", "signature"], "left")
    return out.select("objectid", "unit", "state", "water_class", "points", "length_m", geo.half_up(F.col("area_m2"), 0).cast("double").alias("area_m2"), "min_lon", "min_lat", "max_lon", "max_lat", "same_shape", "agreeing").fillna(0, ["points", "same_shape", "agreeing"])


@query(
    f"""+ {_SOURCE} SELECT unit, count(*) AS input_rows, count(*) FILTER (state = 'kept') AS output_rows, count(*) FILTER (state = 'no geometry') AS dropped_empty, count(*) FILTER (state = 'other geometry') AS dropped_other,
count(*) FILTER (state = 'broken') AS broken, count(*) FILTER (state = 'kept' AND n < 2) AS malformed, count(*) FILTER (state = 'kept' AND line_id % 13 = 0) AS blank_identity, count(*) FILTER (state = 'kept' AND NOT ring) AS lines, count(*) FILTER (state = 'kept' AND ring) AS polygons,
floor(coalesce(sum(floor(metres*1000+0.5)/1000) FILTER (state = 'kept' AND NOT ring), 0e0)/1000+0.5) AS km FROM h GROUP BY unit""",
    "vertices",
)
def hydro_unit_stats(spark, sf_dir, vertices):
    stats = normalize.unit_stats(normalize.normalize_hydro(published(vertices)))
    return stats.withColumn("km", geo.half_up(F.col("length_m") / 1000, 0)).drop("length_m", "area_m2")


@query(
    f"""+ {_SOURCE} SELECT objectid, unit, CASE WHEN state = 'kept' AND NOT ring THEN 'other geometry' ELSE state END AS state, CASE WHEN state = 'kept' AND ring THEN floor(floor(area*1000+0.5)/1000+0.5) END AS area_m2,
CASE WHEN state = 'kept' AND ring THEN count(*) OVER (PARTITION BY state, ring, line_id, name) ELSE 0 END AS agreeing FROM h""",
    "vertices",
)
def wetland_normalization(spark, sf_dir, vertices):
    """Areas of every package alone; lines are another geometry here. Rows agree where all of identifier, attributes and digest do."""
    source = published(vertices).select("objectid", F.col("unit").alias("state_code"), "identifier", F.col("reach_code").alias("attribute"), F.lit("pond").alias("wetland_type"), F.col("name").alias("qaqc_code"), F.col("length_km").alias("acres"), "wkb")
    out = as_table(normalize.normalize_wetlands(source), "wetlands")
    agreed = out.where("state = 'kept'").groupBy("objectid", "semantic_digest").agg(F.count("*").alias("agreeing"))
    return out.join(agreed, ["objectid", "semantic_digest"], "left").select("objectid", F.col("state_code").alias("unit"), "state", geo.half_up(F.col("area_m2"), 0).cast("double").alias("area_m2"), "agreeing").fillna(0, ["agreeing"])


@query("""WITH r AS (SELECT trim(p_brand) AS code, CASE WHEN p_partkey % 1000 = 7 THEN concat(p_brand, ' hils') ELSE concat(p_brand, ' hills') END AS name, p_partkey % 211 = 5 AS missing FROM part),
n AS (SELECT code, string_agg(name, '|' ORDER BY name) AS names, sum(n) AS regions FROM (SELECT code, name, count(*) AS n FROM r WHERE NOT missing GROUP BY code, name) GROUP BY code HAVING count(*) > 1)
SELECT code, count(*) AS all_regions, count(*) FILTER (missing) AS problems, coalesce(any_value(n.names), '') AS names, CAST(coalesce(any_value(n.regions), 0) AS BIGINT) AS named FROM r LEFT JOIN n USING (code) GROUP BY code""")
def ecoregion_ingest(spark, sf_dir):
    """Regions per code, those without a name, and the names where a code was published under several."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    i = F.col("p_partkey")
    name = F.concat(F.col("p_brand"), F.when(i % 1000 == 7, F.lit(" hils ")).otherwise(F.lit(" hills")))
    level = part.select(F.concat(F.lit(" "), "p_brand").alias("code"), F.when(i % 211 != 5, name).alias("name"), F.col("p_type").alias("upper_code"), F.col("p_type").alias("upper_name"))
    checked, several = normalize.read_level(level)
    codes = checked.groupBy("code").agg(F.count("*").alias("all_regions"), F.count("problem").alias("problems"))
    return codes.join(several, "code", "left").select("code", "all_regions", "problems", F.coalesce(F.array_join("names", "|"), F.lit("")).alias("names"), F.coalesce("regions", F.lit(0)).alias("named"))


@query("""SELECT chunk, count(*) AS n, min(corridor_id) AS first_id, arg_min(corridor_id, position) AS begins, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north
FROM (SELECT *, CAST(floor(position/25) AS BIGINT) AS chunk FROM (SELECT *, row_number() OVER (ORDER BY floor(west/0.2e0), floor(south/0.2e0), corridor_id) - 1 AS position FROM corridors)) GROUP BY chunk""", "corridors")
def spatial_chunks(spark, sf_dir, corridors):
    """Batches of 25 neighbouring roads with their bounds."""
    out = normalize.chunk_order(corridors, "corridor_id")
    return out.groupBy("chunk").agg(F.count("*").alias("n"), F.min("corridor_id").alias("first_id"), F.min_by("corridor_id", "position").alias("begins"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


@query(f"+ p AS (SELECT place_id, lon, lat, {_X} AS x, {_Y} AS y FROM places) SELECT place_id, floor(x*1000+0.5)/1000 AS x, floor(y*1000+0.5)/1000 AS y, floor(lon*1e9+0.5)/1e9 AS lon, floor(lat*1e9+0.5)/1e9 AS lat FROM p", "places")
def projection_round_trip(spark, sf_dir, places):
    """Metres of EPSG:5070, and the degrees that its inverse gives back."""
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    lon, lat = geo.albers_inverse(F.col("px"), F.col("py"))
    out = places.select("place_id", x.alias("px"), y.alias("py"))
    return out.select("place_id", geo.half_up(F.col("px"), 3).alias("x"), geo.half_up(F.col("py"), 3).alias("y"), geo.half_up(lon, 9).alias("lon"), geo.half_up(lat, 9).alias("lat"))


def _vintage(points: DataFrame) -> DataFrame:
    """What one plane says of its lines: length, western end, number of different vertices, cell of the lower-left corner."""
    length = lines.segments(points).groupBy("line_id").agg(F.sum(lines.leg()).alias("length_m"))
    ends = points.groupBy("line_id").agg(F.min("lon").alias("west"), F.count_distinct("xu", "yu").alias("points"), F.concat_ws("_", geo.cell_index(F.min("lon")), geo.cell_index(F.min("lat"))).alias("cell"))
    return ends.join(length, "line_id", "left")


_PLANE = f"""SELECT line_id, any_value(length_m) AS length_m, min(lon) AS west, count(DISTINCT (xu, yu)) AS points, concat(CAST(floor(min(lon)/0.2e0) AS BIGINT), '_', CAST(floor(min(lat)/0.2e0) AS BIGINT)) AS cell
FROM (SELECT *, sum(leg) OVER (PARTITION BY line_id) AS length_m FROM (SELECT *, {sql_haversine('lon', 'lat', 'b', 'c')} AS leg FROM (SELECT *, lead(lon) OVER w AS b, lead(lat) OVER w AS c FROM {{}} WINDOW w AS (PARTITION BY line_id ORDER BY k)))) GROUP BY line_id"""
_DELTA = "CASE WHEN l.{f} IS NOT NULL AND r.{f} IS NOT NULL THEN abs(l.{f}-r.{f})/greatest(abs(l.{f}), abs(r.{f}), 1e-9) END"


@query(
    f"""+ {_O}, z AS (SELECT line_id, k, xu, yu, xu/1e6 AS lon, yu/1e6 AS lat FROM (SELECT line_id, k, CAST(floor((xu+250)/500e0)*500 AS BIGINT) AS xu, CAST(floor((yu+250)/500e0)*500 AS BIGINT) AS yu FROM o)),
l AS ({_PLANE.format('o')}), r AS ({_PLANE.format('z')}),
d AS (SELECT 'length_m' AS field, {_DELTA.format(f='length_m')} AS v, (l.length_m IS NULL) <> (r.length_m IS NULL) AS off FROM l JOIN r USING (line_id) UNION ALL SELECT 'west', {_DELTA.format(f='west')}, false FROM l JOIN r USING (line_id)
 UNION ALL SELECT 'points', CAST(abs(l.points-r.points) AS DOUBLE), abs(l.points-r.points) > 1 FROM l JOIN r USING (line_id) UNION ALL SELECT 'cell', NULL, l.cell <> r.cell FROM l JOIN r USING (line_id)),
s AS (SELECT field, count(*) AS n, count(*) FILTER (off) AS mismatches, count(v) AS m, list_sort(list(v) FILTER (v IS NOT NULL)) AS v FROM d GROUP BY field),
q AS (SELECT field, n, mismatches, v[m//2+1] AS median, v[CAST(least(m-1, round_even(0.95e0*(m-1), 0)) AS BIGINT)+1] AS p95, v[m] AS most FROM s)
SELECT field, n, mismatches, floor(median*1e9+0.5)/1e9 AS median, floor(p95*1e9+0.5)/1e9 AS p95, floor(most*1e9+0.5)/1e9 AS most,
CASE field WHEN 'length_m' THEN mismatches = 0 AND p95 <= 0.05 WHEN 'west' THEN mismatches = 0 AND p95 <= 1e-9 WHEN 'cell' THEN mismatches/n <= 1 - 0.95e0 ELSE mismatches/n <= 1 - 0.995e0 END AS passed FROM q""",
    "vertices",
)
def vintage_gates(spark, sf_dir, vertices):
    """Lines against a coarser vintage of them, with vertices on half a thousandth of a degree: deltas per field and whether its gate holds."""
    o = lines.ordered(vertices)
    on = lambda c: (F.floor((F.col(c) + 250) / 500.0) * 500).cast("long")
    coarse = o.withColumns({"xu": on("xu"), "yu": on("yu")}).withColumns({"lon": F.col("xu") / 1e6, "lat": F.col("yu") / 1e6})
    out = comparison.plane_gates(_vintage(o), _vintage(coarse), "line_id", {"length_m": 0.05, "west": 1e-9}, {"cell": 0.95}, {"points": 1})
    return out.select("field", "n", "mismatches", *(geo.half_up(F.col(c), 9).alias(c) for c in ("median", "p95", "most")), "passed")
