"""Relational operators on planes of cells and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsift.functions import geo
from fieldsift.operators.components import components
from fieldsift.sources.tables import as_table, shuffled

BOUNDS = ("west", "south", "east", "north")


def bounds(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + x) for x in BOUNDS)


def empty_relation(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows with the declared columns."""
    return spark.createDataFrame([], schema)


def member_cells(features: DataFrame, size: float = geo.CELL) -> DataFrame:
    """Each feature once per grid cell that its bounds meet (x, y)."""
    return features.withColumn("_cell", F.explode(geo.cells(*bounds(), size))).withColumns({"x": F.col("_cell.x"), "y": F.col("_cell.y")}).drop("_cell")


def dedupe_replicas(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One replica per key, the first by order."""
    rank = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_at", F.row_number().over(rank)).where("_at = 1").drop("_at")


def guard(rows: DataFrame, limit: int) -> DataFrame:
    """rows, unless there are more than limit: then an error instead of a silently cut result."""
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    return rows


def pad_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, metres: float, carry: tuple[str, ...] = (), held: tuple[str, ...] = (), size: float = geo.CELL) -> DataFrame:
    """Pairs of left and right whose bounds meet once left is padded by metres, with left's columns of held and right's of carry.

    Both sides go to grid cells and meet by an equality join on the cell, so no nested loop; a pair is kept in the one
    cell that holds the lower-left corner of its overlap, so nothing has to be deduplicated. Hot cells can be split by AQE.
    """
    w, s, e, n = geo.padded(*bounds(), metres)
    a = left.select(left_key, *held, w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))
    a = member_cells(a, size).select(left_key, *held, "x", "y", *(F.col(c).alias(f"a_{c}") for c in BOUNDS))
    b = member_cells(right.select(right_key, *carry, *BOUNDS), size).select(right_key, *carry, "x", "y", *(F.col(c).alias(f"b_{c}") for c in BOUNDS))
    first = (geo.cell_index(F.greatest("a_west", "b_west"), size) == F.col("x")) & (geo.cell_index(F.greatest("a_south", "b_south"), size) == F.col("y"))
    meets = geo.overlaps(*bounds("a_"), bounds("b_"))
    return a.join(shuffled(b), ["x", "y"]).where(meets & first).select(left_key, right_key, *held, *carry)


def _within(points: DataFrame, places: DataFrame, point_key: str, metres: float) -> DataFrame:
    """points and the places within metres of each: point_key, metres and places' columns. Cells are as wide as metres."""
    size = metres / 110_000.0  # a little more than metres, as a degree of latitude has 111,195 m
    high = F.radians(F.least(F.abs(F.col("lat")) + size, F.lit(89.0)))
    wide = F.lit(size) / F.cos(high)
    span = lambda c, reach: F.explode(F.sequence(geo.cell_index(F.col(c) - reach, size), geo.cell_index(F.col(c) + reach, size)))
    asked = points.select(point_key, "lon", "lat").withColumn("bx", span("lon", wide)).withColumn("by", span("lat", F.lit(size)))
    held = places.withColumnsRenamed({"lon": "p_lon", "lat": "p_lat"})
    held = held.withColumns({"bx": geo.cell_index(F.col("p_lon"), size), "by": geo.cell_index(F.col("p_lat"), size)})
    far = geo.haversine(F.col("lon"), F.col("lat"), F.col("p_lon"), F.col("p_lat"))
    return asked.join(shuffled(held), ["bx", "by"]).withColumn("metres", far).where(F.col("metres") <= metres)


def nearest(points: DataFrame, places: DataFrame, point_key: str, place_key: str, metres: float, tie_order: tuple[str, ...] = (), tie: float = 0.0, per_search: float = 3.0) -> DataFrame:
    """The nearest place within metres of each point: point_key, place_key, metres.

    Places no more than tie metres farther than the nearest are ties; the first by tie_order and key is taken. The search
    widens: it starts with a radius that holds about per_search places where places lie, and only points without a hit
    look in a wider one, so that pairs grow with the points and not with the places' density.
    """
    held = places.select(place_key, *tie_order, "lon", "lat")
    seen = held.groupBy(geo.cell_index(F.col("lon"), 0.05), geo.cell_index(F.col("lat"), 0.05)).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("cells")).first()
    if not seen["n"]:
        return points.select(point_key).withColumn(place_key, F.lit(None).cast(held.schema[place_key].dataType)).withColumn("metres", F.lit(None).cast("double")).limit(0)
    radius = min(metres, 3000.0 * (per_search * seen["cells"] / seen["n"]) ** 0.5)
    left, out = points.select(point_key, "lon", "lat"), None
    while True:
        pairs = _within(left, held, point_key, radius).select(point_key, "metres", *tie_order, place_key)
        least = pairs.groupBy(point_key).agg(F.min("metres").alias("least"))  # combined on the map side
        if radius < metres:
            least = least.where(F.col("least") <= radius - tie)  # all ties lie inside
        best = pairs.join(least, point_key).where(F.col("metres") <= F.col("least") + tie).groupBy(point_key).agg(F.min(F.struct(*tie_order, place_key, "metres")).alias("best"))
        found = best.select(point_key, F.col(f"best.{place_key}").alias(place_key), F.col("best.metres").alias("metres"))
        out = found if out is None else out.unionByName(found)
        if radius >= metres:
            return out
        left = as_table(left.join(least, point_key, "left_anti"), "nearest-left")
        radius = min(metres, radius * 2.5)


def content_digest(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and name: count, sum and exclusive or of two independent hashes of each group's rows, whatever their order.

    The multiset decides: no list is collected, so a group may be of any size and is combined on the map side.
    """
    others = [c for c in rows.columns if c not in keys]
    first, second = F.xxhash64(*others), F.xxhash64(F.lit(1), *reversed(others))
    parts = F.struct(F.count("*").alias("n"), F.sum(first.cast("decimal(38,0)")).alias("sum"), F.bit_xor(second).alias("xor"), F.sum(second.cast("decimal(38,0)")).alias("sum2"))
    return rows.groupBy(*keys).agg(parts.alias(name))


def changed_groups(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """keys and state (new, lost or changed) of the groups whose rows differ between two builds."""
    both = content_digest(now, keys, "now").join(content_digest(before, keys, "before"), keys, "full")
    state = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "lost").when(F.col("now") != F.col("before"), "changed")
    return both.withColumn("state", state).where("state is not null").select(*keys, "state")


def manifest(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """x, y, state (present or empty) and row_count of every declared cell."""
    counted = rows.groupBy("x", "y").agg(F.count("*").alias("n"))
    joined = cells.join(counted, ["x", "y"], "left")
    return joined.select("x", "y", F.when(F.col("n") > 0, "present").otherwise("empty").alias("state"), F.coalesce("n", F.lit(0).cast("long")).alias("row_count"))


def resolve_identity(rows: DataFrame, key: str, package: str, signature: str, order: list[str]) -> DataFrame:
    """rows with identity: blank, unique, canonical, duplicate or ambiguous.

    Copies with one signature keep the first by order as canonical; an id with several signatures is ambiguous.
    """
    per = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("_copies"), F.count_distinct(signature).alias("_kinds"), F.min(F.struct(*order)).alias("_first")
    )
    joined = rows.join(per, key, "left")
    state = (
        F.when(F.col(key).isNull(), "blank")
        .when(F.col("_copies") == 1, "unique")
        .when(F.col("_kinds") > 1, "ambiguous")
        .when(F.struct(*order) == F.col("_first"), "canonical")
        .otherwise("duplicate")
    )
    return joined.withColumn("identity", state).drop("_copies", "_kinds", "_first")


def endpoint_edges(points: DataFrame, key: str, name: str, metres: float) -> DataFrame:
    """Edges (a > b) by which points of equal name hang together in steps of metres or less.

    All points of a bin lie within metres of each other, so each is tied to the bin's smallest key alone. Between bins in
    reach, points are compared, but one edge per pair of bins is kept: edges grow with points and bins, not with pairs.
    """
    size = metres / 111_320.0 / 1.5  # the diagonal of a bin is shorter than metres
    reach = metres / 110_000.0
    cosine = lambda low: F.cos(F.radians(F.least(F.greatest(F.abs(low), F.abs(low + size)), F.lit(89.0))))
    row = lambda by: F.lit(size) / cosine(by * F.lit(size))  # noqa: E731  width of the bins of a row, in degrees
    binned = points.select(F.col(key).alias("k"), F.col(name).alias("n"), "lon", "lat").withColumn("by", geo.cell_index(F.col("lat"), size))
    binned = binned.withColumn("bx", F.floor(F.col("lon") / row(F.col("by"))).cast("long"))
    firsts = binned.groupBy("n", "bx", "by").agg(F.min("k").alias("first"))
    held = binned.join(shuffled(firsts), ["n", "bx", "by"])
    inside = held.where("k > first").select(F.col("k").alias("a"), F.col("first").alias("b"))
    # nearness is mutual: each pair of bins is met once, from the one below (of a row: from the one to the left)
    asked = held.withColumnsRenamed({"by": "own_y", "bx": "own_x"}).withColumn("by", F.explode(F.sequence("own_y", geo.cell_index(F.col("lat") + reach, size))))
    aside = F.lit(reach) / F.cos(F.radians(F.least(F.abs("lat") + reach, F.lit(89.0))))
    at = lambda lon: F.floor(lon / row(F.col("by"))).cast("long")
    left, right = F.when(F.col("by") == F.col("own_y"), F.col("own_x") + 1).otherwise(at(F.col("lon") - aside)), at(F.col("lon") + aside)
    asked = asked.withColumn("bx", F.explode(F.when(left <= right, F.sequence(left, right))))
    other = held.select("n", "bx", "by", F.col("first").alias("b"), F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat"))
    far = geo.haversine(F.col("lon"), F.col("lat"), F.col("o_lon"), F.col("o_lat"))
    met = asked.join(shuffled(other), ["n", "bx", "by"]).where((F.col("first") != F.col("b")) & (far <= metres))
    between = met.select(F.greatest("first", "b").alias("a"), F.least("first", "b").alias("b")).distinct()
    return inside.union(between)


def connected_components(nodes: DataFrame, key: str, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """key, component (smallest key reachable) of every node; raises RuntimeError where max_rounds don't settle it."""
    found = components(edges, max_rounds)
    joined = nodes.select(key).distinct().join(shuffled(found), F.col(key) == F.col("node"), "left")
    return joined.select(key, F.coalesce("component", key).alias("component"))
