"""Published source rows to normalised rows: one pass over the geometry in Arrow batches, all else column expressions.

A row with no shape, no part of the wanted family or bytes that can't be read stays, with its state and without measures, so
that nothing vanishes silently; `kept` rows are what is published and `unit_stats` counts all of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsift.functions import geo, shapes
from fieldsift.operators.habitat import in_batches

#: Feature types of water that flow and that stand.
FLOWING, STANDING = (334, 336, 460, 558), (361, 378, 390, 436, 466)
#: Vertices of a line or ring above which rows are measured one by one.
MANY = 64
_SHAPE = "state string, malformed int, parts long, points long, length_m double, area_m2 double, min_lon double, min_lat double, max_lon double, max_lat double, geometry_digest string, geometry binary"


def with_shape(rows: DataFrame, family: str, column: str) -> DataFrame:
    """rows, their WKB column (lon, lat) replaced by state, measures, bounds, digest and stored geometry.

    family names a column that holds 'line' or 'polygon'. state is 'kept', 'no geometry' (null or no bytes), 'other geometry'
    or 'broken' (no WKB, or coordinates that are no numbers).
    """

    fields = T.StructType.fromDDL(_SHAPE).names

    def measure(data: bytes, kind: str) -> tuple:
        try:
            parts = shapes.family_parts(data, kind)
        except ValueError:
            return "broken", *[None] * 11
        if not parts:
            return "other geometry", *[None] * 11
        if not all(np.isfinite(a).all() for p in parts for a in p):
            return "broken", *[None] * 11
        every = np.concatenate([a for p in parts for a in p])
        low, high = every.min(axis=0), every.max(axis=0)
        measures = (shapes.length(parts), None) if kind == "line" else (None, shapes.area(parts))
        return "kept", int(shapes.malformed(parts, kind)), len(parts), len(every), *measures, *map(float, (*low, *high)), shapes.digest(shapes.normal_parts(parts), kind), shapes.stored_wkb(parts, kind)

    def together(data: list, kinds: list) -> list[list]:
        """Columns of fields: rows of one layout with one line or ring are measured at once, all others one by one."""
        out = [["no geometry"] * len(data), *([None] * len(data) for _ in fields[1:])]

        def put(places: list, columns: list) -> None:
            for held, column in zip(out, columns):
                for i, v in zip(places, column):
                    held[i] = v

        for kind in shapes.FAMILIES:
            asked = [i for i, d in enumerate(data) if d and kinds[i] == kind]
            groups, alone = shapes.alike([data[i] for i in asked], kind)
            for places, parts, rows in groups:
                if not parts:
                    put([asked[i] for i in places], [["other geometry"] * len(places)])
                elif len(parts) > 1 or len(parts[0]) > 1 or not 0 < parts[0][0][1] <= MANY:
                    alone += places.tolist()
                else:
                    xy = shapes.stacked(rows, parts[0][0])
                    whole = np.isfinite(xy).all(axis=(1, 2))
                    put([asked[i] for i in places[~whole]], [["broken"] * len(places)])
                    if whole.any():
                        put([asked[i] for i in places[whole]], [["kept"] * len(places), *shapes.measured_stack(xy[whole], kind).values()])
            for i in alone:
                put([asked[i]], [[v] for v in measure(data[asked[i]], kind)])
        return out

    keep = [c for c in rows.columns if c != column]
    out = in_batches(rows, keep, [column, family], _SHAPE, together)
    return out.withColumn("malformed", F.col("malformed") == 1).withColumns({c: geo.half_up(F.col(c), 3) for c in ("length_m", "area_m2")})


def _signature(*values: Column) -> Column:
    """SHA-256 of the values joined by NUL; a null is empty."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(v.cast("string"), F.lit("")) for v in values)), 256)


def normalize_hydro(rows: DataFrame) -> DataFrame:
    """rows (unit, objectid, member: line or polygon, identifier, reach_code, name, ftype, fcode, length_km, area_km2, wkb) normalised.

    Two rows are one published feature only where member, identifier and signature agree; the signature holds the digest.
    """
    out = with_shape(rows, "member", "wkb").withColumn("identifier", F.trim(F.coalesce("identifier", F.lit(""))))
    water = F.when(F.col("ftype").isin(*FLOWING), "flowing").when(F.col("ftype").isin(*STANDING), "standing").otherwise("other")
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c).cast("double")))
    signed = _signature(F.col("reach_code"), F.col("name"), F.col("ftype"), F.col("fcode"), number("length_km"), number("area_km2"), F.col("geometry_digest"))
    return out.withColumn("water_class", water).withColumn("signature", F.when(F.col("state") == "kept", signed))


def normalize_wetlands(rows: DataFrame) -> DataFrame:
    """rows (state_code, objectid, identifier, attribute, wetland_type, qaqc_code, acres, wkb) normalised; polygons alone are kept."""
    out = with_shape(rows.withColumn("member", F.lit("polygon")), "member", "wkb").drop("length_m")
    filled = out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("identifier", "attribute", "wetland_type", "qaqc_code")}).withColumn("acres", F.coalesce(F.col("acres").cast("double"), F.lit(0.0)))
    signed = _signature(*(F.col(c) for c in ("identifier", "attribute", "wetland_type", "qaqc_code", "geometry_digest")))
    return filled.withColumn("semantic_digest", F.when(F.col("state") == "kept", signed)).withColumn("identifier", F.trim("identifier"))


def unit_stats(normal: DataFrame) -> DataFrame:
    """Per unit: rows read, kept and dropped by reason, malformed, without identifier, lines, polygons, metres and square metres."""
    kept = F.col("state") == "kept"
    return normal.groupBy("unit").agg(
        F.count("*").alias("input_rows"), F.count_if(kept).alias("output_rows"), F.count_if(F.col("state") == "no geometry").alias("dropped_empty"),
        F.count_if(F.col("state") == "other geometry").alias("dropped_other"), F.count_if(F.col("state") == "broken").alias("broken"), F.count_if(kept & F.col("malformed")).alias("malformed"),
        F.count_if(kept & (F.col("identifier") == "")).alias("blank_identity"), F.count_if(kept & (F.col("member") == "line")).alias("lines"), F.count_if(kept & (F.col("member") == "polygon")).alias("polygons"),
        geo.half_up(F.coalesce(F.sum("length_m"), F.lit(0.0)), 1).alias("length_m"), geo.half_up(F.coalesce(F.sum("area_m2"), F.lit(0.0)), 1).alias("area_m2"),
    )


def read_level(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions of one level (code, name, upper_code, upper_name) trimmed, with a problem where one is missing; and the codes that
    were published under several names, with these in order. Names are reported, never chosen: all rows stay."""
    fields = ("code", "name", "upper_code", "upper_name")
    trimmed = rows.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in fields})
    problem = F.when(F.least(*(F.length(c) for c in fields)) == 0, "missing code or name")
    checked = trimmed.withColumn("problem", problem)
    named = checked.where("problem is null").groupBy("code", "name").agg(F.count("*").alias("n"))
    several = named.groupBy("code").agg(F.array_sort(F.collect_list("name")).alias("names"), F.sum("n").alias("regions")).where(F.size("names") > 1)
    return checked, several


def chunk_order(rows: DataFrame, key: str, size: int = 25, cell: float = geo.CELL, run: int = 4096) -> DataFrame:
    """rows with position (from 0) by the cell of the lower-left corner and a whole-numbered unique key, and chunk of `size` rows.

    Counts of runs of keys inside each cell are summed up, so no group holds more than `run` keys, however full a cell is;
    the one window without a partition runs over cells, whose number the grid bounds.
    """
    from pyspark.sql import Window as W

    placed = rows.withColumns({"cell_x": geo.cell_index(F.col("west"), cell), "cell_y": geo.cell_index(F.col("south"), cell), "_run": F.floor(F.col(key) / run)})
    runs = placed.groupBy("cell_x", "cell_y", "_run").agg(F.count("*").alias("_n"))
    cells = runs.groupBy("cell_x", "cell_y").agg(F.sum("_n").alias("_in_cell"))
    before = F.coalesce(F.sum("_in_cell").over(W.orderBy("cell_x", "cell_y").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy("cell_x", "cell_y").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = runs.withColumn("_earlier", earlier).join(cells.withColumn("_before", before), ["cell_x", "cell_y"])
    begins = begins.select("cell_x", "cell_y", "_run", (F.col("_before") + F.col("_earlier")).alias("_begin"))
    inner = F.row_number().over(W.partitionBy("cell_x", "cell_y", "_run").orderBy(key)) - 1
    out = placed.withColumn("_inner", inner).join(begins, ["cell_x", "cell_y", "_run"])
    out = out.withColumn("position", (F.col("_begin") + F.col("_inner")).cast("long"))
    return out.withColumn("chunk", F.floor(F.col("position") / size).cast("long")).drop("_run", "_inner", "_begin")
