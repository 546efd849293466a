"""Registered queries of the search: eligibility, filters, orders, coverage, labels and notes, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldsift.functions import geo
from fieldsift.operators import relations as rel
from fieldsift.first_queries import _DIST, _NEAR, BOX, MILES, SCORED, interest, query, search

#: Road classes with their disposition and label.
CLASSES = [
    ("S1100", "EXCLUDED", "Primary road"), ("S1200", "ELIGIBLE", "Secondary road"), ("S1400", "ELIGIBLE", "Local road"), ("S1500", "SEPARATE", "Vehicular trail"), ("S1630", "EXCLUDED", "Ramp"),
    ("S1640", "EXCLUDED", "Service drive"), ("S1710", "EXCLUDED", "Walkway"), ("S1720", "EXCLUDED", "Stairway"), ("S1730", "EXCLUDED", "Alley"), ("S1740", "EXCLUDED", "Private road"),
    ("S1750", "EXCLUDED", "Internal census road"), ("S1780", "EXCLUDED", "Parking lot road"), ("S1810", "EXCLUDED", "Winter trail"), ("S1820", "EXCLUDED", "Bike path or trail"), ("S1830", "EXCLUDED", "Bridle path"),
]
_RULES = ", ".join(f"({n}, '{c}', '{d}', '{t}')" for n, (c, d, t) in enumerate(CLASSES))


def classify(roads: DataFrame) -> DataFrame:
    """roads (code, name) with disposition and reason; unknown classes and unnamed roads are excluded with their own."""
    rules = roads.sparkSession.createDataFrame(CLASSES, "code string, disposition string, label string")
    j = roads.join(F.broadcast(rules), "code", "left")  # fifteen rules
    unnamed = F.trim(F.coalesce("name", F.lit(""))) == ""
    reason = (
        F.when(F.col("code").isNull(), "no road class")
        .when(F.col("label").isNull(), F.concat(F.lit("unknown class "), "code"))
        .when(F.col("disposition") != "ELIGIBLE", F.concat(F.lower("disposition"), F.lit(": "), F.lower("label")))
        .when(unnamed, "no road name")
        .otherwise(F.concat(F.lit("eligible "), F.lower("label")))
    )
    state = F.when(F.col("label").isNull() | ((F.col("disposition") == "ELIGIBLE") & unnamed), "EXCLUDED").otherwise(F.col("disposition"))
    return j.withColumns({"state": state, "reason": reason})


@query(f"""WITH r(n, code, disposition, label) AS (VALUES {_RULES}), p AS (SELECT p_partkey AS id, p_partkey % 17 AS k, CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN '  ' ELSE p_name END AS name FROM part),
j AS (SELECT id, name, CASE WHEN k = 15 THEN NULL WHEN k = 16 THEN 'S9999' ELSE r.code END AS code, disposition, label FROM p LEFT JOIN r ON r.n = p.k)
SELECT state, reason, count(*) AS n FROM (SELECT CASE WHEN label IS NULL THEN 'EXCLUDED' WHEN disposition <> 'ELIGIBLE' THEN disposition WHEN length(trim(coalesce(name, ''))) = 0 THEN 'EXCLUDED' ELSE 'ELIGIBLE' END AS state,
CASE WHEN code IS NULL THEN 'no road class' WHEN label IS NULL THEN 'unknown class ' || code WHEN disposition <> 'ELIGIBLE' THEN lower(disposition) || ': ' || lower(label) WHEN length(trim(coalesce(name, ''))) = 0 THEN 'no road name' ELSE 'eligible ' || lower(label) END AS reason FROM j) GROUP BY ALL""")
def road_eligibility(spark, sf_dir):
    codes = F.array(*(F.lit(c) for c, _, _ in CLASSES), F.lit(None).cast("string"), F.lit("S9999"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.when(F.col("p_partkey") % 19 == 0, None).when(F.col("p_partkey") % 23 == 0, "  ").otherwise(F.col("p_name"))
    roads = p.select(F.col("p_partkey").alias("id"), F.get(codes, F.col("p_partkey") % 17).alias("code"), name.alias("name"))
    return classify(roads).groupBy("state", "reason").agg(F.count("*").alias("n"))


def query_roads(roads: DataFrame, ids: list | None = None, classes: list | None = None, box: tuple | None = None, inside: bool = False, limit: int | None = None) -> DataFrame:
    """Roads by ids, classes and box (met, or held inside), in a fixed order; each test is pushed to the scan."""
    if ids is not None:
        roads = roads.where(F.col("corridor_id").isin(ids))
    if classes is not None:
        roads = roads.where(F.col("class_code").isin(classes))
    if box is not None:
        roads = roads.where((geo.inside if inside else geo.overlaps)(*rel.bounds(), box))
    ordered = roads.orderBy("corridor_id", "name")
    return ordered.limit(limit) if limit is not None else ordered


@query(f"SELECT corridor_id, name, class_code FROM corridors WHERE class_code IN (1, 4, 9) AND west >= {BOX[0]!r} AND east <= {BOX[2]!r} AND south >= {BOX[1]!r} AND north <= {BOX[3]!r} ORDER BY corridor_id, name LIMIT 300", "corridors")
def typed_road_query(spark, sf_dir, corridors):
    return query_roads(corridors, classes=[1, 4, 9], box=BOX, inside=True, limit=300).select("corridor_id", "name", "class_code")


def filter_results(rows: DataFrame, min_miles=None, max_miles=None, classes=(), wetland="any", max_wetland_m=None, min_crossings=None, ecoregion=None) -> DataFrame:
    """The seven filters of a result list; a missing value matches no positive test, but has none nearby."""
    near = F.coalesce(F.col("wetland_m") <= 200, F.lit(False))
    keep = F.lit(True)
    if min_miles is not None:
        keep &= F.col("length_m") >= min_miles * geo.MILE
    if max_miles is not None:
        keep &= F.col("length_m") <= max_miles * geo.MILE
    if classes:
        keep &= F.arrays_overlap("classes", F.array(*map(F.lit, classes)))
    keep &= {"any": F.lit(True), "intersects": F.coalesce(F.col("wetland_m") == 0, F.lit(False)), "nearby": near, "none-nearby": ~near}[wetland]
    if max_wetland_m is not None:
        keep &= F.coalesce(F.col("wetland_m") <= max_wetland_m, F.lit(False))
    if min_crossings is not None:
        keep &= F.col("crossings") >= min_crossings
    if ecoregion is not None:
        keep &= F.array_contains("regions", ecoregion)
    return rows.where(keep)


@query("""+ c AS (SELECT corridor_id, length_m, wetland_m, crossings, [class_code, (class_code + corridor_id) % 15] AS classes, ['E' || CAST(corridor_id % 5 AS VARCHAR), 'F' || CAST(corridor_id % 3 AS VARCHAR)] AS regions FROM corridors)
SELECT 'a' AS search, corridor_id FROM c WHERE length_m >= 2*1609.344 AND length_m <= 6*1609.344 AND (list_contains(classes, 3) OR list_contains(classes, 7)) AND wetland_m <= 200
UNION ALL SELECT 'b', corridor_id FROM c WHERE (wetland_m IS NULL OR wetland_m > 200) AND crossings >= 9 AND list_contains(regions, 'F2')
UNION ALL SELECT 'c', corridor_id FROM c WHERE wetland_m = 0 UNION ALL SELECT 'd', corridor_id FROM c WHERE wetland_m <= 31 AND list_contains(regions, 'E4')""", "corridors")
def seven_filters(spark, sf_dir, corridors):
    text = lambda p, k: F.concat(F.lit(p), (F.col("corridor_id") % k).cast("string"))
    c = corridors.withColumns({"classes": F.array(F.col("class_code"), (F.col("class_code") + F.col("corridor_id")) % 15), "regions": F.array(text("E", 5), text("F", 3))})
    searches = {
        "a": dict(min_miles=2, max_miles=6, classes=(3, 7), wetland="nearby"), "b": dict(wetland="none-nearby", min_crossings=9, ecoregion="F2"),
        "c": dict(wetland="intersects"), "d": dict(max_wetland_m=31, ecoregion="E4"),
    }
    parts = [filter_results(c, **x).select(F.lit(k).alias("search"), "corridor_id") for k, x in searches.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


#: Sort dimensions: column and whether larger values lead. Unknown keys sort as the first.
SORTS = {"wetland_near": ("wetland_m", False), "distance": ("metres", False), "name": ("name", False), "length": ("length_m", True), "crossings": ("crossings", True), "regions": ("eco_count", True),
         "transitions": ("transitions", True), "class": ("class_code", False), "interest": ("score", True), "exploration": ("explore", True), "evidence": ("evidence", True)}


def sorted_results(rows: DataFrame, key: str) -> DataFrame:
    """rows by a named dimension, missing values last in both directions, ties by name and id."""
    column, falls = SORTS.get(key, next(iter(SORTS.values())))
    lead = F.desc_nulls_last(column) if falls else F.asc_nulls_last(column)
    return rows.orderBy(lead, "name", "corridor_id")


_PENALTY = f"(6e0 * pow(least(1e0, {_DIST}/{MILES * geo.MILE!r}), 2))"
_SORTED = f"""+ s AS ({SCORED}), t AS (SELECT corridor_id, name, class_code, wetland_m, {_DIST} AS metres, length_m, crossings, eco_count, eco_count - 1 AS transitions, score, evidence, greatest(0e0, score - {_PENALTY}) AS explore FROM s WHERE {_NEAR})
"""


@query(_SORTED + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{k}' AS sort, corridor_id, row_number() OVER (ORDER BY {c} {'DESC' if d else 'ASC'} NULLS LAST, name, corridor_id) AS place FROM t) WHERE place <= 40" for k, (c, d) in {**SORTS, "unknown key": ("wetland_m", False)}.items()
), "corridors")
def eleven_sorts(spark, sf_dir, corridors):
    near = interest(corridors.where(geo.overlaps(*rel.bounds(), BOX)))
    metres = geo.haversine(F.lit(-121.5), F.lit(45.25), F.col("lon"), F.col("lat"))
    penalty = 6.0 * F.pow(F.least(F.lit(1.0), metres / (MILES * geo.MILE)), F.lit(2))
    rows = near.withColumns({"metres": metres, "transitions": F.col("eco_count") - 1, "explore": F.greatest(F.lit(0.0), F.col("score") - penalty)})
    out = None
    for key in (*SORTS, "unknown key"):
        column, falls = SORTS.get(key, next(iter(SORTS.values())))
        lead = F.desc_nulls_last(column) if falls else F.asc_nulls_last(column)
        top = sorted_results(rows, key).limit(40).select("corridor_id", "name", column)  # the list's own cap
        placed = top.select(F.lit(key).alias("sort"), "corridor_id", F.row_number().over(W.orderBy(lead, "name", "corridor_id")).cast("long").alias("place"))
        out = placed if out is None else out.unionByName(placed)
    return out


_TRANSFORMS = {"linear": "10e0*f", "quadratic": "10e0*f*f", "tiered": "10e0*(CASE WHEN f <= 0.2e0 THEN 0e0 WHEN f <= 0.4e0 THEN 0.25e0 WHEN f <= 0.6e0 THEN 0.5e0 WHEN f <= 0.8e0 THEN 0.75e0 ELSE 1e0 END)", "gentle": "6e0*f*f"}


@query(f"+ s AS ({SCORED}), t AS (SELECT corridor_id, score, least(1e0, {_DIST}/{MILES * geo.MILE!r}) AS f FROM s WHERE {_NEAR}), x AS ("
       + " UNION ALL ".join(f"SELECT '{k}' AS transform, corridor_id, score, greatest(0e0, score - {p}) AS raw FROM t" for k, p in _TRANSFORMS.items())
       + ") SELECT transform, count(*) AS n, floor(avg(raw)*100+0.5)/100 AS mean_order, floor(avg(score - raw)*100+0.5)/100 AS mean_penalty, count(*) FILTER (raw = 0) AS floored FROM x GROUP BY transform", "corridors")
def exploration_transforms(spark, sf_dir, corridors):
    near = interest(corridors.where(geo.overlaps(*rel.bounds(), BOX)))
    f = F.least(F.lit(1.0), geo.haversine(F.lit(-121.5), F.lit(45.25), F.col("lon"), F.col("lat")) / (MILES * geo.MILE))
    bands = F.when(F.col("f") <= 0.2, 0.0).when(F.col("f") <= 0.4, 0.25).when(F.col("f") <= 0.6, 0.5).when(F.col("f") <= 0.8, 0.75).otherwise(1.0)
    penalty = {"linear": 10 * F.col("f"), "quadratic": 10 * F.col("f") * F.col("f"), "tiered": 10 * bands, "gentle": 6 * F.col("f") * F.col("f")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("transform"), p.alias("penalty")) for k, p in penalty.items())))
    x = near.withColumn("f", f).withColumn("x", each).select("x.transform", "score", F.greatest(F.lit(0.0), F.col("score") - F.col("x.penalty")).alias("raw"))
    return x.groupBy("transform").agg(
        F.count("*").alias("n"), geo.half_up(F.avg("raw"), 2).alias("mean_order"), geo.half_up(F.avg(F.col("score") - F.col("raw")), 2).alias("mean_penalty"), F.count_if(F.col("raw") == 0).alias("floored")
    )


@query(f"""+ p AS (SELECT corridor_id, coverage, west - 1100e0/(111320e0*greatest(cos(radians((south+north)/2)),0.1e0)) AS w, south - 1100e0/110000e0 AS s, east + 1100e0/(111320e0*greatest(cos(radians((south+north)/2)),0.1e0)) AS e, north + 1100e0/110000e0 AS n FROM corridors)
SELECT corridor_id, CASE WHEN w >= -123.5e0 AND e <= -119.5e0 AND s >= 44.2e0 AND n <= 46.2e0 THEN coverage WHEN coverage IN ('UNKNOWN','NONE') THEN coverage ELSE 'PARTIAL' END AS coverage,
CASE WHEN NOT (w >= -123.5e0 AND e <= -119.5e0 AND s >= 44.2e0 AND n <= 46.2e0) AND coverage NOT IN ('UNKNOWN','NONE') THEN 'leaves the published region' END AS reason FROM p""", "corridors")
def edge_downgrade(spark, sf_dir, corridors):
    held = geo.inside(*geo.padded(*rel.bounds(), 1000.0), (-123.5, 44.2, -119.5, 46.2))
    fixed = held | F.col("coverage").isin("UNKNOWN", "NONE")
    return corridors.select("corridor_id", F.when(fixed, F.col("coverage")).otherwise("PARTIAL").alias("coverage"), F.when(~fixed, "leaves the published region").alias("reason"))


@query("SELECT corridor_id, floor(least(west+124e0, south-44e0, -119e0-east, 46.5e0-north)*1e6+0.5)/1e6 AS margin, CASE WHEN least(west+124e0, south-44e0, -119e0-east, 46.5e0-north) > 0.2e0 THEN 'FULL' ELSE 'PARTIAL' END AS coverage FROM corridors", "corridors")
def edge_margin(spark, sf_dir, corridors):
    margin = F.least(F.col("west") + 124.0, F.col("south") - 44.0, -119.0 - F.col("east"), 46.5 - F.col("north"))
    return corridors.select("corridor_id", geo.half_up(margin, 6).alias("margin"), F.when(margin > 0.2, "FULL").otherwise("PARTIAL").alias("coverage"))


@query(f"""+ s AS ({SCORED}), t AS (SELECT corridor_id, score, row_number() OVER (ORDER BY score DESC, corridor_id) AS rank FROM s WHERE {_NEAR})
SELECT corridor_id, rank, CASE WHEN rank = 1 AND abs(score - nxt) < 1 THEN 'close call' WHEN rank > 1 AND abs(score - above) < 1 THEN 'near-equal to #' || CAST(rank - 1 AS VARCHAR) END AS note
FROM (SELECT *, lag(score) OVER (ORDER BY rank) AS above, lead(score) OVER (ORDER BY rank) AS nxt FROM (SELECT * FROM t WHERE rank <= 50))""", "corridors")
def close_calls(spark, sf_dir, corridors):
    top = interest(corridors.where(geo.overlaps(*rel.bounds(), BOX))).orderBy(F.desc("score"), "corridor_id").limit(50)  # the list's own cap
    order = W.orderBy(F.desc("score"), "corridor_id")
    r = top.select("corridor_id", "score", F.row_number().over(order).cast("long").alias("rank"), F.lag("score").over(order).alias("above"), F.lead("score").over(order).alias("next"))
    near = lambda c: F.abs(F.col("score") - F.col(c)) < 1
    note = F.when((F.col("rank") == 1) & near("next"), "close call").when((F.col("rank") > 1) & near("above"), F.concat(F.lit("near-equal to #"), (F.col("rank") - 1).cast("string")))
    return r.select("corridor_id", "rank", note.alias("note"))


@query(f"""+ s AS ({SCORED}) SELECT corridor_id, array_to_string(list_filter([CASE WHEN coverage = 'UNKNOWN' THEN NULL WHEN wetland_m = 0 THEN 'mapped wetland under the corridor' WHEN wetland_m IS NULL THEN 'no mapped wetland within the analysed distances' ELSE 'nearest mapped wetland ' || CAST(CAST(floor(wetland_m + 0.5e0) AS BIGINT) AS VARCHAR) || ' m away' END,
CASE WHEN coverage NOT IN ('FULL','PARTIAL') THEN NULL WHEN crossings = 0 THEN 'no mapped crossing, flowing or standing water nearby' WHEN crossings = 1 THEN '1 mapped water crossing' ELSE CAST(crossings AS VARCHAR) || ' mapped water crossings' END,
CASE WHEN eco_count IS NULL THEN NULL WHEN eco_count = 1 THEN 'lies in 1 mapped ecoregion' WHEN eco_count = 2 THEN 'crosses 2 ecoregions with 1 transition' ELSE 'crosses ' || CAST(eco_count AS VARCHAR) || ' ecoregions with ' || CAST(eco_count - 1 AS VARCHAR) || ' transitions' END], lambda x: x IS NOT NULL), '; ') AS reasons,
array_to_string(list_filter([CASE WHEN w IS NULL THEN 'wetlands' END, CASE WHEN x IS NULL THEN 'water' END], lambda x: x IS NOT NULL), ',') AS missing FROM s""", "corridors")
def reason_sentences(spark, sf_dir, corridors):
    text = lambda c: F.col(c).cast("string")
    wet = (
        F.when(F.col("coverage") == "UNKNOWN", None).when(F.col("wetland_m") == 0, "mapped wetland under the corridor").when(F.col("wetland_m").isNull(), "no mapped wetland within the analysed distances")
        .otherwise(F.concat(F.lit("nearest mapped wetland "), F.floor(F.col("wetland_m") + 0.5).cast("string"), F.lit(" m away")))
    )
    seen = F.col("coverage").isin("FULL", "PARTIAL")
    water = F.when(~seen, None).when(F.col("crossings") == 0, "no mapped crossing, flowing or standing water nearby").otherwise(
        F.concat(text("crossings"), F.when(F.col("crossings") == 1, " mapped water crossing").otherwise(" mapped water crossings"))
    )
    plural = F.when(F.col("eco_count") == 2, " transition").otherwise(" transitions")
    variety = F.when(F.col("eco_count") == 1, "lies in 1 mapped ecoregion").otherwise(F.concat(F.lit("crosses "), text("eco_count"), F.lit(" ecoregions with "), (F.col("eco_count") - 1).cast("string"), plural))
    missing = F.concat_ws(",", F.when(F.col("coverage") == "UNKNOWN", "wetlands"), F.when(~seen, "water"))
    return corridors.select("corridor_id", F.concat_ws("; ", wet, water, variety).alias("reasons"), missing.alias("missing"))


@query("""+ r AS (SELECT corridor_id, coverage AS a, CASE WHEN corridor_id % 8 = 0 THEN 'NONE' WHEN corridor_id % 8 = 1 THEN 'UNKNOWN' WHEN corridor_id % 8 < 5 THEN 'FULL' ELSE 'PARTIAL' END AS b FROM corridors)
SELECT a AS level3, b AS level4, CASE WHEN a = b AND a IN ('FULL', 'NONE', 'PARTIAL', 'UNKNOWN') THEN a WHEN a = 'UNKNOWN' THEN CASE b WHEN 'NONE' THEN 'UNKNOWN' ELSE 'PARTIAL' END WHEN b = 'UNKNOWN' THEN CASE a WHEN 'NONE' THEN 'UNKNOWN' ELSE 'PARTIAL' END ELSE 'PARTIAL' END AS combined, count(*) AS n FROM r GROUP BY ALL""", "corridors")
def combined_coverage(spark, sf_dir, corridors):
    k = F.col("corridor_id") % 8
    r = corridors.select(F.col("coverage").alias("level3"), F.when(k == 0, "NONE").when(k == 1, "UNKNOWN").when(k < 5, "FULL").otherwise("PARTIAL").alias("level4"))
    a, b = F.col("level3"), F.col("level4")
    known = F.when(a == "UNKNOWN", b).otherwise(a)
    both = (
        F.when((a == "FULL") & (b == "FULL"), "FULL").when((a == "NONE") & (b == "NONE"), "NONE")
        .when((a == "UNKNOWN") | (b == "UNKNOWN"), F.when(known.isin("FULL", "PARTIAL"), "PARTIAL").otherwise("UNKNOWN")).otherwise("PARTIAL")
    )
    return r.groupBy("level3", "level4", both.alias("combined")).agg(F.count("*").alias("n"))


@query("""+ r AS (SELECT corridor_id, unnest([250, 500, 1000]) AS d, wetland_m, coverage FROM corridors), c AS (SELECT corridor_id, coverage, d, coalesce(wetland_m + d, 0) <= 1800 AS covered FROM r),
s AS (SELECT corridor_id, any_value(coverage) AS state, count(*) FILTER (covered) AS k, string_agg(CAST(d AS VARCHAR), ' and ' ORDER BY d) FILTER (NOT covered) AS open FROM c GROUP BY corridor_id)
SELECT corridor_id, CASE WHEN state = 'UNKNOWN' THEN 'UNKNOWN' WHEN k = 3 THEN 'FULL' WHEN k > 0 THEN 'PARTIAL' ELSE 'NONE' END AS coverage, CASE WHEN state <> 'UNKNOWN' AND k BETWEEN 1 AND 2 THEN open END AS uncovered FROM s""", "corridors")
def buffer_coverage_summary(spark, sf_dir, corridors):
    rows = corridors.select("corridor_id", "coverage", F.explode(F.array(*map(F.lit, (250, 500, 1000)))).alias("d"), "wetland_m").withColumn("covered", F.coalesce(F.col("wetland_m") + F.col("d"), F.lit(0.0)) <= 1800)
    s = rows.groupBy("corridor_id").agg(F.first("coverage").alias("state"), F.count_if("covered").alias("k"), F.array_sort(F.collect_list(F.when(~F.col("covered"), F.col("d")))).alias("open"))  # three distances
    coverage = F.when(F.col("state") == "UNKNOWN", "UNKNOWN").when(F.col("k") == 3, "FULL").when(F.col("k") > 0, "PARTIAL").otherwise("NONE")
    return s.select("corridor_id", coverage.alias("coverage"), F.when((F.col("state") != "UNKNOWN") & F.col("k").between(1, 2), F.array_join(F.col("open").cast("array<string>"), " and ")).alias("uncovered"))


@query("""+ o AS (SELECT 'E' || CAST(corridor_id % 37 AS VARCHAR) AS code, 'Region ' || CAST(corridor_id % 37 % 7 AS VARCHAR) AS name FROM corridors UNION ALL SELECT 'F' || CAST(crossings AS VARCHAR), 'Part ' || CAST(crossings AS VARCHAR) FROM corridors)
SELECT code, min(name) || ' (' || code || ')' AS label FROM o GROUP BY code""", "corridors")
def ecoregion_options(spark, sf_dir, corridors):
    e = F.col("corridor_id") % 37
    level3 = corridors.select(F.concat(F.lit("E"), e.cast("string")).alias("code"), F.concat(F.lit("Region "), (e % 7).cast("string")).alias("name"))
    level4 = corridors.select(F.concat(F.lit("F"), F.col("crossings").cast("string")).alias("code"), F.concat(F.lit("Part "), F.col("crossings").cast("string")).alias("name"))
    both = level3.unionByName(level4).groupBy("code").agg(F.min("name").alias("name"))
    return both.select("code", F.concat("name", F.lit(" ("), "code", F.lit(")")).alias("label")).orderBy("label")


@query(f"""+ s AS ({SCORED}), t AS (SELECT corridor_id, name, score, crossings, wetland_m, coverage, {_DIST} AS metres FROM s WHERE {_NEAR} AND {_DIST} <= {MILES * geo.MILE!r})
SELECT corridor_id, rank, CASE WHEN score >= 60 THEN 'Strong' WHEN score >= 30 THEN 'Moderate' ELSE 'Limited' END || ' naturalist interest' AS label, CASE WHEN coverage <> 'FULL' THEN 'Coverage here is ' || lower(coverage) END AS caution,
array_to_string(list_filter([CASE WHEN crossings >= 3 THEN CAST(crossings AS VARCHAR) || ' water crossings' END, CASE WHEN wetland_m <= 200 THEN 'wetland nearby' END, CASE WHEN metres <= 16093.44 THEN 'close to the centre' END], lambda x: x IS NOT NULL), ', ') AS reasons
FROM (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, name, corridor_id) AS rank FROM t) WHERE rank <= 5""", "corridors")
def recommendations(spark, sf_dir, corridors):
    top = search(corridors).orderBy(F.desc_nulls_last("score"), "name", "corridor_id").limit(5)
    label = F.concat(F.when(F.col("score") >= 60, "Strong").when(F.col("score") >= 30, "Moderate").otherwise("Limited"), F.lit(" naturalist interest"))
    reasons = F.concat_ws(", ", F.when(F.col("crossings") >= 3, F.concat(F.col("crossings").cast("string"), F.lit(" water crossings"))), F.when(F.col("wetland_m") <= 200, "wetland nearby"), F.when(F.col("metres") <= 16093.44, "close to the centre"))
    rank = F.row_number().over(W.orderBy(F.desc_nulls_last("score"), "name", "corridor_id")).cast("long")
    caution = F.when(F.col("coverage") != "FULL", F.concat(F.lit("Coverage here is "), F.lower("coverage")))
    return top.select("corridor_id", rank.alias("rank"), label.alias("label"), caution.alias("caution"), reasons.alias("reasons"))
