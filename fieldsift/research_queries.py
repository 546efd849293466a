"""Registered queries of the investigation and of the evaluations, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldsift.functions import geo
from fieldsift.functions.names import name_parts, name_relation
from fieldsift.operators import access, lines
from fieldsift.operators import relations as rel
from fieldsift.line_queries import _G, _O, sql_foot
from fieldsift.operators.access import EFFECTS, SCOPES
from fieldsift.first_queries import BOX, LAT, LON, MILES, _DIST, _NEAR, SCORED, interest, query, sql_haversine

_ROAD = "CASE WHEN p_partkey % 5 = 0 THEN 'Northwest ' ELSE '' END || p_name || CASE WHEN p_partkey % 7 = 0 THEN ' Rd' ELSE ' road' END"
_WAY = """CASE p_partkey % 9 WHEN 0 THEN upper(p_name) || ' Road' WHEN 1 THEN 'North ' || p_name || ' Road' WHEN 2 THEN split_part(p_name, ' ', 1) || ' lane' WHEN 3 THEN 'W. Elm Street' WHEN 4 THEN '' WHEN 5 THEN split_part(p_name, ' ', 1) || ' river road'
WHEN 6 THEN 'NW ' || p_name || ' Rd.' WHEN 7 THEN p_name || ', Highway (North East)' ELSE NULL END"""
_SHORT = "CASE t WHEN 'north' THEN 'n' WHEN 'south' THEN 's' WHEN 'east' THEN 'e' WHEN 'west' THEN 'w' WHEN 'northeast' THEN 'ne' WHEN 'northwest' THEN 'nw' WHEN 'southeast' THEN 'se' WHEN 'southwest' THEN 'sw' ELSE t END"


def _names_sql(source: str) -> str:
    """Words as rows: parts(id, side, direction, core) of source(id, side, name), words in order."""
    return f"""words AS (SELECT id, side, unnest(string_split(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', ' ', 'g'), ' ')) AS t, generate_subscripts(string_split(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', ' ', 'g'), ' '), 1) AS i FROM {source}),
marked AS (SELECT *, {_SHORT} AS d, {_SHORT} IN ('n','s','e','w','ne','nw','se','sw') AS is_d FROM words WHERE t <> ''),
parts AS (SELECT id, side, coalesce(arg_min(d, i) FILTER (is_d), '') AS direction, coalesce(list(t ORDER BY i) FILTER (NOT is_d AND t NOT IN ('rd','road','st','street','ave','avenue','blvd','boulevard','dr','drive','ln','lane','hwy','highway','ct','court','way','pl','place')), []) AS core FROM marked GROUP BY id, side)"""


_RELATION = """CASE WHEN coalesce(len(a.core), 0) = 0 OR coalesce(len(b.core), 0) = 0 THEN 'DIFFERENT' WHEN array_to_string(a.core, ' ') = array_to_string(b.core, ' ') AND a.direction = b.direction THEN 'SAME' WHEN array_to_string(a.core, ' ') = array_to_string(b.core, ' ') THEN 'DIRECTION_VARIANT'
WHEN 2 * len([x for x in b.core if list_contains(a.core, x)]) >= len(a.core) THEN 'CORE_VARIANT' ELSE 'DIFFERENT' END"""


def ways(spark, sf_dir) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), F.expr(_ROAD).alias("road"), F.expr(_WAY).alias("way"))


@query(f"""WITH n AS (SELECT p_partkey AS id, 'a' AS side, {_ROAD} AS name FROM part UNION ALL SELECT p_partkey, 'b', {_WAY} FROM part), {_names_sql('n')}
SELECT p_partkey AS id, coalesce(a.direction, '') AS road_direction, array_to_string(coalesce(a.core, []), ' ') AS road_core, coalesce(b.direction, '') AS way_direction, {_RELATION} AS relation FROM part LEFT JOIN parts a ON a.id = p_partkey AND a.side = 'a' LEFT JOIN parts b ON b.id = p_partkey AND b.side = 'b'""")
def name_relations(spark, sf_dir):
    road, way = name_parts(F.col("road")), name_parts(F.col("way"))
    return ways(spark, sf_dir).select(
        "id", road["direction"].alias("road_direction"), F.array_join(road["core"], " ").alias("road_core"), way["direction"].alias("way_direction"), name_relation(F.col("road"), F.col("way")).alias("relation")
    )


#: Access values of mapped ways.
RESTRICTED, PUBLIC = ["no", "private", "customers", "military"], ["yes", "public", "designated"]
_KEYS = ["access", "motor_vehicle", "motorcar", "vehicle"]
_TAGS = """t AS (SELECT p_partkey AS id, p_type AS class, p_size % 5 = 0 AS barrier, list_filter([CASE WHEN p_partkey % 3 = 0 THEN list_extract(['yes','private','permissive','odd','no'], CAST(p_partkey % 5 AS INTEGER) + 1) END, CASE WHEN p_partkey % 4 = 1 THEN list_extract(['designated','permissive','customers'], CAST(p_partkey % 3 AS INTEGER) + 1) END, CASE WHEN p_partkey % 20 = 2 THEN ' ' END], lambda x: x IS NOT NULL AND trim(x) <> '') AS v FROM part),
g AS (SELECT *, CASE WHEN len(v) = 0 THEN 'ABSENT' WHEN list_has_any(v, ['no','private','customers','military']) THEN 'EXPLICIT_RESTRICTED' WHEN list_contains(v, 'permissive') THEN 'EXPLICIT_PERMISSIVE' WHEN list_has_any(v, ['yes','public','designated']) THEN 'EXPLICIT_PUBLIC' ELSE 'ABSENT' END AS signal FROM t)"""


def access_signal(tags: Column) -> Column:
    """The signal of a way's access tags: a restriction outweighs tolerance, and that a public value; odd values say nothing."""
    values = F.filter(F.array(*(tags[k] for k in _KEYS)), lambda v: v.isNotNull() & (F.trim(v) != ""))
    some = lambda wanted: F.arrays_overlap(values, F.array(*map(F.lit, wanted)))
    return (
        F.when(F.size(values) == 0, "ABSENT").when(some(RESTRICTED), "EXPLICIT_RESTRICTED").when(F.array_contains(values, "permissive"), "EXPLICIT_PERMISSIVE").when(some(PUBLIC), "EXPLICIT_PUBLIC").otherwise("ABSENT")
    )


def tagged(spark, sf_dir) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    pick = lambda values, m: F.get(F.array(*map(F.lit, values)), (k % m).cast("int"))
    tags = F.create_map(
        F.lit("access"), F.when(k % 3 == 0, pick(["yes", "private", "permissive", "odd", "no"], 5)), F.lit("motor_vehicle"), F.when(k % 4 == 1, pick(["designated", "permissive", "customers"], 3)),
        F.lit("vehicle"), F.when(k % 20 == 2, " "),
    )
    return p.select(k.alias("id"), F.col("p_type").alias("class"), (F.col("p_size") % 5 == 0).alias("barrier"), tags.alias("tags"))


@query(f"WITH {_TAGS} SELECT id, signal FROM g")
def access_signals(spark, sf_dir):
    return tagged(spark, sf_dir).select("id", access_signal(F.col("tags")).alias("signal"))


@query(f"""WITH {_TAGS} SELECT 'way ' || CAST(id AS VARCHAR) AS item, signal AS claim, 1 AS ways FROM g WHERE signal <> 'ABSENT' UNION ALL SELECT 'untagged', 'ABSENT', count(*) FROM g WHERE signal = 'ABSENT'
UNION ALL SELECT 'class ' || class, 'ROAD_CLASS', count(*) FROM g GROUP BY class UNION ALL SELECT 'barriers', 'GATE_REPORTED', count(*) FROM g WHERE barrier HAVING count(*) > 0""")
def way_evidence(spark, sf_dir):
    g = tagged(spark, sf_dir).withColumn("signal", access_signal(F.col("tags")))
    own = g.where("signal <> 'ABSENT'").select(F.concat(F.lit("way "), F.col("id").cast("string")).alias("item"), F.col("signal").alias("claim"), F.lit(1).cast("long").alias("ways"))
    untagged = g.where("signal = 'ABSENT'").agg(F.count("*").alias("ways")).select(F.lit("untagged").alias("item"), F.lit("ABSENT").alias("claim"), "ways")
    classes = g.groupBy("class").agg(F.count("*").alias("ways")).select(F.concat(F.lit("class "), "class").alias("item"), F.lit("ROAD_CLASS").alias("claim"), "ways")
    gates = g.where("barrier").agg(F.count("*").alias("ways")).where("ways > 0").select(F.lit("barriers").alias("item"), F.lit("GATE_REPORTED").alias("claim"), "ways")
    return own.unionByName(untagged).unionByName(classes).unionByName(gates)


#: The day on which evidence is checked.
CHECKED = 20_000
_CLAIM = "list_extract([" + ", ".join(f"'{c}'" for c in EFFECTS) + "], CAST(event_id % 16 AS INTEGER) + 1)"
_APPLIES = ["Oak Road", "NW Oak Rd", "Northeast Oak Road", "Oak Creek Road", "Elm Street"]
_ITEM = [
    "event_id AS id", "user_id AS corridor", "CAST(event_id // 16 % 4 AS INTEGER) + 1 AS tier", "concat('org ', CAST(event_id // 7 % 9 AS VARCHAR)) AS org", "CASE WHEN event_id % 6 = 0 THEN 20000 + event_id * 5 % 400 - 200 END AS ends",
    "CASE WHEN event_id % 4 = 2 THEN 20000 + event_id * 3 % 300 - 150 END AS starts", "CASE WHEN event_id % 23 <> 0 THEN 20000 - event_id * 11 % 900 + 20 END AS dated", "CASE WHEN event_id % 10 = 3 THEN 'seasonal' END AS recurrence",
]
#: Items, and what each says on the day, written from the rules: fresh, effect, strong, acting.
_ITEMS = f"""i AS MATERIALIZED (SELECT {', '.join(_ITEM)}, {_CLAIM} AS claim, list_extract({SCOPES!r}, CAST(event_id // 64 % 4 AS INTEGER) + 1) AS scope, list_extract({_APPLIES!r}, CAST(event_id // 16 % 6 AS INTEGER) + 1) AS applies_to FROM events WHERE user_id IS NOT NULL),
f AS (SELECT *, CASE WHEN claim IN ('PUBLIC_ROAD','MOTOR_VEHICLES_ALLOWED','ROAD_MAINTAINED') THEN 'AFFIRMATIVE' WHEN claim LIKE '%CLOSURE' OR claim IN ('PRIVATE_ROAD','MOTOR_VEHICLES_RESTRICTED','PERMIT_REQUIRED') THEN 'RESTRICTIVE' WHEN claim IN ('GATE_REPORTED','ROAD_UNMAINTAINED','ROAD_NAME_VARIANT') THEN 'ATTENTION' ELSE 'NEUTRAL' END AS effect,
tier < 3 AS strong, CASE WHEN ends IS NULL AND dated IS NULL THEN 'UNDATED' WHEN 20000 - coalesce(ends, dated) > 365 THEN 'STALE' WHEN 20000 - coalesce(ends, dated) > 90 THEN 'RECENT' ELSE 'CURRENT' END AS fresh FROM i),
e AS MATERIALIZED (SELECT *, CASE WHEN effect <> 'RESTRICTIVE' THEN 'NOT_APPLICABLE' WHEN ends < 20000 THEN 'EXPIRED' WHEN starts > 20000 THEN 'UNDATED' WHEN coalesce(starts, ends) IS NOT NULL THEN 'CURRENT' WHEN recurrence IS NOT NULL THEN 'RECURRING' WHEN fresh IN ('STALE', 'UNDATED') THEN fresh ELSE 'CURRENT' END AS temporal FROM f)"""


def evidence(spark, sf_dir) -> DataFrame:
    """Evidence items about corridors, as operators/access.py takes them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), F.expr(at).cast("int"))
    own = (F.expr(x.replace("//", "div").replace("VARCHAR", "STRING")) for x in _ITEM)
    return e.select(*own, pick(EFFECTS, "event_id % 16").alias("claim"), pick(SCOPES, "event_id div 64 % 4").alias("scope"), pick(_APPLIES, "event_id div 16 % 6").alias("applies_to"))


@query(f"""WITH {_ITEMS} SELECT effect, tier, fresh AS freshness, temporal AS temporal_scope, strong AS authoritative, count(*) AS n FROM e GROUP BY ALL""")
def evidence_classes(spark, sf_dir):
    return access.decorated(evidence(spark, sf_dir), CHECKED).groupBy("effect", "tier", "freshness", "temporal_scope", "authoritative").agg(F.count("*").alias("n"))


#: Pairs of maintenance claims item by item: o(corridor, org_a, name_a, org_b, name_b, pairs).
_OVERLAPS = f"""m AS (SELECT * FROM e WHERE claim = 'ROAD_MAINTAINED' AND strong AND scope <> 'NOT_APPLICABLE' AND applies_to IS NOT NULL), n AS (SELECT DISTINCT applies_to AS id, 'a' AS side, applies_to AS name FROM m), {_names_sql('n')},
firsts AS (SELECT corridor, org, applies_to, min(id) AS first FROM m GROUP BY ALL), mf AS (SELECT m.*, first FROM m JOIN firsts USING (corridor, org, applies_to)),
o AS (SELECT x.corridor, x.org AS org_a, x.applies_to AS name_a, y.org AS org_b, y.applies_to AS name_b, count(*) AS pairs FROM mf x JOIN mf y ON x.corridor = y.corridor AND x.org <> y.org AND x.first < y.first JOIN parts a ON a.id = x.applies_to JOIN parts b ON b.id = y.applies_to
WHERE (x.scope = 'CORRIDOR' OR y.scope = 'CORRIDOR') AND {_RELATION} <> 'DIFFERENT' GROUP BY ALL)"""


@query(f"WITH {_ITEMS}, {_OVERLAPS} SELECT * FROM o")
def authority_overlaps(spark, sf_dir):
    return access.authority_overlaps(access.decorated(evidence(spark, sf_dir), CHECKED))


#: Findings item by item: every rule asks for an item that fits it.
_FOUND = f"""{_ITEMS}, q AS (SELECT *, temporal IN ('CURRENT', 'RECURRING') AS acting, claim IN ('PUBLIC_ROAD','PRIVATE_ROAD','MOTOR_VEHICLES_ALLOWED','MOTOR_VEHICLES_RESTRICTED','PERMIT_REQUIRED') AS status FROM e),
has AS (SELECT corridor, list(DISTINCT effect || CASE WHEN strong THEN '+' ELSE '-' END || CASE WHEN acting THEN 'acts' ELSE '' END || CASE WHEN status THEN ' status' ELSE '' END || CASE WHEN claim LIKE '%CLOSURE' AND temporal = 'RECURRING' THEN ' later' ELSE '' END || CASE WHEN scope = 'CORRIDOR' THEN ' whole' ELSE '' END) AS h FROM q GROUP BY corridor),
r AS (SELECT c_custkey AS corridor, h, CASE WHEN h IS NULL THEN 'R1_NO_ACCESS_EVIDENCE' WHEN len([x for x in h if x LIKE 'AFFIRMATIVE+%']) > 0 AND len([x for x in h if x LIKE 'RESTRICTIVE+acts status%']) > 0 THEN 'R2_STATUS_CONFLICT'
WHEN len([x for x in h if x LIKE 'RESTRICTIVE+acts%' AND x NOT LIKE '% later%']) > 0 THEN 'R3_CURRENT_RESTRICTION' WHEN len([x for x in h if x LIKE 'RESTRICTIVE+acts%']) > 0 THEN 'R4_RECURRING_RESTRICTION'
WHEN len([x for x in h if x LIKE 'AFFIRMATIVE+%']) > 0 AND len([x for x in h if x LIKE 'RESTRICTIVE-acts status%']) > 0 THEN 'R5_LOWER_TIER_RESTRICTION' WHEN len([x for x in h if x LIKE 'AFFIRMATIVE+% whole']) > 0 THEN 'R6_AUTHORITATIVE_WHOLE_CORRIDOR'
WHEN len([x for x in h if x LIKE 'AFFIRMATIVE+%']) > 0 THEN 'R7_AUTHORITATIVE_PART_OF_CORRIDOR' WHEN len([x for x in h if x LIKE 'AFFIRMATIVE-%']) > 0 THEN 'R8_COMMUNITY_ONLY' ELSE 'R9_NO_DECIDING_EVIDENCE' END AS rule FROM customer LEFT JOIN has ON corridor = c_custkey),
d AS (SELECT *, CASE left(rule, 2) WHEN 'R2' THEN 'CONFLICTED' WHEN 'R3' THEN 'RESTRICTED_OR_CLOSED' WHEN 'R4' THEN 'RESTRICTED_OR_CLOSED' WHEN 'R5' THEN 'PROBABLE_PUBLIC' WHEN 'R6' THEN 'VERIFIED_PUBLIC' WHEN 'R7' THEN 'PROBABLE_PUBLIC' WHEN 'R8' THEN 'PROBABLE_PUBLIC' ELSE 'UNVERIFIED' END AS finding FROM r)"""


@query(f"""WITH {_FOUND} SELECT corridor AS corridor_id, rule, finding, CASE WHEN finding = 'CONFLICTED' THEN 'DISPUTED' WHEN len([x for x in h if x LIKE 'AFFIRMATIVE+% whole']) > 0 THEN 'VERIFIED' WHEN len([x for x in h if x LIKE 'AFFIRMATIVE+%']) > 0 THEN 'PARTIAL' WHEN len([x for x in h if x LIKE 'AFFIRMATIVE-%']) > 0 THEN 'COMMUNITY ONLY' ELSE 'NONE' END AS public_road,
CASE finding WHEN 'RESTRICTED_OR_CLOSED' THEN 'RESTRICTED OR CLOSED' WHEN 'VERIFIED_PUBLIC' THEN 'VERIFIED' WHEN 'UNVERIFIED' THEN 'UNVERIFIED' ELSE 'PROBABLE ONLY' END AS motor_vehicles FROM d""")
def access_finding(spark, sf_dir):
    """The finding of every corridor by the nine ordered rules."""
    return access.findings(_roads(spark, sf_dir), evidence(spark, sf_dir), CHECKED).select(F.col("corridor").alias("corridor_id"), "rule", "finding", "public_road", "motor_vehicles")


def _roads(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("corridor"))


@query(f"""WITH {_FOUND}, {_OVERLAPS}, k AS (SELECT 'ACTING_RESTRICTION' AS "check", corridor, count(*) AS n FROM q WHERE effect = 'RESTRICTIVE' AND acting GROUP BY corridor UNION ALL SELECT 'CORRIDOR_PARTIAL', corridor, count(*) FROM q WHERE effect = 'AFFIRMATIVE' AND strong GROUP BY corridor
UNION ALL SELECT 'WEAK_SOURCE_ONLY', corridor, count(*) FROM q WHERE effect = 'AFFIRMATIVE' AND NOT strong GROUP BY corridor UNION ALL SELECT 'STALE_EVIDENCE', corridor, count(*) FROM q WHERE effect = 'RESTRICTIVE' AND NOT acting GROUP BY corridor
UNION ALL SELECT 'NAME_VARIANT', corridor, count(*) FROM q WHERE claim = 'ROAD_NAME_VARIANT' GROUP BY corridor UNION ALL SELECT 'AUTHORITY_OVERLAP', corridor, CAST(2 * sum(pairs) AS BIGINT) FROM o GROUP BY corridor),
orgs AS (SELECT corridor, count(DISTINCT org) AS orgs FROM q WHERE effect = 'AFFIRMATIVE' AND strong GROUP BY corridor),
c AS (SELECT i AS place, list_extract(['ACTING_RESTRICTION','NEGATIVE_CASE_CONFIRMED','CORRIDOR_PARTIAL','SINGLE_ORGANIZATION','WEAK_SOURCE_ONLY','STALE_EVIDENCE','NAME_VARIANT','AUTHORITY_OVERLAP','EVIDENCE_ABSENCE'], i) AS "check" FROM (SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS i))
SELECT d.corridor AS corridor_id, place, c."check", CASE c."check" WHEN 'NEGATIVE_CASE_CONFIRMED' THEN CASE WHEN finding = 'RESTRICTED_OR_CLOSED' THEN 'PASS' ELSE 'NOT_APPLICABLE' END WHEN 'CORRIDOR_PARTIAL' THEN CASE WHEN len([x for x in h if x LIKE 'AFFIRMATIVE+% whole']) > 0 THEN 'PASS' ELSE 'CONCERN' END
WHEN 'SINGLE_ORGANIZATION' THEN CASE WHEN orgs IS NULL THEN 'NOT_APPLICABLE' WHEN orgs = 1 THEN 'CONCERN' ELSE 'PASS' END WHEN 'WEAK_SOURCE_ONLY' THEN CASE WHEN orgs IS NULL AND k.n > 0 THEN 'CONCERN' ELSE 'PASS' END WHEN 'EVIDENCE_ABSENCE' THEN CASE WHEN h IS NULL THEN 'UNRESOLVED' ELSE 'PASS' END
ELSE CASE WHEN k.n > 0 THEN 'CONCERN' ELSE 'PASS' END END AS outcome, coalesce(k.n, 0) AS evidence FROM d CROSS JOIN c LEFT JOIN orgs ON orgs.corridor = d.corridor LEFT JOIN k ON k.corridor = d.corridor AND k."check" = c."check" """)
def adversarial_review(spark, sf_dir):
    """The nine checks of every corridor's finding."""
    return access.adversarial_review(access.findings(_roads(spark, sf_dir), evidence(spark, sf_dir), CHECKED)).withColumnRenamed("corridor", "corridor_id")


@query("""WITH p AS (SELECT user_id AS run, list_extract(['EVIDENCE', 'NO_RELEVANT_EVIDENCE', 'FAILED', 'OPERATOR_ONLY', 'NOT_RUN'], CAST((event_id * 3 + user_id) % CASE WHEN user_id % 3 = 0 THEN 2 ELSE 5 END AS INTEGER) + 1) AS outcome, list_extract(['OK', 'FAILED', 'PARTIAL', 'NOT_RUN'], CAST(user_id % 4 AS INTEGER) + 1) AS ways FROM events)
SELECT run, count(*) AS asked, count(*) FILTER (outcome IN ('EVIDENCE', 'NO_RELEVANT_EVIDENCE')) AS answered, count(*) FILTER (outcome = 'FAILED') AS failed, CASE WHEN count(*) FILTER (outcome = 'FAILED') > 0 AND count(*) FILTER (outcome IN ('EVIDENCE', 'NO_RELEVANT_EVIDENCE')) = 0 AND ways <> 'OK' THEN 'UNKNOWN'
WHEN count(*) FILTER (outcome IN ('FAILED', 'OPERATOR_ONLY', 'NOT_RUN')) > 0 OR ways <> 'OK' THEN 'PARTIAL' ELSE 'FULL' END AS coverage FROM p GROUP BY run, ways""")
def research_coverage(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    outcomes = F.array(*map(F.lit, ("EVIDENCE", "NO_RELEVANT_EVIDENCE", "FAILED", "OPERATOR_ONLY", "NOT_RUN")))
    at = (F.col("event_id") * 3 + F.col("user_id")) % F.when(F.col("user_id") % 3 == 0, 2).otherwise(5)
    rows = e.select(F.col("user_id").alias("run"), F.get(outcomes, at.cast("int")).alias("outcome"), F.get(F.array(*map(F.lit, ("OK", "FAILED", "PARTIAL", "NOT_RUN"))), (F.col("user_id") % 4).cast("int")).alias("ways"))
    n = rows.groupBy("run", "ways").agg(F.count("*").alias("asked"), F.count_if(F.col("outcome").isin("EVIDENCE", "NO_RELEVANT_EVIDENCE")).alias("answered"), F.count_if(F.col("outcome") == "FAILED").alias("failed"))
    coverage = F.when((F.col("failed") > 0) & (F.col("answered") == 0) & (F.col("ways") != "OK"), "UNKNOWN").when((F.col("answered") < F.col("asked")) | (F.col("ways") != "OK"), "PARTIAL").otherwise("FULL")
    return n.select("run", "asked", "answered", "failed", coverage.alias("coverage"))


#: Feature types of water by code, and which of them flow or stand.
WATER = {334: "Connector", 336: "CanalDitch", 361: "Playa", 378: "Ice Mass", 390: "Lake/Pond", 428: "Pipeline", 436: "Reservoir", 460: "Stream/River", 466: "Swamp/Marsh", 558: "Artificial Path"}
FLOWING, STANDING = [334, 336, 460, 558], [361, 378, 390, 436, 466]


@query("""WITH f AS (SELECT l_orderkey, list_extract([334, 336, 361, 378, 390, 428, 436, 460, 466, 558, 999], CAST(l_partkey % 11 AS INTEGER) + 1) AS ftype, l_quantity FROM lineitem)
SELECT CASE WHEN ftype IN (334, 336, 460, 558) THEN 'flowing' WHEN ftype IN (361, 378, 390, 436, 466) THEN 'standing' ELSE 'other' END AS class, CASE ftype WHEN 334 THEN 'Connector' WHEN 336 THEN 'CanalDitch' WHEN 361 THEN 'Playa' WHEN 378 THEN 'Ice Mass' WHEN 390 THEN 'Lake/Pond' WHEN 428 THEN 'Pipeline'
WHEN 436 THEN 'Reservoir' WHEN 460 THEN 'Stream/River' WHEN 466 THEN 'Swamp/Marsh' WHEN 558 THEN 'Artificial Path' ELSE 'Unknown' END AS label, count(*) AS n, sum(l_quantity) AS metres FROM f GROUP BY ALL""")
def water_classes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ftype = F.get(F.array(*map(F.lit, (*WATER, 999))), (F.col("l_partkey") % 11).cast("int"))
    f = rows.select(ftype.alias("ftype"), "l_quantity")
    label = F.coalesce(F.create_map(*(F.lit(x) for pair in WATER.items() for x in pair))[F.col("ftype")], F.lit("Unknown"))
    kind = F.when(F.col("ftype").isin(FLOWING), "flowing").when(F.col("ftype").isin(STANDING), "standing").otherwise("other")
    return f.groupBy(kind.alias("class"), label.alias("label")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("metres"))


@query("""+ a AS (SELECT code, label, size * 10.0 AS area, CASE habitat_id % 3 WHEN 0 THEN 250 WHEN 1 THEN 500 ELSE 1000 END AS distance FROM habitats) SELECT code, label, count(*) AS features, sum(area) AS area, row_number() OVER (PARTITION BY code ORDER BY sum(area) DESC, label) AS place FROM a WHERE distance <= 1000 GROUP BY code, label""", "habitats")
def class_inventory(spark, sf_dir, habitats):
    sums = habitats.groupBy("code", "label").agg(F.count("*").alias("features"), F.sum(F.col("size") * F.lit(10.0)).alias("area"))
    return sums.withColumn("place", F.row_number().over(W.partitionBy("code").orderBy(F.desc("area"), "label")).cast("long"))  # classes of one code


@query(f"""+ s AS ({SCORED}), t AS (SELECT *, {_DIST} AS metres, row_number() OVER (PARTITION BY class_code ORDER BY score DESC, corridor_id) AS k FROM s WHERE {_NEAR})
SELECT class_code, count(*) AS n, floor(avg(CASE WHEN w >= 0.95e0 THEN 1e0 ELSE 0e0 END)*1000+0.5)/1000 AS saturated, floor(avg(CASE WHEN 0.45e0*w > 0.35e0*x + 0.2e0*e THEN 1e0 ELSE 0e0 END)*1000+0.5)/1000 AS dominated, floor(avg(CASE WHEN evidence < 0.999e0 THEN 1e0 ELSE 0e0 END)*1000+0.5)/1000 AS partial,
count(DISTINCT score) = 1 AS constant FROM t WHERE k <= 20 GROUP BY class_code""", "corridors")
def pathology_shares(spark, sf_dir, corridors):
    rows = interest(corridors.where(geo.overlaps(*rel.bounds(), BOX)))
    top = rows.withColumn("k", F.row_number().over(W.partitionBy("class_code").orderBy(F.desc("score"), "corridor_id"))).where("k <= 20")
    wet = F.when(F.col("coverage") != "UNKNOWN", geo.proximity(F.col("wetland_m"), 1000.0))
    cross = F.when(F.col("coverage").isin("FULL", "PARTIAL"), geo.saturate(F.col("crossings") / (F.col("length_m") / geo.MILE), 2.0))
    eco = geo.saturate(F.coalesce("eco_count", F.lit(1)) - 1.0, 1.5)
    share = lambda test: geo.half_up(F.avg(F.when(test, 1.0).otherwise(0.0)))
    return top.groupBy("class_code").agg(
        F.count("*").alias("n"), share(wet >= 0.95).alias("saturated"), share(0.45 * wet > 0.35 * cross + 0.2 * eco).alias("dominated"), share(F.col("evidence") < 0.999).alias("partial"), (F.count_distinct("score") == 1).alias("constant")
    )


@query(f"""+ s AS ({SCORED}), t AS (SELECT class_code AS region, corridor_id, score, {_DIST}/{MILES * geo.MILE!r} AS f FROM s WHERE {_NEAR} AND {_DIST} <= {MILES * geo.MILE!r}), x AS (SELECT 'linear' AS transform, *, score - 10e0*f AS raw FROM t UNION ALL SELECT 'gentle', *, score - 6e0*f*f FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY transform, region ORDER BY score DESC, corridor_id) AS a, row_number() OVER (PARTITION BY transform, region ORDER BY raw DESC, corridor_id) AS b FROM x),
g AS (SELECT transform, region, count(*) FILTER (a <= 10 AND b <= 10) AS overlap, avg(f) FILTER (a <= 10) AS before, avg(f) FILTER (b <= 10) AS after, avg(score) FILTER (b <= 10) - avg(score) FILTER (a <= 10) AS delta, bool_or(a = 1 AND b <= 3) AS in3 FROM r GROUP BY ALL)
SELECT transform, count(*) AS regions, floor(avg(overlap)*1000+0.5)/1000 AS overlap, floor(avg(before - after)*1000+0.5)/1000 AS nearer, floor(min(delta)*1000+0.5)/1000 AS worst_delta, count(*) FILTER (in3) AS top_in_three FROM g GROUP BY transform""", "corridors")
def exploration_evaluation(spark, sf_dir, corridors):
    metres = geo.haversine(F.lit(LON), F.lit(LAT), F.col("lon"), F.col("lat"))
    t = interest(corridors.where(geo.overlaps(*rel.bounds(), BOX))).withColumn("f", metres / (MILES * geo.MILE)).where("f <= 1")
    forms = F.explode(F.array(F.struct(F.lit("linear").alias("transform"), (10 * F.col("f")).alias("p")), F.struct(F.lit("gentle").alias("transform"), (6 * F.col("f") * F.col("f")).alias("p"))))
    x = t.withColumn("x", forms).select("x.transform", F.col("class_code").alias("region"), "corridor_id", "score", "f", (F.col("score") - F.col("x.p")).alias("raw"))
    at = lambda c: F.row_number().over(W.partitionBy("transform", "region").orderBy(F.desc(c), "corridor_id"))
    tops = [x.withColumn("at", at(c)).where("at <= 10").withColumnRenamed("at", n) for c, n in (("score", "a"), ("raw", "b"))]  # ten of each region go on
    r = tops[0].join(tops[1].select("transform", "region", "corridor_id", "b", F.col("score").alias("s2"), F.col("f").alias("f2")), ["transform", "region", "corridor_id"], "full")
    g = r.groupBy("transform", "region").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("overlap"), (F.avg(F.when(F.col("a").isNotNull(), F.col("f"))) - F.avg("f2")).alias("nearer"),
        (F.avg("s2") - F.avg(F.when(F.col("a").isNotNull(), F.col("score")))).alias("delta"), F.bool_or((F.col("a") == 1) & (F.col("b") <= 3)).alias("in3"),
    )
    return g.groupBy("transform").agg(F.count("*").alias("regions"), geo.half_up(F.avg("overlap")).alias("overlap"), geo.half_up(F.avg("nearer")).alias("nearer"), geo.half_up(F.min("delta")).alias("worst_delta"), F.count_if("in3").alias("top_in_three"))


@query("""+ SELECT corridor_id, wetland_m AS nearest_m, coverage AS wetland_coverage, CAST(crossings AS BIGINT) AS crossing_count, CASE WHEN coverage IN ('FULL','PARTIAL') THEN crossings / (length_m/1609.344e0) END AS per_mile, CAST(eco_count AS DOUBLE) AS regions, CAST(eco_count - 1 AS DOUBLE) AS transitions,
len(list_filter([wetland_m, CAST(eco_count AS DOUBLE)], lambda x: x IS NULL)) AS missing FROM corridors""", "corridors")
def result_rows(spark, sf_dir, corridors):
    """Nested metric blocks, nulls kept, and what the result row reads from them."""
    per_mile = F.when(F.col("coverage").isin("FULL", "PARTIAL"), F.col("crossings") / (F.col("length_m") / geo.MILE))
    blocks = corridors.select(
        "corridor_id", F.struct(F.col("wetland_m").alias("nearest_m"), "coverage").alias("wetlands"), F.struct(F.col("crossings").cast("long").alias("count"), per_mile.alias("per_mile")).alias("water"),
        F.struct(F.col("eco_count").alias("regions"), (F.col("eco_count") - 1).alias("transitions")).alias("ecology"),
    )
    missing = F.size(F.filter(F.array(F.col("wetlands.nearest_m"), F.col("ecology.regions").cast("double")), lambda x: x.isNull())).cast("long")
    return blocks.select(
        "corridor_id", "wetlands.nearest_m", F.col("wetlands.coverage").alias("wetland_coverage"), F.col("water.count").alias("crossing_count"), "water.per_mile", F.col("ecology.regions").cast("double").alias("regions"), F.col("ecology.transitions").cast("double").alias("transitions"), missing.alias("missing")
    )


_BEARING = "degrees(atan2(sin(radians({c} - {a}))*cos(radians({d})), cos(radians({b}))*sin(radians({d})) - sin(radians({b}))*cos(radians({d}))*cos(radians({c} - {a}))))"
_BEAR = lambda x, y: f"(({_BEARING.format(a=f'({LON}e0)', b=f'({LAT}e0)', c=x, d=y)}) + 360) % 360"
_FAR = lambda x, y: sql_haversine(f"({LON}e0)", f"({LAT}e0)", x, y)


@query(
    f"""+ {_O}, {_G}, nv AS (SELECT line_id, min({{'m': {_FAR('lon', 'lat')}, 'x': lon, 'y': lat}}) AS b FROM o GROUP BY line_id),
st AS MATERIALIZED (SELECT line_id, b.m + (line_id % 7)*0.3e0 AS metres, b.x AS near_lon, b.y + (line_id % 5)*0.000004e0 AS near_lat, CASE WHEN line_id % 13 <> 0 THEN {_BEAR('b.x', 'b.y')} + (line_id % 11 - 5)*0.001e0 END AS bearing FROM nv),
f1 AS ({sql_foot(f'({LON}e0)', f'({LAT}e0)', 'line_id, ax + (bx-ax)*t AS x, ay + (by_-ay)*t AS y', 'g')}), c1 AS (SELECT line_id, x, y FROM f1 UNION ALL SELECT line_id, lon, lat FROM o), n1 AS (SELECT line_id, min({{'m': {_FAR('x', 'y')}, 'x': x, 'y': y}}) AS b FROM c1 GROUP BY line_id),
g2 AS (SELECT g.*, near_lon, near_lat FROM g JOIN st USING (line_id)), f2 AS ({sql_foot('near_lon', 'near_lat', 'line_id, near_lon, near_lat, ax + (bx-ax)*t AS x, ay + (by_-ay)*t AS y', 'g2')}),
c2 AS (SELECT * FROM f2 UNION ALL SELECT o.line_id, near_lon, near_lat, lon, lat FROM o JOIN st USING (line_id)), n2 AS (SELECT line_id, min({sql_haversine('near_lon', 'near_lat', 'x', 'y')}) AS off FROM c2 GROUP BY line_id),
j AS (SELECT st.*, n1.b.m AS measured, off, {_BEAR('n1.b.x', 'n1.b.y')} AS again FROM st JOIN n1 USING (line_id) JOIN n2 USING (line_id)),
k AS (SELECT *, abs(bearing - again) % 360 AS turn FROM j)
SELECT line_id, CASE WHEN abs(measured - metres) > 1.000001e0 THEN 'distance' WHEN off > 1.000001e0 THEN 'point off the line' WHEN least(turn, 360 - turn) > degrees(atan2(4e0, greatest(measured, 1e0))) THEN 'direction' ELSE 'verified' END AS state FROM k""",
    "vertices",
)
def context_verification(spark, sf_dir, vertices):
    """Stored search contexts against lines measured anew. What is stored comes from the lines' vertices alone, so many differ."""
    o = lines.ordered(vertices)
    far = geo.haversine(F.lit(LON), F.lit(LAT), F.col("lon"), F.col("lat"))
    near = o.groupBy("line_id").agg(F.min(F.struct(far.alias("m"), "lon", "lat")).alias("b"))
    k = F.col("line_id")
    stored = near.select(
        "line_id", F.lit(LON).alias("c_lon"), F.lit(LAT).alias("c_lat"), (F.col("b.m") + (k % 7) * 0.3).alias("metres"), F.col("b.lon").alias("near_lon"), (F.col("b.lat") + (k % 5) * 0.000004).alias("near_lat"),
        F.when(k % 13 != 0, geo.bearing(F.lit(LON), F.lit(LAT), F.col("b.lon"), F.col("b.lat")) + (k % 11 - 5) * 0.001).alias("bearing"),
    )
    return lines.verified_contexts(stored, o).select("line_id", "state")


@query("""+ c AS (SELECT class_code, count(*) AS n, CAST(sum(corridor_id) AS BIGINT) AS ids FROM corridors GROUP BY class_code) SELECT sha256(string_agg(concat('{"class":', CAST(class_code AS VARCHAR), ',"ids":', CAST(ids AS VARCHAR), ',"n":', CAST(n AS VARCHAR), '}'), '' ORDER BY class_code)) AS fingerprint, count(*) AS parts FROM c""", "corridors")
def analysis_fingerprint(spark, sf_dir, corridors):
    """SHA-256 of the canonical JSON (keys in order) of what an analysis rests on."""
    c = corridors.groupBy("class_code").agg(F.count("*").alias("n"), F.sum("corridor_id").alias("ids"))
    text = F.to_json(F.struct(F.col("class_code").alias("class"), "ids", "n"))
    listed = c.agg(F.array_sort(F.collect_list(F.struct("class_code", text.alias("t")))).alias("x"), F.count("*").alias("parts"))  # fifteen classes
    return listed.select(F.sha2(F.array_join(F.transform("x", lambda v: v["t"]), ""), 256).alias("fingerprint"), "parts")
