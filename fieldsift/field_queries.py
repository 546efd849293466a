"""Registered queries over tracks, quality gates and exports, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldsift.functions import geo
from fieldsift.operators import relations as rel
from fieldsift.first_queries import _DIST, _NEAR, MILES, SCORED, query, search, sql_cells, sql_haversine
from fieldsift.sources.cells import feature_json
from fieldsift.streaming import tracks

_FIX = """user_id AS trip, event_id AS seq, {micros} AS micros, -121.5e0 + (event_id*37 % 400)/1000000.0e0 AS lon,
45.0e0 + (event_id*53 % 1500)/1000000.0e0 AS lat, CASE WHEN event_id % 23 = 0 THEN NULL ELSE (event_id*31 % 290)*1.0e0 END AS accuracy"""
_FIXES = f"fixes AS MATERIALIZED (SELECT {_FIX.format(micros='epoch_us(ts)')} FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"
_MOVED = sql_haversine("s.lon", "s.lat", "f.lon", "f.lat").replace("12742000.0e0", repr(2 * tracks.EARTH_M) + "e0")
_SAMPLED = f"""WITH RECURSIVE {_FIXES}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY micros, seq) AS k FROM fixes),
s AS (SELECT trip, CAST(0 AS BIGINT) AS k, NULL::BIGINT AS seq, NULL::BIGINT AS told, NULL::BIGINT AS micros, NULL::DOUBLE AS lon, NULL::DOUBLE AS lat, 0 AS n, '' AS reason FROM (SELECT DISTINCT trip FROM fixes)
UNION ALL SELECT trip, k, seq, told, CASE WHEN keeps THEN told ELSE micros END, CASE WHEN keeps THEN new_lon ELSE lon END, CASE WHEN keeps THEN new_lat ELSE lat END, n + CASE WHEN keeps THEN 1 ELSE 0 END, reason
 FROM (SELECT *, reason IN ('first','moved','interval') AS keeps FROM (SELECT f.trip, f.k, f.seq, f.micros AS told, s.micros, f.lon AS new_lon, f.lat AS new_lat, s.lon, s.lat, s.n,
 CASE WHEN f.accuracy > 250 THEN 'poor-accuracy' WHEN s.n = 0 THEN 'first' WHEN s.n >= 5000 THEN 'full' WHEN {_MOVED} >= 100 THEN 'moved' WHEN {_MOVED} >= 25 AND f.micros - s.micros >= 15000000 THEN 'interval' ELSE 'unchanged' END AS reason
 FROM s JOIN o f ON f.trip = s.trip AND f.k = s.k + 1)))"""


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null and ts is not null")
    return rows.selectExpr(*(x.strip() for x in _split(_FIX.format(micros="unix_micros(CAST(ts AS TIMESTAMP))"))))


def _split(columns: str) -> list[str]:
    """A select list at its outer commas."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@query(f"{_SAMPLED} SELECT trip, seq, reason FROM s WHERE k > 0")
def track_sampling(spark, sf_dir):
    return tracks.sample_tracks(fixes(spark, sf_dir)).select("trip", "seq", "reason")


_LEG = sql_haversine("lag(lon) OVER w", "lag(lat) OVER w", "lon", "lat")


@query(f"""{_SAMPLED}, p AS (SELECT trip, seq, told, lon, lat FROM s WHERE k > 0 AND reason IN ('first','moved','interval')),
l AS (SELECT trip, told, {_LEG} AS leg, (told - lag(told) OVER w)/1e6 AS sec FROM p WINDOW w AS (PARTITION BY trip ORDER BY told, seq)),
j AS (SELECT *, leg > 1000 AND (sec <= 0 OR leg/sec > 100) AS jump FROM l)
SELECT trip, count(*) AS points, count(*) FILTER (jump) AS skipped_legs, floor(coalesce(sum(leg) FILTER (NOT jump), 0)*1000+0.5)/1000 AS metres, CAST(max(told) - min(told) AS BIGINT) AS micros FROM j GROUP BY trip""")
def trip_totals(spark, sf_dir):
    kept = tracks.sample_tracks(fixes(spark, sf_dir)).where(F.col("reason").isin("first", "moved", "interval"))
    before = W.partitionBy("trip").orderBy("micros", "seq")
    leg = geo.haversine(F.lag("lon").over(before), F.lag("lat").over(before), F.col("lon"), F.col("lat"))
    legs = kept.withColumn("leg", leg).withColumn("sec", (F.col("micros") - F.lag("micros").over(before)) / 1e6)
    jump = (F.col("leg") > 1000) & ((F.col("sec") <= 0) | (F.col("leg") / F.col("sec") > 100))
    length = geo.half_up(F.coalesce(F.sum(F.when(~jump, F.col("leg"))), F.lit(0.0)))
    return legs.groupBy("trip").agg(F.count("*").alias("points"), F.count_if(jump).alias("skipped_legs"), length.alias("metres"), (F.max("micros") - F.min("micros")).alias("micros"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS part FROM g)
SELECT user_id AS trip, epoch_us(min(ts)) AS began, epoch_us(max(ts)) AS finished, count(*) AS n FROM s GROUP BY user_id, part""")
def trip_lifecycle(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null").select(F.col("user_id").alias("trip"), F.col("ts").cast("timestamp").alias("ts"))
    s = tracks.sessions(rows, "ts", "6 hours")
    return s.select("trip", F.unix_micros("began").alias("began"), F.unix_micros("finished").alias("finished"), "n")


@query(f"""+ s AS ({SCORED}), t AS (SELECT corridor_id, score, {_DIST} AS metres FROM s WHERE {_NEAR} AND {_DIST} <= {MILES * geo.MILE!r} ORDER BY score DESC, corridor_id LIMIT 30),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, corridor_id) AS i, row_number() OVER (ORDER BY score - least(30e0, metres/1609.344e0*0.4e0) DESC, corridor_id) AS place FROM t),
p AS (SELECT a.place AS high, b.place AS near FROM r a JOIN r b ON a.i < b.i AND a.score - b.score <= 1 AND a.metres > b.metres)
SELECT count(*) AS tension, count(*) FILTER (near < high) AS resolved FROM p""", "corridors")
def near_tie(spark, sf_dir, corridors):
    top = search(corridors).orderBy(F.desc("score"), "corridor_id").limit(30)  # the report's own window
    explore = F.col("score") - F.least(F.lit(30.0), F.col("metres") / geo.MILE * 0.4)
    order = F.row_number().over(W.orderBy(F.desc("score"), "corridor_id"))
    r = top.select("score", "metres", order.alias("i"), F.row_number().over(W.orderBy(explore.desc(), "corridor_id")).alias("place"))
    a, b = r.alias("a"), r.alias("b")
    tense = (F.col("a.i") < F.col("b.i")) & (F.col("a.score") - F.col("b.score") <= 1) & (F.col("a.metres") > F.col("b.metres"))
    return a.join(b, tense).agg(F.count("*").alias("tension"), F.count_if(F.col("b.place") < F.col("a.place")).alias("resolved"))


@query("SELECT l_orderkey AS feature, count(DISTINCT l_suppkey) AS geometries FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1")
def geometry_conflicts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy(F.col("l_orderkey").alias("feature")).agg(F.count_distinct("l_suppkey").alias("geometries")).where("geometries > 1")


@query("""WITH p AS (SELECT l_orderkey AS unit, CASE WHEN l_orderkey % 40 = 1 THEN l_partkey + 1 ELSE l_partkey END AS part, l_linenumber AS nth FROM lineitem WHERE l_linenumber < 7 AND l_orderkey % 100 <> 33),
a AS (SELECT l_orderkey AS unit, list_sort(list(concat(CAST(l_partkey AS VARCHAR), ':', CAST(l_linenumber AS VARCHAR)))) AS v FROM lineitem GROUP BY ALL), b AS (SELECT unit, list_sort(list(concat(CAST(part AS VARCHAR), ':', CAST(nth AS VARCHAR)))) AS v FROM p GROUP BY ALL)
SELECT coalesce(a.unit, b.unit) AS unit, CASE WHEN b.unit IS NULL THEN 'new' WHEN a.unit IS NULL THEN 'lost' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.unit = b.unit WHERE a.v IS DISTINCT FROM b.v""")
def segmentation_difference(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("nth"))
    before = rows.where("nth < 7 AND unit % 100 <> 33").withColumn("part", F.when(F.col("unit") % 40 == 1, F.col("part") + 1).otherwise(F.col("part")))
    return rel.changed_groups(rows, before, ["unit"])


@query("SELECT l_orderkey AS unit, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) GROUP BY l_orderkey HAVING bool_or(k <> l_linenumber)")
def index_sequence(spark, sf_dir):
    # An index runs 1..count exactly where its values are distinct and its ends are 1 and count: no window is needed.
    g = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("unit"))
    g = g.agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("d"), F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"))
    return g.where("d <> n or low <> 1 or high <> n").select("unit", "n")


@query("""SELECT count(*) AS n, count(*) - count(DISTINCT place_id) AS repeated_ids, count(*) FILTER (lon < -124 OR lon > -119 OR lat < 44 OR lat > 46.5) AS out_of_bounds,
count(*) FILTER (length(trim(name)) = 0) AS unnamed, count(*) FILTER (state NOT IN (SELECT n_nationkey FROM nation)) AS unknown_state, count(*) FILTER (population < 0) AS negative FROM places""", "places")
def gazetteer_rules(spark, sf_dir, places):
    known = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("state"), F.lit(True).alias("known")).distinct()
    p = places.join(known, "state", "left")
    outside = (F.col("lon") < -124) | (F.col("lon") > -119) | (F.col("lat") < 44) | (F.col("lat") > 46.5)
    return p.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("place_id")).alias("repeated_ids"), F.count_if(outside).alias("out_of_bounds"), F.count_if(F.length(F.trim("name")) == 0).alias("unnamed"),
                 F.count_if(F.col("known").isNull() & F.col("state").isNotNull()).alias("unknown_state"), F.count_if(F.col("population") < 0).alias("negative"))


@query(f"+ m AS ({sql_cells('corridors')}) SELECT corridor_id, count(*) AS cells, count(*) FILTER (x = floor(lon/0.2e0) AND y = floor(lat/0.2e0)) AS home FROM m GROUP BY corridor_id HAVING count(*) > 1", "corridors")
def declared_replication(spark, sf_dir, corridors):
    home = (F.col("x") == F.floor(F.col("lon") / 0.2)) & (F.col("y") == F.floor(F.col("lat") / 0.2))
    return rel.member_cells(corridors).groupBy("corridor_id").agg(F.count("*").alias("cells"), F.count_if(home).alias("home")).where("cells > 1")


@query("""SELECT corridor_id, to_json({'type': 'Feature', 'id': corridor_id, 'geometry': {'type': 'Point', 'coordinates': [lon, lat]}, 'properties': {'name': name, 'crossings': crossings}})::VARCHAR AS feature FROM corridors""", "corridors")
def feature_export(spark, sf_dir, corridors):
    return corridors.select("corridor_id", feature_json(F.col("corridor_id"), F.col("lon"), F.col("lat"), name=F.col("name"), crossings=F.col("crossings")).alias("feature"))
