"""Registered queries over occurrence records and over the places they are searched from, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldsift.functions import geo
from fieldsift.first_queries import query, sql_haversine

#: Taxonomic groups by kind, the lenses over them, radii of the cumulative buckets, the accuracy of a precise point.
GROUPS = ["birds", "mammals", "reptiles", "amphibians", "fish", "insects", "arachnids", "plants", "fungi"]
LENSES = {"birds": ["birds"], "mammals": ["mammals"], "herps": ["reptiles", "amphibians"], "insects": ["insects", "arachnids"], "plants": ["plants"], "fungi": ["fungi"]}
RADII = [1000, 5000, 10_000]
PRECISE_M = 500.0

_GROUP = "list_extract([" + ", ".join(f"'{g}'" for g in GROUPS) + "], CAST(kind AS INTEGER) + 1)"
_PRECISION = f"CASE WHEN obscured THEN 'OBSCURED' WHEN lon IS NULL THEN 'UNAVAILABLE' WHEN accuracy IS NULL OR accuracy > {PRECISE_M} THEN 'APPROXIMATE' ELSE 'PRECISE' END"
_N = f"n AS (SELECT *, {_GROUP} AS grp, {_PRECISION} AS precision_ FROM records)"


def group_of(kind: Column) -> Column:
    return F.get(F.array(*map(F.lit, GROUPS)), kind)


def privacy(records: DataFrame) -> DataFrame:
    """records with precision; the point and the distance stay only where the record is precise."""
    precision = F.when(F.col("obscured"), "OBSCURED").when(F.col("lon").isNull(), "UNAVAILABLE").when(F.col("accuracy").isNull() | (F.col("accuracy") > PRECISE_M), "APPROXIMATE").otherwise("PRECISE")
    rows = records.withColumn("precision", precision)
    return rows.withColumns({c: F.when(F.col("precision") == "PRECISE", F.col(c)) for c in ("lon", "lat", "metres")})


@query(f"+ {_N} SELECT precision_ AS precision, count(*) AS n, count(*) FILTER (precision_ = 'PRECISE') AS usable, floor(coalesce(sum(lat) FILTER (precision_ = 'PRECISE'), 0)*10+0.5)/10 AS lat_sum FROM n GROUP BY precision_", "records")
def privacy_decision(spark, sf_dir, records):
    return privacy(records).groupBy("precision").agg(F.count("*").alias("n"), F.count("lon").alias("usable"), geo.half_up(F.coalesce(F.sum("lat"), F.lit(0.0)), 1).alias("lat_sum"))


PAGE = "total long, results array<struct<id: long, taxon: struct<id: long, iconic: string>, accuracy: double, obscured: boolean, captive: boolean>>"


def normalize_pages(pages: DataFrame) -> DataFrame:
    """One row per record of JSON result pages (corridor, payload); records without an id or a taxon are no records."""
    rows = pages.select("corridor", F.from_json("payload", PAGE).alias("page")).select("corridor", F.explode("page.results").alias("r"))
    picked = rows.select("corridor", F.col("r.id").alias("record_id"), F.col("r.taxon.id").alias("taxon"), F.col("r.taxon.iconic").alias("grp"), F.col("r.accuracy").alias("accuracy"), F.coalesce("r.obscured", F.lit(False)).alias("obscured"))
    return picked.where("record_id is not null and taxon is not null")


@query(f"+ {_N} SELECT corridor, record_id, taxon, grp, accuracy, obscured FROM n WHERE taxon % 10 <> 3", "records")
def occurrence_ingest(spark, sf_dir, records):
    known = F.when(F.col("taxon") % 10 != 3, F.struct(F.col("taxon").alias("id"), group_of(F.col("kind")).alias("iconic")))
    one = F.struct(F.col("record_id").alias("id"), known.alias("taxon"), "accuracy", "obscured", "captive")
    pages = records.groupBy("corridor", (F.col("record_id") / 200).cast("long")).agg(F.to_json(F.struct(F.count("*").alias("total"), F.collect_list(one).alias("results"))).alias("payload"))  # 200 records a page
    return normalize_pages(pages)


@query(f"""+ {_N} SELECT CASE WHEN precision_ = 'PRECISE' AND metres <= 1000 THEN 'LOCAL' WHEN age_days > 365 THEN 'HISTORICAL' ELSE 'RECENT' END AS evidence,
CASE WHEN age_days <= 30 THEN 'd30' WHEN age_days <= 90 THEN 'd90' WHEN age_days <= 365 THEN 'd365' ELSE 'historical' END AS recency, count(*) AS n, count(DISTINCT taxon) AS taxa FROM n GROUP BY ALL""", "records")
def evidence_kind(spark, sf_dir, records):
    age = F.col("age_days")
    evidence = F.when(F.col("metres") <= RADII[0], "LOCAL").when(age > 365, "HISTORICAL").otherwise("RECENT")
    recency = F.when(age <= 30, "d30").when(age <= 90, "d90").when(age <= 365, "d365").otherwise("historical")
    return privacy(records).groupBy(evidence.alias("evidence"), recency.alias("recency")).agg(F.count("*").alias("n"), F.count_distinct("taxon").alias("taxa"))


@query(f"""+ {_N} SELECT corridor, CAST(r.radius AS BIGINT) AS radius, count(*) AS observations, count(DISTINCT taxon) AS taxa, min(metres) AS nearest, min(age_days) AS latest_days
FROM n JOIN (VALUES (1000), (5000), (10000)) r(radius) ON metres <= r.radius WHERE precision_ = 'PRECISE' GROUP BY ALL""", "records")
def radius_buckets(spark, sf_dir, records):
    # Each record is exploded to the radii that hold it; three at most.
    held = F.explode(F.filter(F.array(*(F.lit(r).cast("long") for r in RADII)), lambda r: r >= F.col("metres")))
    rows = privacy(records).where("metres is not null").withColumn("radius", held)
    return rows.groupBy("corridor", "radius").agg(F.count("*").alias("observations"), F.count_distinct("taxon").alias("taxa"), F.min("metres").alias("nearest"), F.min("age_days").alias("latest_days"))


@query(f"""+ {_N} SELECT grp, taxon, count(*) AS observations, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, array_to_string(list_sort(list(record_id))[1:5], ',') AS samples, min(metres) FILTER (precision_ = 'PRECISE') AS nearest,
CAST(sum(count(*)) OVER (PARTITION BY grp) AS BIGINT) AS group_observations FROM n GROUP BY grp, taxon""", "records")
def taxon_rollup(spark, sf_dir, records):
    rows = privacy(records).withColumn("grp", group_of(F.col("kind")))
    # The five smallest ids are taken before they are gathered, so no group is collected whole.
    ranked = rows.withColumn("at", F.row_number().over(W.partitionBy("grp", "taxon").orderBy("record_id")))
    ids = ranked.where("at <= 5").groupBy("grp", "taxon").agg(F.array_join(F.transform(F.array_sort(F.collect_list("record_id")), lambda x: x.cast("string")), ",").alias("samples"))
    per = rows.groupBy("grp", "taxon").agg(F.count("*").alias("observations"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("metres").alias("nearest"))  # two sources
    total = per.groupBy("grp").agg(F.sum("observations").alias("group_observations"))
    return per.join(ids, ["grp", "taxon"]).join(total, "grp").select("grp", "taxon", "observations", "sources", "samples", "nearest", "group_observations")


@query(f"""+ {_N} SELECT corridor, count(*) AS records, count(DISTINCT taxon) AS taxa, count(*) FILTER (precision_ = 'PRECISE') AS precise, count(*) FILTER (precision_ <> 'PRECISE') AS regional, count(*) FILTER (captive) AS captive,
min(metres) FILTER (precision_ = 'PRECISE') AS nearest, min(age_days) AS latest_days FROM n GROUP BY corridor""", "records")
def occurrence_totals(spark, sf_dir, records):
    precise = F.col("precision") == "PRECISE"
    return privacy(records).groupBy("corridor").agg(
        F.count("*").alias("records"), F.count_distinct("taxon").alias("taxa"), F.count_if(precise).alias("precise"), F.count_if(~precise).alias("regional"), F.count_if("captive").alias("captive"),
        F.min("metres").alias("nearest"), F.min("age_days").alias("latest_days"),
    )


@query("+ r AS (SELECT corridor, kind % 3 AS region, count(*) + any_value(CASE WHEN corridor % 4 = 0 THEN 5 ELSE 0 END) AS reported, count(*) AS retrieved FROM records GROUP BY corridor, kind % 3) SELECT corridor, count(*) AS regions, count(*) FILTER (reported > retrieved) AS truncated, CAST(sum(reported - retrieved) AS BIGINT) AS missing, CASE WHEN count(*) FILTER (reported > retrieved) > 0 THEN 'PARTIAL' ELSE 'FULL' END AS coverage FROM r GROUP BY corridor", "records")
def retrieval_completeness(spark, sf_dir, records):
    told = records.groupBy("corridor", (F.col("kind") % 3).alias("region")).agg(F.count("*").alias("retrieved"))
    told = told.withColumn("reported", F.col("retrieved") + F.when(F.col("corridor") % 4 == 0, 5).otherwise(0))
    cut = F.count_if(F.col("reported") > F.col("retrieved"))
    return told.groupBy("corridor").agg(F.count("*").alias("regions"), cut.alias("truncated"), F.sum(F.col("reported") - F.col("retrieved")).alias("missing"), F.when(cut > 0, "PARTIAL").otherwise("FULL").alias("coverage"))


@query("""+ s AS (SELECT corridor, source, CASE WHEN corridor % 5 = 0 THEN 'UNKNOWN' WHEN corridor % 5 < 3 THEN 'FULL' WHEN source = 'ebird' THEN 'UNKNOWN' ELSE 'NONE' END AS state FROM records GROUP BY ALL)
SELECT corridor, CASE WHEN bool_and(state = 'UNKNOWN') THEN 'UNKNOWN' WHEN bool_and(state = 'FULL') THEN 'FULL' ELSE 'PARTIAL' END AS coverage FROM s GROUP BY corridor""", "records")
def combined_occurrence_coverage(spark, sf_dir, records):
    k = F.col("corridor") % 5
    state = F.when(k == 0, "UNKNOWN").when(k < 3, "FULL").when(F.col("source") == "ebird", "UNKNOWN").otherwise("NONE")
    s = records.select("corridor", "source").distinct().withColumn("state", state)
    every = lambda x: F.bool_and(F.col("state") == x)
    return s.groupBy("corridor").agg(F.when(every("UNKNOWN"), "UNKNOWN").when(every("FULL"), "FULL").otherwise("PARTIAL").alias("coverage"))


@query(f"+ {_N} SELECT l.lens, count(DISTINCT taxon) AS taxa, count(*) AS n FROM n JOIN (VALUES " + ", ".join(f"('{k}', '{g}')" for k, v in LENSES.items() for g in v) + ") l(lens, grp) USING (grp) GROUP BY l.lens UNION ALL SELECT 'all', count(DISTINCT taxon), count(*) FROM records", "records")
def taxon_lens(spark, sf_dir, records):
    lens = records.sparkSession.createDataFrame([(k, g) for k, v in {**LENSES, "all": GROUPS}.items() for g in v], "lens string, grp string")
    rows = records.withColumn("grp", group_of(F.col("kind"))).join(F.broadcast(lens), "grp")  # sixteen rows
    return rows.groupBy("lens").agg(F.count_distinct("taxon").alias("taxa"), F.count("*").alias("n"))


@query("SELECT corridor_id, floor(((south+north)/2)*1e5+0.5)/1e5 AS lat, floor(((west+east)/2)*1e5+0.5)/1e5 AS lon, CAST(greatest(1, least(50, ceil((length_m/2 + 10000)/1000))) AS BIGINT) AS km, floor((south - 10000/110000e0)*1e5+0.5)/1e5 AS sw_lat, floor((west - 10000/(111320*greatest(cos(radians((south+north)/2)), 0.2e0)))*1e5+0.5)/1e5 AS sw_lon FROM corridors", "corridors")
def search_disk(spark, sf_dir, corridors):
    lat = (F.col("south") + F.col("north")) / 2
    pad = 10_000 / (111_320 * F.greatest(F.cos(F.radians(lat)), F.lit(0.2)))
    km = F.greatest(F.lit(1), F.least(F.lit(50), F.ceil((F.col("length_m") / 2 + 10_000) / 1000))).cast("long")
    return corridors.select("corridor_id", geo.half_up(lat, 5).alias("lat"), geo.half_up((F.col("west") + F.col("east")) / 2, 5).alias("lon"), km.alias("km"), geo.half_up(F.col("south") - 10_000 / 110_000.0, 5).alias("sw_lat"), geo.half_up(F.col("west") - pad, 5).alias("sw_lon"))


_REGION = (-122.5, 44.8, -121.0, 45.6)
_GAP = "sqrt(pow(greatest(-122.5e0-lon, 0e0, lon+121e0)*111320e0*cos(radians(lat)), 2) + pow(greatest(44.8e0-lat, 0e0, lat-45.6e0)*110540e0, 2))"
_LIMIT = 10 * geo.MILE


@query(f"""+ w AS (SELECT *, {_GAP} AS gap FROM places) SELECT reason, count(*) AS n, min(place_id) AS first_id, floor(max(gap)*10+0.5)/10 AS widest FROM (SELECT *, CASE WHEN state % 5 = 4 THEN 'state' WHEN lon < {_REGION[0]} - 0.3 OR lon > {_REGION[2]} + 0.3 OR lat < {_REGION[1]} - 0.2 OR lat > {_REGION[3]} + 0.2 THEN 'outside-window'
WHEN gap > {_LIMIT!r} THEN 'beyond-margin' WHEN NOT starts_with(name, 'Customer#') THEN 'suffix' ELSE 'kept' END AS reason FROM w) GROUP BY reason""", "places")
def gazetteer_window(spark, sf_dir, places):
    w, s, e, n = _REGION
    lon, lat = F.col("lon"), F.col("lat")
    x, y = (F.greatest(low - c, F.lit(0.0), c - high) for c, low, high in ((lon, F.lit(w), e), (lat, F.lit(s), n)))
    gap = F.sqrt(F.pow(x * geo.METRES_LON * F.cos(F.radians(lat)), F.lit(2)) + F.pow(y * geo.METRES_LAT, F.lit(2)))
    reason = (
        F.when(F.col("state") % 5 == 4, "state").when((lon < w - 0.3) | (lon > e + 0.3) | (lat < s - 0.2) | (lat > n + 0.2), "outside-window")
        .when(F.col("gap") > _LIMIT, "beyond-margin").when(~F.col("name").startswith("Customer#"), "suffix").otherwise("kept")
    )
    return places.withColumn("gap", gap).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("place_id").alias("first_id"), geo.half_up(F.max("gap"), 1).alias("widest"))


@query("""+ g AS (SELECT 'Customer#' || lpad(CAST(s_suppkey*7 % 900 AS VARCHAR), 9, '0') AS name, s_nationkey AS state, s_suppkey % 3 AS county, s_suppkey AS id FROM supplier UNION ALL SELECT 'Ford ' || CAST(s_suppkey % 20 AS VARCHAR), s_nationkey, s_suppkey % 3, s_suppkey + 1000000 FROM supplier)
SELECT name, state, county, min(id) AS id FROM g WHERE NOT EXISTS (SELECT 1 FROM places p WHERE p.name = g.name AND p.state = g.state) GROUP BY ALL""", "places")
def communities(spark, sf_dir, places):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    county = (F.col("s_suppkey") % 3).alias("county")
    named = s.select(F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 7 % 900).cast("string"), 9, "0")).alias("name"), F.col("s_nationkey").alias("state"), county, F.col("s_suppkey").alias("id"))
    other = s.select(F.concat(F.lit("Ford "), (F.col("s_suppkey") % 20).cast("string")).alias("name"), F.col("s_nationkey").alias("state"), county, (F.col("s_suppkey") + 1_000_000).alias("id"))
    new = named.unionByName(other).join(places.select("name", "state"), ["name", "state"], "left_anti")
    return new.groupBy("name", "state", "county").agg(F.min("id").alias("id"))


@query("""WITH p AS (SELECT o_custkey AS place, o_orderkey % 7 AS county, CAST(floor(o_totalprice) AS BIGINT) AS people FROM orders), t AS (SELECT place, county, sum(people) AS people FROM p GROUP BY ALL),
b AS (SELECT place, CAST(sum(people) AS BIGINT) AS population, arg_max(county, people*10 + county) AS county FROM t GROUP BY place)
SELECT c_custkey AS place_id, population, county, n_name AS state FROM customer LEFT JOIN b ON b.place = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def place_population(spark, sf_dir):
    o, c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation"))
    parts = o.groupBy(F.col("o_custkey").alias("place"), (F.col("o_orderkey") % 7).alias("county")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("people"))
    per = parts.groupBy("place").agg(F.sum("people").alias("population"), F.max_by("county", F.struct("people", "county")).alias("county"))  # the larger code on ties
    rows = c.join(per, c["c_custkey"] == per["place"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return rows.select(F.col("c_custkey").alias("place_id"), "population", "county", F.col("n_name").alias("state"))


@query("SELECT l_orderkey AS zcta, l_suppkey AS county, l_quantity AS land FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_suppkey) = 1")
def zcta_county(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    first = F.struct((-F.col("l_quantity")).alias("q"), "l_linenumber", F.col("l_suppkey").alias("county"), F.col("l_quantity").alias("land"))
    best = rows.groupBy(F.col("l_orderkey").alias("zcta")).agg(F.min(first).alias("x"))  # combined on the map side; no window
    return best.select("zcta", "x.county", "x.land")


#: Abbreviations that place names are searched by.
ABBREVIATIONS = {"st": "saint", "mt": "mount", "ft": "fort"}


def place_text(name: Column) -> Column:
    """A place name as it is searched: marks dropped, separators as single spaces, abbreviations written out."""
    marks = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüý", "aaaaaaceeeeiiiinooooouuuuy")
    words = F.split(F.trim(F.regexp_replace(marks, "[^a-z0-9]+", " ")), " ")
    spelled = F.transform(words, lambda w: F.coalesce(*(F.when(w == k, v) for k, v in ABBREVIATIONS.items()), w))
    return F.array_join(spelled, " ")


@query("""SELECT p_partkey AS id, array_to_string(list_transform(string_split(trim(regexp_replace(lower(translate(n, 'éÉ', 'ee')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: CASE w WHEN 'st' THEN 'saint' WHEN 'mt' THEN 'mount' WHEN 'ft' THEN 'fort' ELSE w END), ' ') AS key
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'St. ' WHEN 1 THEN 'MT-' WHEN 2 THEN 'Ft ' ELSE 'Été  ' END || p_name || ' (St)' AS n FROM part)""")
def place_keys(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey") % 4
    name = F.concat(F.when(k == 0, "St. ").when(k == 1, "MT-").when(k == 2, "Ft ").otherwise("Été  "), "p_name", F.lit(" (St)"))
    return p.select(F.col("p_partkey").alias("id"), place_text(name).alias("key"))


@query(f"""+ p AS (SELECT record_id, corridor AS line_id, lon, lat FROM records WHERE {_PRECISION} = 'PRECISE' QUALIFY row_number() OVER (PARTITION BY corridor ORDER BY record_id) <= 800), o AS (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY nth, xu, yu) AS k, xu/1e6 AS x, yu/1e6 AS y FROM vertices),
g AS (SELECT * FROM (SELECT line_id, x AS ax, y AS ay, lead(x) OVER (PARTITION BY line_id ORDER BY k) AS bx, lead(y) OVER (PARTITION BY line_id ORDER BY k) AS by_ FROM o) WHERE bx IS NOT NULL),
s AS (SELECT record_id, (bx-ax)*cos(radians(lat))*111320e0 AS dx, (by_-ay)*110540e0 AS dy, (lon-ax)*cos(radians(lat))*111320e0 AS px, (lat-ay)*110540e0 AS py FROM p JOIN g USING (line_id)),
t AS (SELECT *, CASE WHEN dx*dx + dy*dy = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, (px*dx + py*dy)/(dx*dx + dy*dy))) END AS t FROM s)
SELECT record_id, floor(min(sqrt(pow(px-t*dx, 2) + pow(py-t*dy, 2)))+0.5) AS metres FROM t GROUP BY record_id""", "records", "vertices")
def occurrence_distance(spark, sf_dir, records, vertices):
    from fieldsift.operators import lines

    own = privacy(records).where("precision = 'PRECISE'").withColumn("line_id", F.col("corridor"))
    few = own.withColumn("at", F.row_number().over(W.partitionBy("line_id").orderBy("record_id"))).where("at <= 800")  # the report's own cap
    _, metres = lines.foot(F.col("lon"), F.col("lat"), *(F.col(c) for c in ("ax", "ay", "bx", "by")))
    pairs = few.join(lines.segments(lines.ordered(vertices)), "line_id")
    return pairs.groupBy("record_id").agg(geo.half_up(F.min(metres), 0).alias("metres"))
