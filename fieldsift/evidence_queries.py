"""Registered queries over evidence, page facts, ingest rows and plane checks, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldsift.first_queries import query

def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    codes = F.transform(F.filter(F.split(units, "(?<=\\G.{4})"), lambda u: u != ""), lambda u: F.conv(u, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619) % 4294967296)


@query("SELECT c_custkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length(c_name)+1), lambda i: CAST(ascii(c_name[i]) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS hash FROM customer")
def text_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", fnv1a(F.col("c_name")).alias("hash"))


@query("""WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 29 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 17 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS VARCHAR) END AS state FROM customer)
SELECT coalesce(CASE WHEN name = '' THEN 'no name' WHEN try_cast(state AS BIGINT) IS NULL THEN 'bad state' WHEN CAST(state AS BIGINT) > 20 THEN 'outside' END, 'kept') AS reason, count(*) AS n FROM l GROUP BY ALL""")
def place_ingest(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    line = F.concat_ws("|", F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 29 == 0, "").otherwise(F.col("c_name")), F.when(F.col("c_custkey") % 17 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string")))
    rows = c.select(F.from_csv(line, "id bigint, name string, state string", {"sep": "|"}).alias("r")).select("r.*")
    state = F.expr("try_cast(state AS bigint)")
    reason = F.when(F.coalesce("name", F.lit("")) == "", "no name").when(state.isNull(), "bad state").when(state > 20, "outside").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey % 16 AS shard, count(*) AS n, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated FROM lineitem GROUP BY ALL")
def shard_keys(spark, sf_dir):
    # Counted per key first, so that a large shard is never sorted as one.
    per = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c"))
    return per.groupBy((F.col("l_orderkey") % 16).alias("shard")).agg(F.sum("c").alias("n"), (F.sum("c") - F.count("*")).alias("repeated"))


@query("""WITH a AS (SELECT o_custkey AS unit, count(*) AS declared FROM orders GROUP BY ALL), b AS (SELECT o_custkey AS unit, count(DISTINCT l_orderkey) AS found FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT coalesce(a.unit, b.unit) AS unit, coalesce(declared, 0) AS declared, coalesce(found, 0) AS found FROM a FULL JOIN b ON a.unit = b.unit WHERE declared IS DISTINCT FROM found""")
def unit_reconciliation(spark, sf_dir):
    orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    declared = orders.groupBy(F.col("o_custkey").alias("unit")).agg(F.count("*").alias("declared"))
    keys = items.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    found = orders.select("o_orderkey", F.col("o_custkey").alias("unit")).join(keys, "o_orderkey").groupBy("unit").agg(F.count_distinct("o_orderkey").alias("found"))
    both = declared.join(found, "unit", "full").where(~F.col("declared").eqNullSafe(F.col("found")))
    return both.select("unit", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("declared", "found")))
