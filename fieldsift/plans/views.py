"""Planes derived from the given tables by the same arithmetic in Spark and in the oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (table, select list); the same text runs in both engines.
VIEWS = {
    "places": ("customer", "c_custkey AS place_id, c_name AS name, c_nationkey AS state, -124.0e0 + (c_custkey*7919 % 100000)/20000.0e0 AS lon, 44.0e0 + (c_custkey*104729 % 100000)/40000.0e0 AS lat, c_acctbal AS population"),
    "corridors": (
        "orders",
        """o_orderkey AS corridor_id, concat('Road ', CAST(o_orderkey % 97 AS VARCHAR(20))) AS name, o_orderkey % 15 AS class_code,
        -124.0e0 + (o_orderkey*7919 % 100000)/20000.0e0 AS lon, 44.0e0 + (o_orderkey*104729 % 100000)/40000.0e0 AS lat,
        -124.0e0 + (o_orderkey*7919 % 100000)/20000.0e0 - 0.004e0*(1 + o_orderkey % 7) AS west, 44.0e0 + (o_orderkey*104729 % 100000)/40000.0e0 - 0.003e0*(1 + o_orderkey % 5) AS south,
        -124.0e0 + (o_orderkey*7919 % 100000)/20000.0e0 + 0.004e0*(1 + o_orderkey % 7) AS east, 44.0e0 + (o_orderkey*104729 % 100000)/40000.0e0 + 0.003e0*(1 + o_orderkey % 5) AS north,
        1500.0e0 + (o_orderkey*31 % 12000) AS length_m, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey*17 % 2000)*1.0e0 END AS wetland_m,
        o_orderkey % 13 AS crossings, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 1 + o_orderkey % 4 END AS eco_count,
        CASE WHEN o_orderkey % 6 = 0 THEN 'PARTIAL' WHEN o_orderkey % 10 = 0 THEN 'NONE' WHEN o_orderkey % 17 = 0 THEN 'UNKNOWN' ELSE 'FULL' END AS coverage""",
    ),
    "habitats": (
        "part",
        """p_partkey AS habitat_id, p_brand AS code, p_type AS label, -124.0e0 + (p_partkey*7919 % 100000)/20000.0e0 - 0.01e0*(1 + p_size % 4) AS west,
        44.0e0 + (p_partkey*104729 % 100000)/40000.0e0 - 0.01e0 AS south, -124.0e0 + (p_partkey*7919 % 100000)/20000.0e0 + 0.01e0 AS east,
        44.0e0 + (p_partkey*104729 % 100000)/40000.0e0 + 0.01e0*(1 + p_size % 3) AS north, p_size AS size""",
    ),
    "fixes": ("events", "*"),
    "records": (
        "events",
        """event_id AS record_id, user_id AS corridor, CASE WHEN event_type = 'view' THEN 'ebird' ELSE 'inat' END AS source, event_id*13 % 211 AS taxon, event_id*13 % 211 % 9 AS kind,
        event_id*37 % 500 AS age_days, event_id % 11 = 0 AS obscured, event_id % 29 = 0 AS captive, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id*31 % 900)*1.0e0 END AS accuracy,
        CASE WHEN event_id % 31 = 0 THEN NULL ELSE -124.0e0 + (event_id*7919 % 100000)/20000.0e0 END AS lon, 44.0e0 + (event_id*104729 % 100000)/40000.0e0 AS lat, (event_id*977 % 15000)*1.0e0 AS metres""",
    ),
    "vertices": (
        "lineitem",
        """l_orderkey AS line_id, l_linenumber AS nth, -124000000 + (l_orderkey*7919 % 100000)*50 + (l_partkey % 40)*500 AS xu,
        44000000 + (l_orderkey*104729 % 100000)*25 + (l_suppkey % 25)*400 AS yu""",
    ),
    "tangles": (
        "lineitem",
        """l_orderkey AS line_id, l_linenumber AS nth, -124000000 + (l_orderkey*7919 % 100000)*50 + (l_partkey % 4)*600 AS xu,
        44000000 + (l_orderkey*104729 % 100000)*25 + (l_suppkey % 3)*400 AS yu""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"fieldsift_{table}")
    return spark.sql(f"SELECT {columns.replace('VARCHAR(20)', 'STRING')} FROM fieldsift_{table}")


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL with the views it names as common table expressions."""
    ctes = ", ".join(f"{n} AS (SELECT {VIEWS[n][1]} FROM {VIEWS[n][0]})" for n in names)
    return f"WITH RECURSIVE {ctes}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}"
