"""Road names as direction and core, and how two names relate, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Direction words with their short forms, and words that name a kind of street.
DIRECTIONS = {
    "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
    "n": "n", "s": "s", "e": "e", "w": "w", "ne": "ne", "nw": "nw", "se": "se", "sw": "sw",
}
STREET_WORDS = ["rd", "road", "st", "street", "ave", "avenue", "blvd", "boulevard", "dr", "drive", "ln", "lane", "hwy", "highway", "ct", "court", "way", "pl", "place"]


def name_parts(name: Column) -> Column:
    """direction (short form of the first direction word, or empty) and core (the words that are neither direction nor kind)."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    short = F.create_map(*(F.lit(x) for pair in DIRECTIONS.items() for x in pair))
    led = F.filter(F.transform(words, lambda w: short[w]), lambda d: d.isNotNull())
    core = F.filter(words, lambda w: ~w.isin(*DIRECTIONS, *STREET_WORDS))
    return F.struct(F.coalesce(F.get(led, F.lit(0)), F.lit("")).alias("direction"), core.alias("core"))


def name_relation(road: Column, way: Column) -> Column:
    """SAME, DIRECTION_VARIANT, CORE_VARIANT (the way has half of the road's core words, rounded up) or DIFFERENT."""
    a, b = name_parts(road), name_parts(way)
    shared = F.size(F.filter(b["core"], lambda w: F.array_contains(a["core"], w)))
    same = F.when(a["direction"] == b["direction"], "SAME").otherwise("DIRECTION_VARIANT")
    return (
        F.when((F.size(a["core"]) == 0) | (F.size(b["core"]) == 0), "DIFFERENT").when(a["core"] == b["core"], same)
        .when(shared >= F.ceil(F.size(a["core"]) / 2), "CORE_VARIANT").otherwise("DIFFERENT")
    )
