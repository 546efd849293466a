"""Access findings from evidence: what an item can decide today, the finding of each corridor, and its adversarial review.

An item is a row: corridor, id, claim, tier (1 the most reliable), org, scope, applies_to, starts, ends, dated (days; null if
the source doesn't say) and recurrence. Everything is aggregated per corridor with map-side combines, so a corridor may have
any number of items; only the names and organizations that claim its maintenance are compared with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.functions.names import name_relation

#: The effect of each kind of claim, claims about a road's status, closures, and days that count as fresh.
EFFECTS = {
    "PUBLIC_ROAD": "AFFIRMATIVE", "MOTOR_VEHICLES_ALLOWED": "AFFIRMATIVE", "ROAD_MAINTAINED": "AFFIRMATIVE", "PRIVATE_ROAD": "RESTRICTIVE", "MOTOR_VEHICLES_RESTRICTED": "RESTRICTIVE", "SEASONAL_CLOSURE": "RESTRICTIVE",
    "TEMPORARY_CLOSURE": "RESTRICTIVE", "PERMIT_REQUIRED": "RESTRICTIVE", "GATE_REPORTED": "ATTENTION", "ROAD_UNMAINTAINED": "ATTENTION", "ROAD_NAME_VARIANT": "ATTENTION", "SURFACE": "NEUTRAL", "ROAD_CLASS": "NEUTRAL",
    "LAND_MANAGER": "NEUTRAL", "ACCESS_TAG_ABSENT": "NEUTRAL", "UNKNOWN": "NEUTRAL",
}
STATUS_CLAIMS = ["PUBLIC_ROAD", "PRIVATE_ROAD", "MOTOR_VEHICLES_ALLOWED", "MOTOR_VEHICLES_RESTRICTED", "PERMIT_REQUIRED"]
CLOSURES = ["TEMPORARY_CLOSURE", "SEASONAL_CLOSURE"]
NEW_DAYS, FRESH_DAYS, AUTHORITY_TIER = 90, 365, 2
SCOPES = ["CORRIDOR", "CORRIDOR_PART", "COUNTY_SEGMENT", "NOT_APPLICABLE"]
#: The rules in order, each with its finding.
RULES = {
    "R1_NO_ACCESS_EVIDENCE": "UNVERIFIED", "R2_STATUS_CONFLICT": "CONFLICTED", "R3_CURRENT_RESTRICTION": "RESTRICTED_OR_CLOSED", "R4_RECURRING_RESTRICTION": "RESTRICTED_OR_CLOSED",
    "R5_LOWER_TIER_RESTRICTION": "PROBABLE_PUBLIC", "R6_AUTHORITATIVE_WHOLE_CORRIDOR": "VERIFIED_PUBLIC", "R7_AUTHORITATIVE_PART_OF_CORRIDOR": "PROBABLE_PUBLIC", "R8_COMMUNITY_ONLY": "PROBABLE_PUBLIC",
    "R9_NO_DECIDING_EVIDENCE": "UNVERIFIED",
}


def _map(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))[key]


def decorated(items: DataFrame, checked: int) -> DataFrame:
    """items with effect, authoritative, freshness, temporal_scope (of restrictive claims) and acting on day checked."""
    effect = F.coalesce(_map(EFFECTS, F.col("claim")), F.lit("NEUTRAL"))
    age = F.lit(checked) - F.coalesce("ends", "dated")
    fresh = F.when(age.isNull(), "UNDATED").when(age <= NEW_DAYS, "CURRENT").when(age <= FRESH_DAYS, "RECENT").otherwise("STALE")
    rows = items.withColumns({"effect": effect, "authoritative": F.coalesce(F.col("tier") <= AUTHORITY_TIER, F.lit(False)), "freshness": fresh})
    window = F.when(F.lit(checked) > F.col("ends"), "EXPIRED").when(F.lit(checked) < F.col("starts"), "UNDATED").otherwise("CURRENT")
    undated = F.when(F.col("recurrence").isNotNull(), "RECURRING").when(F.col("freshness").isin("CURRENT", "RECENT"), "CURRENT").otherwise(F.col("freshness"))
    scope = F.when(F.col("effect") != "RESTRICTIVE", "NOT_APPLICABLE").when(F.col("starts").isNotNull() | F.col("ends").isNotNull(), window).otherwise(undated)
    return rows.withColumn("temporal_scope", scope).withColumn("acting", F.col("temporal_scope").isin("CURRENT", "RECURRING"))


def authority_overlaps(rows: DataFrame) -> DataFrame:
    """corridor, org_a, name_a, org_b, name_b, pairs: organizations that claim to maintain related names of one road, one at
    least as a whole, and how many pairs of items say so. rows come from decorated; a is the pair's side with the smaller
    first id, and b's name is held against a's."""
    claims = rows.where("effect = 'AFFIRMATIVE' and authoritative and claim = 'ROAD_MAINTAINED' and scope <> 'NOT_APPLICABLE' and applies_to is not null and corridor is not null")
    sides = claims.groupBy("corridor", "org", "applies_to").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.count_if(F.col("scope") != "CORRIDOR").alias("parts"))
    a, b = (sides.select("corridor", *(F.col(c).alias(f"{c}_{p}") for c in ("org", "applies_to", "first", "n", "parts"))) for p in "ab")
    met = a.join(b, "corridor").where("org_a <> org_b and first_a < first_b")  # organizations and names of one road
    pairs = F.col("n_a") * F.col("n_b") - F.col("parts_a") * F.col("parts_b")
    met = met.where(name_relation(F.col("applies_to_a"), F.col("applies_to_b")) != "DIFFERENT").withColumn("pairs", pairs).where("pairs > 0")
    return met.select("corridor", "org_a", F.col("applies_to_a").alias("name_a"), "org_b", F.col("applies_to_b").alias("name_b"), "pairs")


def findings(corridors: DataFrame, items: DataFrame, checked: int) -> DataFrame:
    """corridor, rule, finding, public_road, motor_vehicles and the counts that decide, of every row of corridors (corridor)."""
    rows = decorated(items, checked)
    c = F.col
    yes, no = c("effect") == "AFFIRMATIVE", c("effect") == "RESTRICTIVE"
    strong = c("authoritative")
    status = c("claim").isin(STATUS_CLAIMS)
    bars = no & strong & c("acting")
    per = rows.groupBy("corridor").agg(
        F.count("*").alias("n"), F.count_if(yes & strong).alias("affirmative"), F.count_if(yes & ~strong).alias("community"), F.count_if(yes & strong & (c("scope") == "CORRIDOR")).alias("whole"),
        F.count_if(bars).alias("barring"), F.count_if(bars & status).alias("status_against"), F.count_if(bars & (~c("claim").isin(CLOSURES) | (c("temporal_scope") == "CURRENT"))).alias("barring_now"),
        F.count_if(no & ~strong & c("acting") & status).alias("community_against"), F.count_if(no & c("acting")).alias("acting"), F.count_if(no & ~c("acting")).alias("not_acting"),
        F.count_if(c("claim") == "ROAD_NAME_VARIANT").alias("variants"), F.count_distinct(F.when(yes & strong, c("org"))).alias("organizations"),
    )
    overlaps = authority_overlaps(rows).groupBy("corridor").agg((2 * F.sum("pairs")).alias("overlapping"))
    told = corridors.select("corridor").join(per, "corridor", "left").join(overlaps, "corridor", "left")
    told = told.fillna(0, [x for x in (*per.columns, "overlapping") if x != "corridor"])
    some = lambda name: c(name) > 0
    rule = (
        F.when(c("n") == 0, "R1_NO_ACCESS_EVIDENCE").when(some("affirmative") & some("status_against"), "R2_STATUS_CONFLICT").when(some("barring_now"), "R3_CURRENT_RESTRICTION")
        .when(some("barring"), "R4_RECURRING_RESTRICTION").when(some("affirmative") & some("community_against"), "R5_LOWER_TIER_RESTRICTION").when(some("whole"), "R6_AUTHORITATIVE_WHOLE_CORRIDOR")
        .when(some("affirmative"), "R7_AUTHORITATIVE_PART_OF_CORRIDOR").when(some("community"), "R8_COMMUNITY_ONLY").otherwise("R9_NO_DECIDING_EVIDENCE")
    )
    told = told.withColumn("rule", rule).withColumn("finding", _map(RULES, c("rule")))
    road = F.when(c("finding") == "CONFLICTED", "DISPUTED").when(some("whole"), "VERIFIED").when(some("affirmative"), "PARTIAL").when(some("community"), "COMMUNITY ONLY").otherwise("NONE")
    motor = (
        F.when(c("finding") == "RESTRICTED_OR_CLOSED", "RESTRICTED OR CLOSED").when(c("finding") == "VERIFIED_PUBLIC", "VERIFIED")
        .when(c("finding").isin("PROBABLE_PUBLIC", "CONFLICTED"), "PROBABLE ONLY").otherwise("UNVERIFIED")
    )
    return told.withColumns({"public_road": road, "motor_vehicles": motor})


def adversarial_review(found: DataFrame) -> DataFrame:
    """corridor, place (from 1), check, outcome, evidence (items it rests on) of the nine checks of each finding of findings."""
    c = F.col
    concern = lambda test, clear="PASS": F.when(test, "CONCERN").otherwise(clear)
    nothing = F.lit(0).cast("long")
    restricted = c("finding") == "RESTRICTED_OR_CLOSED"
    checks = {
        "ACTING_RESTRICTION": (concern(c("acting") > 0), c("acting")),
        "NEGATIVE_CASE_CONFIRMED": (F.when(~restricted, "NOT_APPLICABLE").when(c("rule").isin("R3_CURRENT_RESTRICTION", "R4_RECURRING_RESTRICTION"), "PASS").otherwise("UNRESOLVED"), nothing),
        "CORRIDOR_PARTIAL": (concern(c("whole") == 0), c("affirmative")),
        "SINGLE_ORGANIZATION": (F.when(c("organizations") == 0, "NOT_APPLICABLE").otherwise(concern(c("organizations") == 1)), nothing),
        "WEAK_SOURCE_ONLY": (concern((c("affirmative") == 0) & (c("community") > 0)), c("community")),
        "STALE_EVIDENCE": (concern(c("not_acting") > 0), c("not_acting")),
        "NAME_VARIANT": (concern(c("variants") > 0), c("variants")),
        "AUTHORITY_OVERLAP": (concern(c("overlapping") > 0), c("overlapping")),
        "EVIDENCE_ABSENCE": (F.when(c("rule") == "R1_NO_ACCESS_EVIDENCE", "UNRESOLVED").otherwise("PASS"), nothing),
    }
    rows = [F.struct(F.lit(n).alias("place"), F.lit(name).alias("check"), outcome.alias("outcome"), evidence.cast("long").alias("evidence")) for n, (name, (outcome, evidence)) in enumerate(checks.items(), 1)]
    return found.select("corridor", F.explode(F.array(*rows)).alias("x")).select("corridor", "x.*")
