"""Connected components of a DataFrame of edges by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.sources.tables import as_table, drop_table, shuffled

#: Nodes of a round up to which Spark may broadcast them: a few MB, whatever the files' compression makes of them.
SMALL = 100_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) of every node of edges (a, b: longs).

    Each round points every node at its smallest neighbour, follows the pointers twice, and replaces each edge by the
    edge between what its ends point at; a star vanishes in one round. Joins are on nodes and can be split by AQE, the
    minimum is combined on the map side, and every round is written to the shared folder, so a lost executor costs at
    most one round.
    """
    plain = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = as_table(plain, "edges")
    labels: DataFrame | None = None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select(F.col("b"), F.col("a")))
        up = as_table(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("up")), "pointers")
        dealt = shuffled if up.count() > SMALL else (lambda df: df)
        jump = up.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        twice = up.join(dealt(jump), "up").select("node", F.col("up2").alias("up"))
        jump4 = as_table(twice, "pointers")
        four = jump4.join(dealt(jump4.select(F.col("node").alias("up"), F.col("up").alias("up4"))), "up").select("node", F.col("up4").alias("up"))
        pointers = as_table(four, "pointers")
        if labels is None:
            labels = pointers.select("node", F.col("up").alias("component"))
        else:
            moved = labels.join(dealt(pointers.select(F.col("node").alias("component"), "up")), "component", "left")
            labels = as_table(moved.select("node", F.coalesce("up", "component").alias("component")), "labels")
        p, q = (pointers.select(F.col("node").alias(x), F.col("up").alias(f"{x}2")) for x in "ab")
        moved_edges = left.join(dealt(p), "a").join(dealt(q), "b").where("a2 <> b2")
        nxt = as_table(moved_edges.select(F.greatest("a2", "b2").alias("a"), F.least("a2", "b2").alias("b")).distinct(), "edges")
        drop_table(left)
        drop_table(up)
        drop_table(jump4)
        left = nxt
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
