"""Approximate nearest neighbours by multiprobe p-stable hashing.

Rows with the same vector are one class, of which at most k + 1 smallest vec_ids can be in any answer. Each of TABLES
hash tables projects unit vectors on FUNCTIONS random Gaussian directions and cuts each projection into cells. A query
visits its own cell and PROBES - 1 perturbed ones, in the order of their estimated success (sum of squared distances to
the cell borders that are crossed). Every visited bucket is searched exactly, its best few rows go on (all that tie with
the last of them), and the tables' candidates are merged and ranked by the exact cosine.

Buckets that hold more than BUCKET_BLOCK classes or get more than VISIT_BLOCK visits are dealt in blocks of both, and each
block of classes meets each block of visits, so no task holds an unbounded bucket and no candidate is dropped. Queries
that found fewer than k rows are searched once more, against all classes in blocks.

Edge cases: vectors that are null, zero, or hold null, NaN or infinite components take no part, neither as query nor as
candidate; vectors of another length than the query's are no candidates; repeated rows (same vec_id and vector) are one;
scores that differ by less than 1e-14 are ties, and ties go to the smaller vec_id; with fewer than k candidates all are
returned; further columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_table
from .runs import whole_groups

TABLES = 8
FUNCTIONS = 6
PROBES = 28
#: Cell width in standard deviations of a unit vector's projections.
WIDTH = 2.0
BUCKET_BLOCK = 4096
VISIT_BLOCK = 8192


def _directions(table: int, dim: int, functions: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([table, dim, functions])
    return rng.normal(size=(dim, functions)) / WIDTH, rng.random(functions)


def _bucket(table: int, dim: int, cells: np.ndarray) -> np.ndarray:
    h = np.full(len(cells), table * 1_000_003 + dim, np.int64)
    for j in range(cells.shape[1]):
        h = (h * 6364136223846793005 + cells[:, j].astype(np.int64) * 2 + 1) ^ ((h >> 29) & 0x7FFFFFFFF)
    return h


def perturbations(gaps: list[tuple[float, int, int]], n: int) -> list[list[tuple[int, int]]]:
    """The n best sets of steps (function, +1 or -1) by the sum of squared gaps; gaps are sorted, each function once."""
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(gaps[0][0], (0,))]
    while heap and len(out) < n:
        score, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if len({gaps[i][1] for i in chosen}) == len(chosen):
            out.append([gaps[i][1:] for i in chosen])
        if last + 1 < len(gaps):
            step = gaps[last + 1][0]
            heapq.heappush(heap, (score - gaps[last][0] + step, (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + step, (*chosen, last + 1)))
    return out


def _cells(vectors: np.ndarray, table: int, functions: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = _directions(table, vectors.shape[1], functions)
    x = vectors @ a + b
    return np.floor(x), x


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and unit vectors, for each vector length that occurs."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes := column.value_lengths().to_numpy(zero_copy_only=False))
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        v = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
        yield rows, v / np.linalg.norm(v, axis=1, keepdims=True)


def valid_vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id and vector (array of float or double, as it came) of the rows that can take part."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    rows = table.where(F.col(id_column).isNotNull() & v.isNotNull() & finite & some)
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), (v if dict(table.dtypes)[vector_column] == "array<float>" else v.cast("array<double>")).alias("vector"))


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector with its k + 1 smallest vec_ids."""
    same = W.partitionBy(F.xxhash64("vector"), "vector").orderBy("vec_id")
    rows = vectors.distinct().withColumn("_at", F.row_number().over(same)).where(F.col("_at") <= k + 1)  # limited before the shuffle, too
    return rows.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("class_id", F.col("ids")[0])


def _hash_rows(rows: DataFrame, probes: int, tables: int, functions: int, keep: str) -> DataFrame:
    """A row per table (and probe) with its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, unit in _by_length(batch.column("vector")):
                dim = unit.shape[1]
                for t in range(tables):
                    cells, x = _cells(unit, t, functions)
                    if probes == 1:
                        at, buckets = rows_, _bucket(t, dim, cells)
                    else:
                        below = x - cells
                        visited = []
                        for i in range(len(rows_)):
                            gaps = sorted([(float(below[i, j]) ** 2, j, -1) for j in range(functions)] + [(float(1 - below[i, j]) ** 2, j, 1) for j in range(functions)])
                            steps = np.zeros((probes, functions))
                            sets = perturbations(gaps, probes)
                            for p, moves in enumerate(sets):
                                for j, d in moves:
                                    steps[p, j] = d
                            visited.append(cells[i] + steps[: len(sets)])
                        at = np.repeat(rows_, [len(v) for v in visited])
                        buckets = _bucket(t, dim, np.concatenate(visited))
                    taken = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(buckets), *(taken.column(c) for c in batch.schema.names)], ["bucket", *batch.schema.names])

    return rows.mapInArrow(run, f"bucket long, {keep}")


def _best(q: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows that can be among its k best, ties included, and their cosines."""
    norm_rows, norm_q = np.sqrt((rows * rows).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    for a in range(0, len(q), 512):
        rough = (q[a : a + 512] @ rows.T) / (norm_rows * norm_q[a : a + 512, None])
        take = min(k, len(rows))
        least = -np.partition(-rough, take - 1, axis=1)[:, take - 1] - 1e-9  # far above rounding, far below what counts
        for i, top in enumerate(rough >= least[:, None]):
            at = np.flatnonzero(top)
            yield at, (rows[at] * q[a + i]).sum(axis=1) / (norm_rows[at] * norm_q[a + i])


def _search_groups(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """class_id, vec_id, score: the best rows of each block of a bucket for each visit, the block's rows first."""
    for table, starts in whole_groups(batches, ["bucket", "dim", "part", "visit"], 8192):
        asks, ids = table.column("asks").to_numpy(), table.column("class_id").to_numpy()
        members = table.column("ids").to_pylist()
        column = table.column("vector").combine_chunks()
        flat, ends = column.flatten().to_numpy().astype(np.float64), np.cumsum(column.value_lengths().to_numpy())
        out: list[tuple[int, int, float]] = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
            split = s + int(np.searchsorted(asks[s:e], 1))
            if split in (s, e):
                continue
            v = flat[(ends[s - 1] if s else 0) : ends[e - 1]].reshape(e - s, -1)
            for i, (at, score) in enumerate(_best(v[split - s :], v[: split - s], k + 1)):
                found = ((-round(sc, 14), m) for sc, r in zip(score.tolist(), at.tolist()) for m in members[s + r])
                out += [(int(ids[split + i]), m, -sc) for sc, m in heapq.nsmallest(k + 1, found)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["class_id", "vec_id", "score"])


def _meet(classes: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """class_id (of the query), vec_id, score: visits (bucket, class_id, vector) searched in classes (bucket, class_id, ids, vector).

    Both are dealt to blocks of bounded size inside their bucket and vector length; every pair of blocks is one group.
    """
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["bucket", "dim"]
    held, asking = (x.withColumn("dim", F.size("vector")) for x in (classes, visits))

    def blocks_of(rows: DataFrame, block: int, name: str) -> DataFrame:
        wide = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > block)
        return wide.select(*key, F.ceil(F.col("n") / block).alias(name))

    few, many = blocks_of(held, BUCKET_BLOCK, "parts"), blocks_of(asking, VISIT_BLOCK, "visits")
    own = lambda name: F.pmod(F.xxhash64("class_id"), F.coalesce(name, F.lit(1).cast("long")))
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(name, F.lit(1).cast("long")) - 1))
    a, b = (x.join(few, key, "left").join(many, key, "left") for x in (held, asking))
    both = a.select(*key, own("parts").alias("part"), every("visits").alias("visit"), F.lit(0).cast("long").alias("asks"), "class_id", "ids", "vector").unionByName(
        b.select(*key, every("parts").alias("part"), own("visits").alias("visit"), F.lit(1).cast("long").alias("asks"), "class_id", F.lit(None).cast("array<long>").alias("ids"), "vector")
    )
    dealt = both.withColumn("dim", F.col("dim").cast("long")).repartition(n, *key, "part", "visit").sortWithinPartitions(*key, "part", "visit", "asks")
    return dealt.mapInArrow(lambda batches: _search_groups(batches, k), "class_id long, vec_id long, score double")


def _lists(found: DataFrame, k: int) -> DataFrame:
    """class_id and near, its k + 1 best (far, vec_id) in order."""
    best = W.partitionBy("class_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("class_id", "vec_id").agg(F.max("score").alias("score"))
    few = once.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= k + 1)
    return few.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))


def search(queries: DataFrame, base: DataFrame, k: int = 5, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of base for each query, both with vec_id and vector.

    A row is no candidate of the query with its own vec_id.
    """
    kind = dict(base.dtypes)["vector"]
    queries = queries.withColumn("vector", F.col("vector").cast(kind))
    classes = classes_of(base, k)
    asked = queries.groupBy("vector").agg(F.min("vec_id").alias("class_id"))
    hashed = _hash_rows(classes.select("class_id", "ids", "vector"), 1, tables, functions, f"class_id long, ids array<long>, vector {kind}")
    probed = _hash_rows(asked.select("class_id", "vector"), probes, tables, functions, f"class_id long, vector {kind}")
    near = as_table(_lists(_meet(hashed, probed, k), k), "ann-near")
    # Queries that their buckets gave fewer than k others: all classes in blocks, for these queries alone.
    poor = asked.join(near.where(F.size("near") > k), "class_id", "left_anti")
    if not poor.isEmpty():
        whole = lambda x: x.withColumn("bucket", F.lit(0).cast("long"))
        again = _lists(_meet(whole(classes), whole(poor.select("class_id", "vector")), k), k)
        near = near.where(F.size("near") > k).unionByName(again)
    mine = queries.distinct().join(asked, "vector").join(near, "class_id").select(F.col("vec_id").alias("query_id"), "near")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = mine.select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
