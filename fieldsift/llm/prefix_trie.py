"""The trie of conversations' prefixes from sorted sequences, their LCPs and sparse-table range minima.

1. A conversation becomes the sequence of its turns' digests (16 bytes each), so prefixes are byte prefixes.
2. Sequences are sorted over ranges of bounded size (equal ones by conv_id, so that a sequence that a third of all
   conversations share spreads over many ranges). In a range the LCPs of neighbours go into a sparse table; every
   candidate prefix (sequence, depth) binary-searches its left and right extent there, each on its own, which gives its
   members as an interval. No stack, no row per member and prefix.
3. Only prefixes of a range's first and last sequence can go on in other ranges. They are not finished there: each range
   hands on its two outer sequences with what it knows of each depth (members, smallest member, finished children,
   leaves and savings below). These form a far smaller input for the same step, until one range holds all.
4. Nodes whose parent was finished later look it up by range and prefix; end lists of unfinished nodes come as one string
   per range and are hashed in the order of their ids.

Edge cases: turns go by turn (null first), ties by their digest; null roles and texts become empty; rows without conv_id
belong to no conversation; repeated rows are turns of their own; further columns are ignored; without conversations there
is no node. A conversation's digests and word counts (20 bytes a turn) are one row: its prefixes need their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table

DIGEST = 16
#: Turns of a range, and outer sequences that one last range may hold.
RANGE_TURNS, LAST_SEQUENCES = 200_000, 4096
WORDS = r"[^\x20\x09-\x0D]+"
NO_IDS = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, parent_key binary, node_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Per depth 0.. of an outer sequence: members, smallest member, finished children, leaves and savings below.
HELD = ("n", "low", "kids", "leaves", "saved")
MADE = f"kind string, range_id long, {NODE}, key binary, words array<int>, keys array<binary>, {', '.join(f'{c} array<long>' for c in HELD)}, ids string"
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
_MADE = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split(" ") for x in MADE.split(", "))])
_NONE_LOW = 2**63 - 1


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, key (16 bytes a turn) and words (of each turn's text) of the conversations of turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).alias("words")).alias("x"))
    held = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return held.select("conv_id", F.unhex(F.array_join(F.transform("x", lambda t: F.hex(t["digest"])), "")).alias("key"), F.col("x.words").alias("words"))


def share_openings(seqs: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """seqs, where the first h turns come from conversation c - c % every; h = crc32(decimal c) % (most + 1)."""
    base = seqs.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.substring("key", 1, most * DIGEST).alias("base_key"), F.slice("words", 1, most).alias("base_words")
    )
    own = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int"))
    return own.join(base, "base", "left").select(
        "conv_id",
        F.expr(f"concat(coalesce(substring(base_key, 1, h * {DIGEST}), cast('' as binary)), substring(key, h * {DIGEST} + 1))").alias("key"),
        F.expr("concat(coalesce(slice(base_words, 1, h), array()), slice(words, h + 1, greatest(size(words) - h, 0)))").cast("array<int>").alias("words"),
    )


class SparseTable:
    """Range minima of values in constant time; runs(k)[i] is the least of the 2**k values from i on."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[: len(low) - width], low[width:]))
            width *= 2

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The largest r for each at with values[at + 1 .. r] >= least."""
        pos = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            row = self.levels[k]
            inside = pos + 1 < len(row)
            ok = inside & (row[np.where(inside, pos + 1, 0)] >= least)
            pos[ok] += 1 << k
        return pos

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest l for each at with values[l + 1 .. at] >= least."""
        pos = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            row = self.levels[k]
            start = pos - (1 << k) + 1
            inside = start >= 1
            ok = inside & (row[np.where(inside, start, 0)] >= least)
            pos[ok] -= 1 << k
        return pos


def _ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of groups of these sizes: each element's group, and its place in the group."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def neighbour_lcps(digests: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Turns that each sequence shares with the one before it; -1 for the first."""
    begin = np.cumsum(lengths) - lengths
    room = np.minimum(lengths[1:], lengths[:-1])
    group, j = _ragged(room)
    differs = (digests[begin[1:][group] + j] != digests[begin[:-1][group] + j]).any(axis=1)
    lcp = np.concatenate([[-1], room])
    np.minimum.at(lcp, group[differs] + 1, j[differs])
    return lcp


def prefix_keys(key: bytes) -> list[bytes]:
    """A digest for each prefix of a sequence, the empty one first."""
    h = hashlib.sha256()
    out = [h.digest()]
    for a in range(0, len(key), DIGEST):
        h.update(key[a : a + DIGEST])
        out.append(h.digest())
    return out


def range_nodes(ids: np.ndarray, keys: list[bytes], words: np.ndarray, held: dict[str, np.ndarray], first_level: bool, last: bool, range_id: int) -> list[pa.RecordBatch]:
    """Finished nodes, outer sequences and end lists of one sorted range. held: HELD of each sequence and depth, flat."""
    n = len(keys)
    lengths = np.array([len(k) for k in keys], np.int64) // DIGEST
    digests = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    lcp = neighbour_lcps(digests, lengths)
    table = SparseTable(lcp)

    # candidates: of each sequence the prefix where it branches off, and all longer ones
    seq, step = _ragged(lengths - np.maximum(lcp, 0) + 1)
    depth = np.maximum(lcp, 0)[seq] + step
    left, right = table.left(seq, depth), table.right(seq, depth)
    own = left == seq
    i, d, r = seq[own], depth[own], right[own]
    new = lengths - lcp  # nodes that each sequence is the first to hold
    start = np.concatenate([[0], np.cumsum(new)])
    branch = np.zeros(n, np.int64)
    branch[seq[~own]] = left[~own]
    at = np.arange(len(i))
    above = branch[i]
    parent = np.where(d - 1 > lcp[i], at - 1, start[above] + (d - 1) - lcp[above] - 1)
    parent[d == 0] = -1

    # sums and minima over members: by depth and sequence, members of a node lie side by side
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    flat_seq, flat_depth = _ragged(lengths + 1)
    order = np.lexsort((flat_seq, flat_depth))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    lo, hi = place[begin[i] + d], place[begin[r] + d]

    def total(values: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(values[order])])
        return run[hi + 1] - run[lo]

    n_convs, kids, leaves, saved = (total(held[c]) for c in ("n", "kids", "leaves", "saved"))
    by_place = np.argsort(lo)
    low = np.empty(len(i), np.int64)
    low[by_place] = np.minimum.reduceat(held["low"][order], lo[by_place])

    outer = np.zeros(len(i), bool) if last else (i == 0) | (r == n - 1)
    done = ~outer
    kids += np.bincount(parent[done & (parent >= 0)], minlength=len(i))
    said = np.concatenate([[0], words])[np.where(d > 0, (np.cumsum(lengths) - lengths)[i] + d, 0)]
    own_leaf = np.where(done, leaves + (kids == 0), 0)
    own_saved = np.where(done, saved + (n_convs - 1) * said, 0)
    end = start[r + 1]
    for column, mine in ((leaves, own_leaf), (saved, own_saved)):
        run = np.concatenate([[0], np.cumsum(mine)])
        below = run[end] - run[at]
        column[done] = below[done]
        kid = done & (parent >= 0) & outer[parent]
        np.add.at(column, parent[kid], below[kid])

    ends: dict[int, str] = {}  # node: its members that end there
    if first_level:
        same = np.zeros(n, bool)
        same[1:] = (lcp[1:] == lengths[1:]) & (lengths[1:] == lengths[:-1])
        firsts = np.flatnonzero(~same)
        for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), n]):
            ends[int(start[a + 1] - 1) if new[a] else int(start[branch[a]] + lengths[a] - lcp[branch[a]] - 1)] = ",".join(map(str, ids[a:b].tolist()))

    outer_keys = (prefix_keys(keys[0]), prefix_keys(keys[-1]))
    shared = int(lcp[1:].min()) if n > 1 else -1

    def key_of(x: int) -> bytes:
        return outer_keys[0 if i[x] == 0 else 1][d[x]]

    out = []
    if done.any():
        x = np.flatnonzero(done)
        up = parent[x]
        open_ = (up >= 0) & outer[up]
        known = {p: key_of(p) for p in np.unique(up[open_]).tolist()}
        node_keys: list[bytes | None] = [None] * len(x)
        if not first_level:
            per_seq = [prefix_keys(k) for k in keys]
            node_keys = [per_seq[s][t] for s, t in zip(i[x].tolist(), d[x].tolist())]
        hashes = [hashlib.sha256(ends[v].encode()).hexdigest() if v in ends else NO_IDS for v in x.tolist()] if first_level else [None] * len(x)
        out.append(_made(
            len(x), kind=["node"] * len(x), range_id=[range_id] * len(x), conv_id=low[x], depth=d[x],
            parent_conv_id=pa.array(np.where(up >= 0, low[up], 0), pa.int64(), mask=(up < 0) | open_),
            parent_key=[known[p] if o else None for p, o in zip(up.tolist(), open_.tolist())], node_key=node_keys,
            n_convs=n_convs[x], n_children=kids[x], n_leaves=leaves[x], saved_tokens=saved[x], ends_sha256=hashes,
        ))
    if not last:
        for which, s in ((0, 0), (1, n - 1)) if n > 1 and lengths[-1] > shared else ((0, 0),):
            depths = np.arange(lengths[s] + 1)
            mine = depths > shared if which else depths >= 0
            nodes = np.full(len(depths), -1)
            if which:  # the last sequence's own prefixes, wherever they begin
                deep = depths[mine]
                first = table.left(np.full(len(deep), s), deep)
                nodes[mine] = start[first] + deep - lcp[first] - 1
            else:
                nodes = depths.copy()
            values = {c: [np.where(mine, v[nodes], none).tolist()] for c, v, none in (("n", n_convs, 0), ("low", low, _NONE_LOW), ("kids", kids, 0), ("leaves", leaves, 0), ("saved", saved, 0))}
            a = int(lengths[:s].sum())
            new_keys = [k for k, m in zip(outer_keys[which], mine.tolist()) if m]
            out.append(_made(1, kind=["outer"], range_id=[range_id], conv_id=[int(ids[s])], key=[keys[s]], words=[words[a : a + lengths[s]].tolist()], keys=[new_keys], **values))
        for x, text in ends.items():
            if outer[x]:
                out.append(_made(1, kind=["ends"], range_id=[range_id], conv_id=[int(text.split(",", 1)[0])], node_key=[key_of(x)], ids=[text]))
    return out


def _made(rows: int, **columns: object) -> pa.RecordBatch:
    arrays = []
    for f in _MADE:
        x = columns.get(f.name)
        arrays.append(pa.nulls(rows, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_MADE)


def _step(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """Runs range_nodes on each partition of sorted rows (conv_id, key, words, and HELD after the first level)."""
    first_level = level == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=None) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        ids = table.column("conv_id").to_numpy()
        keys = table.column("key").to_pylist()
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        size = sum(len(k) // DIGEST + 1 for k in keys)
        if first_level:
            held = {c: np.zeros(size, np.int64) for c in HELD}
            held["n"] += 1
            held["low"] = np.repeat(ids, [len(k) // DIGEST + 1 for k in keys])
        else:
            held = {c: flat(c) for c in HELD}
        yield from range_nodes(ids, keys, flat("words"), held, first_level, last, (level << 32) + TaskContext.get().partitionId())

    return rows.mapInArrow(run, MADE)


def _end_hashes(lists: DataFrame) -> DataFrame:
    """node_key, ends_sha256 of end lists (node_key, conv_id: its first, ids): streamed in the order of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, hashlib.sha256()
        keys, hashes = [], []
        for batch in batches:
            for k, ids in zip(batch.column("node_key").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    h.update(b"," + ids.encode())
                    continue
                if key is not None:
                    keys.append(key)
                    hashes.append(h.hexdigest())
                key, h = k, hashlib.sha256(ids.encode())
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([*keys, key], pa.binary()), pa.array([*hashes, h.hexdigest()], pa.string())], ["node_key", "ends_sha256"])

    return lists.select("node_key", "conv_id", "ids").repartition("node_key").sortWithinPartitions("node_key", "conv_id").mapInArrow(run, "node_key binary, ends_sha256 string")


def prefix_trie(seqs: DataFrame, range_turns: int = RANGE_TURNS, last_sequences: int = LAST_SEQUENCES) -> DataFrame:
    """The nodes of the trie of seqs (conv_id distinct, key, words), as the columns of NODE without the keys."""
    spark = seqs.sparkSession
    rows = as_table(seqs, "sequences")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels: list[DataFrame] = []
    while True:
        size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("turns")).first()
        if not levels:
            parts = max(1, min(size["n"], max(least, -(-size["turns"] // range_turns))))
        else:  # what is handed on shrinks at every level
            parts = 1 if size["n"] <= last_sequences and size["turns"] <= range_turns else max(2, -(-size["n"] // last_sequences), min(-(-size["turns"] // range_turns), size["n"] // 32))
            if size["n"] < 64:
                parts = 1
        dealt = rows.coalesce(1) if parts == 1 else rows.repartitionByRange(parts, "key", "conv_id")
        made = as_table(_step(dealt.sortWithinPartitions("key", "conv_id"), len(levels), parts == 1), "trie")
        levels.append(made)
        if parts == 1:
            break
        rows = made.where("kind = 'outer'").select("conv_id", "key", "words", *HELD)
    nodes = [made.where("kind = 'node'").select("range_id", *(x.split(" ")[0] for x in NODE.split(", "))) for made in levels]
    later = nodes[1:]
    out = nodes[0]
    if later:
        late = later[0]
        for more in later[1:]:
            late = late.union(more)
        late = late.drop("ends_sha256").join(_end_hashes(levels[0].where("kind = 'ends'")), "node_key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS)))
        late = as_table(late.select(*out.columns), "late-nodes")
        out = out.union(late)
        outer = levels[0].where("kind = 'outer'")
        for made in levels[1:]:
            outer = outer.union(made.where("kind = 'outer'"))
        named = outer.select("range_id", F.explode("keys").alias("parent_key")).join(late.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("named")), "parent_key")
        open_ = out.where("parent_key is not null").drop("parent_conv_id").join(named, ["range_id", "parent_key"], "left").withColumnRenamed("named", "parent_conv_id")
        out = out.where("parent_key is null").union(open_.select(*out.columns))
    return out.drop("range_id", "parent_key", "node_key")
