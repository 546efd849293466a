"""MinHash near-duplicates by an inverted join on signature coordinates.

1. Every document gets its set of word shingles as 64-bit hashes, an exact key of that set and a signature of
   COORDINATES minima. Documents with one set are one class; from here on only a class's first document counts.
2. Each class is posted under every (coordinate, value). Two signatures that agree in MATCH coordinates or more share
   one of their COORDINATES - MATCH + 1 rarest postings, so only that prefix of postings, rarest first, is merged; the
   coordinates that are skipped are compared on the signatures themselves, where collisions are counted.
3. A posting list is worked through leader by leader: rows that collide often enough with a leader become its family.
   Lists longer than LIST_BLOCK are dealt in salted blocks, whose leaders then meet in pairs of blocks. Families are
   looser than the wanted similarity by more than it can differ between members, so every wanted pair lies in one.
4. Within a family links are confirmed on the full sets: a document is compared with all others unless it already
   hangs together with the family's main part, so all links between components are found while only a spanning forest is
   written. Families above FAMILY_BLOCK documents are compared as pairs of blocks.

Nothing of step 2 to 4 emits all pairs of a group: rows grow with the documents and their postings.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing (component_id is its
own doc_id); a text with fewer words than a shingle is one shingle; repeated rows are one class; a doc_id with several
texts is one node with the links of all of them, so all its rows, wordless ones too, have one component_id (distinct_rows
decides by text instead); a null doc_id is linked with nothing and kept; further columns are ignored; very long texts are
hashed whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_table, blocks, shuffled, texts, whole_row
from .components import components
from .runs import whole_groups

COORDINATES = 64
LIST_BLOCK = 2048
FAMILY_BLOCK = 4096
#: Share of coordinates from which a row belongs to a leader's family outright.
COVER = 0.6

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _M1)
    return base[:n] | np.uint64(1), base[n:]


class Shingler:
    """Sets of word shingles as sorted distinct 64-bit hashes; A-Z are lower-cased, words split at ASCII white space."""

    def __init__(self, words: int):
        import xxhash

        class Digests(dict):
            def __missing__(self, word: bytes) -> int:
                found = self[word] = xxhash.xxh3_64_intdigest(word)
                return found

        self.words, self.cache = words, Digests()

    def hashes(self, text: str) -> np.ndarray:
        found = text.encode().lower().split()  # bytes: only A-Z change, only the six ASCII characters split
        if not found:
            return np.zeros(0, np.uint64)
        cache = self.cache
        if len(cache) > 500_000:
            cache.clear()
        h = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out * _M2) ^ h[i : len(h) - k + 1 + i]
            out = (out ^ (out >> np.uint64(29))) * _M3
        return np.unique(_mix(out))


def match_threshold(percent: int) -> int:
    """Collisions that a pair at the wanted similarity reaches but for about one time in 100,000."""
    j = percent / 100
    return max(1, math.floor(COORDINATES * j - 4.3 * math.sqrt(COORDINATES * j * (1 - j))))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set) and the signature's coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler, (mul, add) = Shingler(words), _constants(COORDINATES)
        for batch in blocks(batches, "text", 8_000_000, 4096):
            n, key, sig = [], [], []
            for text in batch.column("text").to_pylist():
                h = shingler.hashes(text)
                n.append(len(h))
                if not len(h):
                    key.append(None)
                    sig.append(None)
                    continue
                key.append(xxhash.xxh3_128_digest(h.tobytes()))
                low = np.full(COORDINATES, 2**64 - 1, np.uint64)
                for a in range(0, len(h), 2048):
                    low = np.minimum(low, (h[a : a + 2048, None] * mul + add).min(axis=0))
                sig.append((low >> np.uint64(32)).astype("<u4").view("<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").combine_chunks(), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "set_key", "sig"]
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig array<int>")


def _postings(classes: DataFrame, match: int) -> DataFrame:
    """token, node, size of the prefix list: the rarest shared postings of each class, where two or more meet."""
    posted = classes.select("node", F.posexplode("sig")).select("node", F.xxhash64("pos", "col").alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    mine = posted.join(shuffled(shared), "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("rare"))  # COORDINATES at most
    room = COORDINATES - match + 1 - (COORDINATES - F.size("rare"))  # postings that nobody shares are the rarest
    prefix = mine.where(room > 0).select("node", F.explode(F.slice("rare", F.lit(1), room)).alias("x")).select("node", "x.token")
    sizes = prefix.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    return prefix.join(shuffled(sizes), "token")


def _work_lists(rows: DataFrame, link: int, cover: int, n: int) -> DataFrame:
    """rows: list_id, token, node, sig (packed), split. Family edges (a, b), and leaders (b null) of lists that are split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["list_id"]):
            node = table.column("node").to_numpy()
            token = table.column("token").to_numpy()
            split = table.column("split").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, COORDINATES)
            m = len(node)
            sizes = np.diff(np.append(starts, m))
            group = np.repeat(np.arange(len(starts)), sizes)
            free = np.ones(m, bool)
            label = np.arange(m)  # what hangs together already, so that each list writes a forest only
            a, b, lead = [], [], []
            rows_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
            lead.append(np.flatnonzero(np.repeat(sizes == 1, sizes)))
            while len(rows_):
                open_ = rows_[free[rows_]]
                g, first = np.unique(group[open_], return_index=True)
                leader_of = np.full(len(starts), -1)
                leader_of[g] = open_[first]
                rows_ = rows_[leader_of[group[rows_]] >= 0]
                leader = leader_of[group[rows_]]
                hits = (sig[rows_] == sig[leader]).sum(axis=1)
                near = hits >= link
                fresh = near & (label[rows_] != label[leader])
                _, one = np.unique(label[rows_[fresh]], return_index=True)
                a.append(node[leader[fresh][one]])
                b.append(node[rows_[fresh][one]])
                joins = np.zeros(m, bool)
                joins[label[rows_[fresh]]] = True
                moved = joins[label[rows_]]
                label[rows_[moved]] = label[leader[moved]]
                free[rows_[hits >= cover]] = False
                lead.append(open_[first])
            leads = np.concatenate(lead)
            leads = leads[split[leads]]
            x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            if len(x):
                x, y = np.unique(np.stack([x, y]), axis=1)
                none = pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), *none], ["a", "b", "token", "sig"])
            if len(leads):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[leads]), pa.nulls(len(leads), pa.int64()), pa.array(token[leads]), table.column("sig").combine_chunks().take(pa.array(leads))], ["a", "b", "token", "sig"]
                )

    dealt = rows.repartition(n, "list_id").sortWithinPartitions("list_id", "node")
    return dealt.mapInArrow(run, "a long, b long, token long, sig binary")


def _block_pairs(rows: DataFrame, size: str, block: int, key: str, node: str) -> DataFrame:
    """Deals each row of a group to the pairs of blocks that its block belongs to; one pair where the group is small."""
    n = F.ceil(F.col(size) / block)
    mine = F.pmod(F.xxhash64(node, F.lit(7)), n)
    other = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    dealt = rows.withColumn("_n", n).withColumn("_i", mine).withColumn("_j", other)
    return dealt.withColumn("list_id", F.xxhash64(key, F.least("_i", "_j"), F.greatest("_i", "_j"))).drop("_n", "_i", "_j")


def families(classes: DataFrame, percent: int) -> DataFrame:
    """node, family: loose groups that hold every pair of the wanted similarity together."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cover = round(COVER * COORDINATES)
    link = max(6, math.floor((COVER - (1 - percent / 100) - 0.1) * COORDINATES))
    listed = _postings(classes.select("node", "sig"), match_threshold(percent)).join(shuffled(classes.select("node", "packed")), "node")
    salt = F.pmod(F.xxhash64("node", "token"), F.ceil(F.col("size") / LIST_BLOCK))
    rows = listed.select(F.xxhash64("token", salt).alias("list_id"), "token", "node", F.col("packed").alias("sig"), (F.col("size") > LIST_BLOCK).alias("split"))
    found = as_table(_work_lists(rows, link, cover, n), "lists")
    edges = found.where("b is not null").select("a", "b")
    leaders = found.where("b is null").select(F.col("a").alias("node"), "token", "sig")
    sizes = leaders.groupBy("token").agg(F.count("*").alias("size"))
    paired = _block_pairs(leaders.join(shuffled(sizes), "token"), "size", LIST_BLOCK, "token", "node")
    again = _work_lists(paired.select("list_id", "token", "node", "sig", F.lit(False).alias("split")), link, cover, n)
    both = edges.union(again.where("b is not null").select("a", "b"))
    return components(both).select("node", F.col("component").alias("family"))


def link_family(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (100 * intersection >= percent * union) between the documents of one group."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posted, df = owner[order], np.bincount(code)
    end = np.cumsum(df)
    begin = end - df
    ends = np.cumsum(sizes)
    codes = [code[e - s : e] for s, e in zip(sizes, ends)]
    part = np.arange(n)
    common = np.add.reduceat(df[code], ends - sizes) / sizes
    main = int(np.argmax(common))
    found: list[tuple[int, int]] = []
    todo = [main, *np.argsort(-common, kind="stable").tolist()]
    for at, x in enumerate(todo):
        if at and part[x] == part[main]:
            continue  # pairs inside the main part are joined already; pairs that leave it are seen from outside
        c = codes[x][df[codes[x]] > 1]
        hits = np.zeros(n, np.int64)
        hits[x] = sizes[x]
        if len(c):
            counts = np.bincount(np.concatenate([posted[b:e] for b, e in zip(begin[c].tolist(), end[c].tolist())]), minlength=n)
            hits += counts
            hits[x] = sizes[x]
        near = np.flatnonzero(100 * hits >= percent * (sizes + sizes[x] - hits))
        for y in near.tolist():
            if part[y] != part[x]:
                found.append((int(ids[x]), int(ids[y])))
                part[part == part[y]] = part[x]
    return found


def links(docs: DataFrame, classes: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between classes confirmed on full sets, as a spanning forest (a, b) within each family (or pair of its blocks)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = members.groupBy("family").agg(F.count("*").alias("size"))
    dealt = _block_pairs(members.join(shuffled(sizes), "family"), "size", FAMILY_BLOCK, "family", "node")
    wanted = dealt.join(shuffled(classes.select("node", "doc", "set_key")), "node")
    rows = texts(docs).join(shuffled(wanted.select(F.col("doc").alias("doc_id"), "node", "set_key", "list_id")), "doc_id").drop("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(words)
        for table, starts in whole_groups(batches, ["list_id"], 500):
            ids = table.column("node").to_numpy()
            sets = [shingler.hashes(t) for t in table.column("text").to_pylist()]
            # a doc_id with several texts brings each of them; only the class's own counts, once
            own = [xxhash.xxh3_128_digest(h.tobytes()) == key for h, key in zip(sets, table.column("set_key").to_pylist())]
            found: list[tuple[int, int]] = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                some = list({ids[i]: i for i in range(s, e) if own[i]}.values())
                if len(some) > 1:
                    found += link_family(ids[some], [sets[i] for i in some], percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return rows.repartition(n, "list_id").sortWithinPartitions("list_id").mapInArrow(run, "a long, b long")


def linked_classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What all rows hold (doc_id, n_shingles, set_key), the classes of equal sets (set_key, node, doc: their smallest
    doc_id), the links between these (a, b), and the doc_ids of several rows (doc_id, low, high: set keys, n_sets, n)."""
    signed = as_table(signatures(docs, words), "signatures")
    some = signed.where("set_key is not null and doc_id is not null")
    classes = some.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"))
    packed = F.unhex(F.concat_ws("", F.transform("sig", lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit(0xFFFF))), 4, "0"))))
    classes = as_table(classes.withColumn("packed", packed).withColumn("node", F.monotonically_increasing_id()), "classes")
    grouped = families(classes.select("node", "sig", "packed"), percent)
    per_doc = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high"), F.count("set_key").alias("n_sets"), F.count("*").alias("n"))
    several = as_table(per_doc.where("n > 1"), "several")
    return signed.select("doc_id", "n_shingles", "set_key"), classes.select("set_key", "node", "doc"), links(docs, classes, grouped, words, percent), several


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    signed, classes, linked, several = linked_classes(docs, words, percent)
    shared = signed.join(shuffled(several.where("low <> high")), "doc_id", "left_semi").join(shuffled(classes), "set_key").select("doc_id", "node")
    through = shared.join(shuffled(shared.groupBy("doc_id").agg(F.min("node").alias("a"))), "doc_id").select("a", F.col("node").alias("b"))
    joined = components(linked.union(through)).withColumnRenamed("component", "joined")
    labelled = as_table(classes.join(shuffled(joined), "node", "left"), "components")
    smallest = labelled.where("joined is not null").groupBy("joined").agg(F.min("doc").alias("smallest"))
    of_class = labelled.join(shuffled(smallest), "joined", "left").select("set_key", F.coalesce("smallest", "doc").alias("component_id"))
    found = signed.join(shuffled(of_class), "set_key", "left")
    wordless = found.join(shuffled(several.where("n_sets between 1 and n - 1")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("of_others"))
    found = found.join(shuffled(wordless), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "of_others", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def distinct_rows(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when each group of linked sets keeps one row, that of its smallest doc_id.

    A row goes only if a row that stays holds its set or one that hangs together with it by links: of a doc_id with
    several texts each text is judged by itself. Repeated rows are one document and stay or go together. Rows without
    words or doc_id all stay.
    """
    signed, classes, linked, several = linked_classes(docs, words, percent)
    joined = components(linked).withColumnRenamed("component", "joined")
    labelled = classes.join(shuffled(joined), "node", "left").withColumn("joined", F.coalesce("joined", "node"))
    keepers = as_table(labelled.groupBy("joined").agg(F.min(F.struct("doc", "set_key")).alias("k")).select(F.col("k.doc").alias("doc_id"), F.col("k.set_key").alias("set_key")), "keepers")
    gone = signed.where("doc_id is not null and set_key is not null").join(shuffled(keepers), ["doc_id", "set_key"], "left_anti").select("doc_id").union(several.select("doc_id"))
    gone = gone.select(F.col("doc_id").alias("gone")).distinct()
    doc_id = docs["doc_id"].cast("long")
    alone = docs.join(shuffled(gone), doc_id == gone["gone"], "left_anti")
    names = several.select(F.col("doc_id").alias("gone"))
    row = docs.select(whole_row(docs), doc_id.alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).join(shuffled(names), F.col("doc_id") == names["gone"], "left_semi")
    keyed = row.withColumn("set_key", _set_key(words)("text")).drop("text")
    wordless = keyed.where("set_key is null").select("row.*")
    once = keyed.where("set_key is not null").join(shuffled(keepers), ["doc_id", "set_key"], "left_semi").select("row.*")
    return alone.union(wordless).union(once)


def _set_key(words: int) -> Callable[[str], Column]:
    """The key of a text's set of shingles as a column (null for an empty set)."""

    @F.pandas_udf("binary")
    def key(text: pd.Series) -> pd.Series:
        import xxhash

        shingler = Shingler(words)
        found = (shingler.hashes(t) for t in text)
        return pd.Series([xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in found], dtype=object)

    return key
