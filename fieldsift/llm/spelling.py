"""Spelling variants: words of the corpus one edit apart, grouped under their most frequent forms.

1. Words are counted per task and then summed, so a word that makes a third of all text is one row per task.
2. Pairs come from the composition of the vocabulary's minimal acceptor with a one-edit transducer and the acceptor
   again (acceptors.py). The composed machine is enumerated by partitions of its initial states: all pairs that share
   their first HEAD code points leave from the state behind that head, so the words of a head make an acceptor of their
   own; pairs that differ within the head share their last code points (words have twice HEAD at least) and are found by
   the same machine over reversed words.
3. A head that more than GROUP_WORDS words share is split: behind it both words read one more code point alike (a longer
   head), or the edit falls right there and what follows is equal (a group of one word per code point). Nothing is
   dropped and no group grows with the vocabulary.
4. A word's form is its best near word; forms grow at least fivefold a step, so few rounds of pointer doubling reach the
   root.

Edge cases: null and empty texts hold no words; a null doc_id is written as an empty one where runs are altered; repeated
rows count again; other columns are ignored whatever their names; an empty table gives no words; runs of any length are
taken whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .acceptors import Acceptor
from .common import as_table, blocks, drop_table, texts

HEAD = 3
GROUP_WORDS = 16_384
#: Words of one task's counter before it is handed on.
HELD_WORDS = 200_000

PAIRED = "word string, n_near long, best_n long, best string"


def count_words(docs: DataFrame, least_length: int = 6, alter_every: int = 199) -> DataFrame:
    """word, n: runs of letters of whole texts, A-Z lower-cased; a run whose checksum alter_every divides loses a letter."""
    pattern = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for block in blocks(batches, "text", 8_000_000, 4096):
            for doc_id, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist()):
                seed = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for word, n in Counter(pattern.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % alter_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield flush()
        if held:
            yield flush()

    return texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _head(word: str | Column, length: int) -> Column:
    return F.substring(word, 1, length)


def partitions(words: DataFrame, head: int = HEAD, group_words: int = GROUP_WORDS) -> DataFrame:
    """kind, key, word, n: words posted to the initial states that their pairs leave from, at most group_words to one.

    kind f: words by a head; kind b: reversed words by a head; kind e: words that are equal but for their first code point
    behind a head (ahead: how many code points that is), with the same for reversed words as kind r.
    """
    spark = words.sparkSession
    none = F.lit(head).cast("int").alias("ahead")
    posted = words.select(F.lit("f").alias("kind"), _head("word", head).alias("key"), none, "word", "n").union(
        words.select(F.lit("b"), _head(F.reverse("word"), head), none, F.reverse("word"), "n")
    )
    done: DataFrame | None = None
    while True:
        sizes = as_table(posted.groupBy("kind", "key").agg(F.count("*").alias("size")).where(F.col("size") > group_words).select("kind", "key"), "heads")
        if sizes.isEmpty():
            return posted if done is None else done.union(posted)
        hot = as_table(posted.join(sizes, ["kind", "key"], "left_semi").select(*posted.columns), "hot")
        cold = posted.join(sizes, ["kind", "key"], "left_anti").select(*posted.columns)
        after = F.lit("\0")
        exact = hot.select(
            F.when(F.col("kind") == "f", "e").otherwise("r").alias("kind"),
            F.explode(
                F.array(
                    F.concat("key", after, F.expr("substring(word, ahead + 1)")),
                    F.when(F.length("word") > F.col("ahead"), F.concat("key", after, F.expr("substring(word, ahead + 2)"))),
                )
            ).alias("key"),
            "ahead",
            "word",
            "n",
        ).where("key is not null")
        cold = cold.union(exact)
        done = cold if done is None else done.union(cold)
        longer = hot.where(F.length("word") > F.col("ahead")).select("kind", F.expr("substring(word, 1, ahead + 1)").alias("key"), (F.col("ahead") + 1).alias("ahead"), "word", "n")
        posted = as_table(longer, "posted")


def _pairs(kind: str, ahead: int, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the group's pairs. Pairs of reversed words that also share their real head belong to that head's group."""
    if kind in "er":  # all pairs are one edit apart; alike next code points are met behind the longer head
        n = len(words)
        nexts = [w[ahead : ahead + 1] for w in words]
        found = [(i, j) for i in range(n) for j in range(i) if nexts[i] != nexts[j]]
        pairs = iter([tuple(np.array(x) for x in zip(*found))] if found else [])
    else:
        pairs = Acceptor([w[ahead:] for w in words]).one_edit_pairs()
    if kind in "fe":
        yield from pairs
        return
    codes: dict[str, int] = {}
    head = np.array([codes.setdefault(w[-HEAD:], len(codes)) for w in words])
    for left, right in pairs:
        apart = head[left] != head[right]
        yield left[apart], right[apart]


def near_words(posted: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: of each word and partition the near words' number and the best one (largest n, then code-point order)."""
    n_parts = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("kind", "key", "ahead", "word", "n")))

        out: list[list] = [[], [], [], []]
        for (kind, _, ahead), group in groupby(rows(), key=lambda r: r[:3]):
            words, ns = zip(*(r[3:] for r in group))
            if len(words) < 2:
                continue
            real = [w[::-1] for w in words] if kind in "br" else list(words)
            order = sorted(range(len(words)), key=lambda i: (-ns[i], real[i]))
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
            for left, right in _pairs(kind, ahead, list(words)):
                for x, y in ((left, right), (right, left)):
                    near += np.bincount(x, minlength=len(words))
                    np.minimum.at(best, x, place[y])
            for i in np.flatnonzero(near).tolist():
                b = order[best[i]]
                for held, value in zip(out, (real[i], int(near[i]), ns[b], real[b])):
                    held.append(value)
            if len(out[0]) > 20_000:
                yield _batch(out)
                out = [[], [], [], []]
        if out[0]:
            yield _batch(out)

    dealt = posted.repartition(n_parts, "kind", "key").sortWithinPartitions("kind", "key", "word")
    return dealt.select("kind", "key", "ahead", "word", "n").mapInArrow(run, PAIRED)


def _batch(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])


def variants(words: DataFrame, ratio: int = 5, least_n: int = 5, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of words (word of six code points or more, distinct; n >= least_n)."""
    words = as_table(words, "words")
    near = near_words(partitions(words, group_words=group_words)).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("best"))).alias("best")
    )
    has_form = F.col("best.minus_n") <= -ratio * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has_form, F.col("best.best")).alias("form"), F.when(has_form, -F.col("best.minus_n")).alias("form_n")
    )
    formed = as_table(formed, "forms")
    most = formed.agg(F.max("form_n")).first()[0]
    links = formed.where("form is not null").select("word", F.col("form").alias("root"))
    steps = math.ceil(math.log(max(most, 2) / least_n, ratio)) + 1 if most else 0  # a chain of n, ratio n, ... up to the most
    for _ in range(max(0, math.ceil(math.log2(steps))) if steps > 1 else 0):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = as_table(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        drop_table(links)
        links = nxt
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs (doc_id, text) with least_length code points and least_n occurrences."""
    return variants(count_words(docs, least_length).where(F.col("n") >= least_n), ratio, least_n)
