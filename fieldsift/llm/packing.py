"""Lexical retrieval packing: windows are filled with the seed document's nearest unused neighbours by BM25.

Documents are tokenised and cut: whole windows of a long document become sequences of their own, its tail goes to the
pool. Pools are shards of bounded size (SHARD_BYTES of text, SHARD_ROWS documents), each with its own inverted BM25
index, built and used inside one task. A seed's best unused neighbours fill its window; the last one is cut where the
window is full and its rest becomes the next seed. Only the last window of a shard holds padding.

Every id lies in exactly one piece. Nothing is shuffled or sent to the driver; a task that runs again on another
executor writes the same rows, since shards follow the input's partitions.

Edge cases: a null or empty text is its end id alone; very long texts make shards of their own; repeated rows are packed
as often as they occur; a null doc_id is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import PATTERN, byte_characters
from .chunks import ChunkCache
from .common import block_ids, blocks, texts, tokenizer_path

WINDOW = 1024
SHARD_BYTES = 8_000_000
SHARD_ROWS = 4096
#: BM25: term saturation and length normalisation. All terms that a seed shares with another tail make its query.
K1, B = 1.2, 0.75
#: Share of a shard's tails that must hold a term for it to have a dense row.
DENSE_SHARE = 0.15

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkCache:
    """Encodes chunks with the tokenizers library; plain Latin chunks take a faster codec over the same merges.

    Below U+0250 the character classes of both libraries' patterns are the same, so the ids are, too.
    """
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    chars = {c: b for b, c in enumerate(byte_characters())}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(chars[c] for c in piece): i for piece, i in tokenizer.get_vocab(with_added_tokens=False).items() if piece not in special}
    fast = tiktoken.Encoding("same-merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(chunk: str) -> bytes:
        if max(chunk) < "\u0250" and "<|" not in chunk:
            return array("I", fast(chunk)).tobytes()
        return np.array(tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    return ChunkCache(encode)


class Bm25Shard:
    """An inverted index over the token ids of a shard's tails."""

    def __init__(self, tails: list[np.ndarray]):
        n = len(tails)
        lengths = np.array([len(t) for t in tails], np.int64)
        owner = np.repeat(np.arange(n), lengths)
        terms = np.concatenate(tails).astype(np.int64) if n else np.zeros(0, np.int64)
        keys, tf = np.unique(terms * n + owner, return_counts=True)
        term, self.doc = keys // max(n, 1), keys % max(n, 1)
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        self.bounds = np.append(first, len(keys))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(lengths.mean() if n else 1, 1))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        self.n = n
        slot = np.repeat(np.arange(len(self.terms)), df)
        # Terms of many tails have a row of all tails' weights; the others are lists.
        common = df > max(n * DENSE_SHARE, 1)
        row = np.cumsum(common) - 1
        self.rows = np.zeros((int(common.sum()), n))
        held = common[slot]
        self.rows[row[slot[held]], self.doc[held]] = self.weight[held]
        self.row_query = self._by_doc(held, row[slot])
        self.query = self._by_doc((df[slot] > 1) & ~held, slot)

    def _by_doc(self, which: np.ndarray, what: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(self.doc[which], kind="stable")
        begin = np.searchsorted(self.doc[which][order], np.arange(self.n + 1))
        found = what[which][order]
        return [found[a:b] for a, b in zip(begin[:-1], begin[1:])]

    def scores(self, seed: int) -> np.ndarray:
        out = self.rows[self.row_query[seed]].sum(axis=0)
        spans = [slice(self.bounds[s], self.bounds[s + 1]) for s in self.query[seed].tolist()]
        if spans:
            out += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        return out


def pack_shard(ids: list[np.ndarray], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of a shard."""
    sequence = 0
    begin, docs = [], []
    for d, x in enumerate(ids):
        whole = len(x) // window
        for k in range(whole):
            yield d, k * window, window, sequence, 0
            sequence += 1
        if len(x) > whole * window:
            docs.append(d)
            begin.append(whole * window)
    tails = [ids[d][s:] for d, s in zip(docs, begin)]
    index = Bm25Shard(tails)
    left = np.array([len(t) for t in tails], np.int64)
    unused = left > 0
    queue = iter(np.argsort(-left, kind="stable").tolist())  # seeds, the longest first
    seed = None
    while True:
        if seed is None:
            seed = next((x for x in queue if unused[x]), None)
            if seed is None:
                return
        unused[seed] = False
        start = begin[seed] + len(tails[seed]) - left[seed]
        yield docs[seed], int(start), int(left[seed]), sequence, 0
        filled, left[seed] = int(left[seed]), 0
        score = index.scores(seed)
        cut = None
        open_ = np.flatnonzero(unused)
        near = open_[np.lexsort((open_, -score[open_]))[: min(len(open_), 64)]] if len(open_) <= 64 else _best(open_, score[open_], 64)
        at = 0
        while filled < window and at < len(open_):
            if at >= len(near):  # sixty-four were too few: all of them in order
                near = open_[np.lexsort((open_, -score[open_]))]
            d = int(near[at])
            at += 1
            take = min(int(left[d]), window - filled)
            yield docs[d], int(begin[d] + len(tails[d]) - left[d]), take, sequence, filled
            filled += take
            left[d] -= take
            unused[d] = left[d] > 0
            if unused[d]:
                cut = d
        sequence += 1
        seed = cut


def _best(which: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    part = np.argpartition(-score, k)[:k]
    return which[part[np.lexsort((which[part], -score[part]))]]


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS, end_id: int = 0) -> DataFrame:
    """One row per piece; sequence_id is unique in the result and offset counts from 0 without gaps."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        names = [x.split()[0] for x in PIECES.split(", ")]
        for shard, block in zip(block_ids(), blocks(batches, "text", shard_bytes, shard_rows)):
            raw = [encode.ids(t) + end for t in block.column("text").to_pylist()]
            ids = [np.frombuffer(x, "<u4") for x in raw]
            doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pack_shard(ids, window)))
            crc = [zlib.crc32(raw[d][4 * s : 4 * (s + n)]) for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            sizes = np.array([len(x) for x in ids], np.int64)
            # A shard makes fewer sequences than its texts have bytes; ids are unique through the shard's own range.
            values = [start, length, np.array(crc, np.int64), sizes[doc], None, offset]
            values[4] = sequence + _first_sequence(shard)
            doc_ids = block.column("doc_id").combine_chunks().take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, values)], names)

    return texts(docs).mapInArrow(run, PIECES)


def _first_sequence(shard: int) -> int:
    """Shard ids are partition << 32 | shard; sequences get 24 bits below 15 bits of shard and 24 of partition."""
    partition, local = shard >> 32, shard & 0xFFFFFFFF
    return (partition << 39) | (local << 24)
