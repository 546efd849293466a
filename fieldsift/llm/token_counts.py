"""Token counts without token ids: pieces are counted once per distinct pre-token.

Three steps, two shuffles of compact rows:

1. Each task cuts its texts into pre-tokens, in blocks of bounded size. A block sends each range of pre-tokens (by hash)
   its distinct ones with the frequencies of the block's documents, sorted and compressed.
2. Per range, the blocks' lists meet: each distinct pre-token is counted once and joined to the frequencies of every
   block. A frequent pre-token comes once per block, not once per document.
3. Frequency times pieces, summed per document, returns to the block and is added up over the ranges.

Edge cases: a null or empty text has no tokens; very long texts make blocks of their own; repeated rows give repeated
result rows; a null doc_id is kept; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_ids, blocks, texts, tokenizer_path

_RUNS = re.compile("▁+[^▁]*")


@functools.lru_cache(maxsize=2)
def piece_model(path: str):
    """The model without its dummy prefix: pre-tokens carry their own word mark."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    joined = [p.piece for p in model.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL and (re.search("[^▁]▁", p.piece) or "\n" in p.piece)]
    spec = model.normalizer_spec
    if joined or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("this model has pieces that cross pre-tokens, or rewrites its input; count whole texts instead")
    spec.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens between which no piece of the model can reach: each begins at a word mark or after a line end.

    Line ends are pre-tokens of their own, joined into one per run of text between spaces.
    """
    if not text:
        return []
    marked = "▁" + text.replace(" ", "▁")
    parts = _RUNS.findall(marked) if "▁▁" in marked else ["▁" + x for x in marked[1:].split("▁")]
    if "\n" not in marked:
        return parts
    out = []
    for part in parts:
        if "\n" in part:
            lines = part.split("\n")
            out += [x for x in lines if x]
            out += ["\n"] * (len(lines) - 1)
        else:
            out.append(part)
    return out


#: A range of pre-tokens for about so many bytes of text, so that a range's lists keep their size as the input grows.
RANGE_BYTES = 64_000_000

LISTS = "r long, block_id long, pieces binary, counts binary, ordinals binary, frequencies binary"
SUMS = "block_id long, listed boolean, ordinals binary, weights binary"


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 3)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def frequencies(docs: DataFrame, n_ranges: int, block_bytes: int = 12_000_000, block_rows: int = 8192) -> DataFrame:
    """Per block and range of pre-tokens: the distinct ones with their documents' frequencies (LISTS).

    One more row per block (pieces null) lists its doc_ids and byte counts; a null doc_id with the complement, -1 - n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in LISTS.split(", ")]
        for block_id, block in zip(block_ids(), blocks(batches, "text", block_bytes, block_rows)):
            tokens, counts = [], []
            for text in block.column("text").to_pylist():
                found = pre_tokens(text)
                tokens += found
                counts.append(len(found))
            n = len(counts)
            n_bytes = pc.binary_length(block.column("text")).to_numpy().astype("<i8")
            unnamed = pc.is_null(block.column("doc_id")).to_numpy()
            doc_ids = pc.fill_null(block.column("doc_id"), 0).to_numpy().astype("<i8")
            rows = [(block_id % n_ranges, block_id, None, None, _packed(doc_ids), _packed(np.where(unnamed, -1 - n_bytes, n_bytes).astype("<i8")))]
            if tokens:
                coded = pa.array(tokens, pa.string()).dictionary_encode()
                codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
                ranges = np.array([zlib.crc32(x.encode()) for x in distinct], np.int64) * n_ranges >> 32
                order = np.array(sorted(range(len(distinct)), key=distinct.__getitem__))
                order = order[np.argsort(ranges[order], kind="stable")]
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                pairs, freq = np.unique(place[codes] * n + np.repeat(np.arange(n), counts), return_counts=True)
                per = np.bincount(pairs // n, minlength=len(order))
                upto = np.append(0, np.cumsum(per))
                cuts = np.append(np.flatnonzero(np.append(True, np.diff(ranges[order]) > 0)), len(order)).tolist()
                for a, b in zip(cuts, cuts[1:]):
                    some = slice(upto[a], upto[b])
                    text = " ".join(distinct[k] for k in order[a:b].tolist())  # pre-tokens hold no spaces
                    rows.append((int(ranges[order[a]]), block_id, zstandard.compress(text.encode(), 3), _packed(per[a:b].astype("<u4")), _packed((pairs[some] % n).astype("<u2")), _packed(freq[some].astype("<u4"))))
            for a in range(0, len(rows), 500):
                kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 500]), kinds)], names)

    return texts(docs).mapInArrow(run, LISTS)


def count_pieces(lists: DataFrame, path: str) -> DataFrame:
    """Joins the lists of each range to the number of pieces of its pre-tokens, each counted once (SUMS)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        model = piece_model(path)
        known: dict[str, int] = {}
        out = []
        for block_id, pieces, counts, ordinals, freq in rows[["block_id", "pieces", "counts", "ordinals", "frequencies"]].itertuples(index=False, name=None):
            if pieces is None:
                out.append((block_id, True, ordinals, freq))
                continue
            found = zstandard.decompress(pieces).decode().split(" ")
            new = [x for x in found if x not in known]
            known.update(zip(new, map(len, model.encode(new, num_threads=1) if new else [])))
            each = np.repeat(np.fromiter(map(known.__getitem__, found), np.int64, len(found)), _unpacked(counts, "<u4"))
            doc, where = np.unique(_unpacked(ordinals, "<u2"), return_inverse=True)
            weights = np.bincount(where, each * _unpacked(freq, "<u4").astype(np.int64)).astype("<i8")
            out.append((block_id, False, _packed(doc), _packed(weights)))
        return pd.DataFrame(out, columns=["block_id", "listed", "ordinals", "weights"])

    return lists.groupBy("r").applyInPandas(run, SUMS)


def _sum_block(rows: pd.DataFrame) -> pd.DataFrame:
    head = rows[rows["listed"]].iloc[0]
    doc_ids, n_bytes = _unpacked(head["ordinals"], "<i8"), _unpacked(head["weights"], "<i8")
    total = np.zeros(len(doc_ids), np.int64)
    for ordinals, weights in rows.loc[~rows["listed"], ["ordinals", "weights"]].itertuples(index=False, name=None):
        total[_unpacked(ordinals, "<u2")] += _unpacked(weights, "<i8")
    named = pd.array(doc_ids.copy(), "Int64")
    named[n_bytes < 0] = pd.NA
    return pd.DataFrame({"doc_id": named, "n_bytes": np.where(n_bytes < 0, -1 - n_bytes, n_bytes), "n_tokens": total})


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs."""
    size = texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
    counted = count_pieces(frequencies(docs, n), path or tokenizer_path("piece_bpe_32k.model"))
    summed = counted.groupBy("block_id").applyInPandas(_sum_block, "doc_id long, n_bytes long, n_tokens long")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)
