"""Byte-level BPE through a sentencepiece model that is serialised from the vocabulary.

Each byte is mapped to one printable character, each vocabulary entry becomes a piece of the model with the negative
rank as its score, and normalisation is the identity: sentencepiece then merges in rank order. Pre-tokens are encoded
one by one; decoding maps ids back to bytes.

Edge cases: a null or empty text has no ids and decodes to no bytes; very long pre-tokens are encoded whole; repeated
rows give repeated result rows; a null doc_id is kept as null; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame

from .chunks import ChunkCache
from .common import blocks, texts, tokenizer_path


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is visible, else the next one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's byte strings in rank order."""
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, f))
    return [piece for _, piece in ranked]


def serialise_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes after them."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_characters()
    model = pb.ModelProto()
    for rank, piece in enumerate(vocabulary):
        model.pieces.add(piece="".join(chars[b] for b in piece), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size = pb.TrainerSpec.BPE, len(vocabulary) + 1
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(vocabulary), -1, -1, -1
    norm = model.normalizer_spec
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class ByteBpe:
    """Encodes and decodes whole texts; one per Python worker."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.vocabulary = read_ranks(path)
        self.rank_of = {piece: rank for rank, piece in enumerate(self.vocabulary)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.vocabulary))
        self.find = regex.compile(pattern).findall
        self.table = {i: c for i, c in enumerate(byte_characters())}
        self.cache = ChunkCache(self.encode_chunk)

    def encode_chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for token in self.find(chunk):
            data = token.encode()
            rank = self.rank_of.get(data)
            if rank is not None:
                ids.append(rank)
            else:
                ids += self.model.encode(data.decode("latin-1").translate(self.table))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.cache.ids(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids of its whole text, as a binary column of little-endian unsigned 32-bit integers."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for block in blocks(batches, "text", 4_000_000, 2048):
            ids = [bpe.encode(t) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks(), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The inverse: doc_id, ids and the decoded bytes."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for block in blocks(batches, "ids", 4_000_000, 2048):
            held = block.combine_chunks()
            out = pa.array([bpe.decode(x or b"") for x in held.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(held.column(c).combine_chunks() for c in ("doc_id", "ids")), out], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
