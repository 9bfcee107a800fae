"""Byte-level BPE encoding and decoding by a sentencepiece model that is serialised from a rank file.

Each byte becomes one character (code point 256 + byte). Every rank is a piece whose score is its negative rank, the
normaliser is the identity; no model is trained. Text is split by the pre-token pattern, each pre-token is encoded
by itself, and ids are decoded by the inverse mapping. Merging the best-scored neighbour pair first is what the ranks ask for.

Null and empty texts give no ids. Very long texts pass in one piece. Repeated rows and null ids each give their own row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from lotline.llm.common import portions, texts

SHIFT = 256
#: Pre-tokens in a generation of those that a Python worker remembers.
REMEMBERED = 100_000
#: Characters of the longest one that is remembered.
LONGEST = 100

_codecs: dict[tuple[str, str], Codec] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, integers and 32-bit floats."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def mapped(data: bytes) -> str:
    """One character for each byte."""
    return (np.frombuffer(data, np.uint8).astype("<u2") + SHIFT).tobytes().decode("utf-16-le")


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece i is the token of rank i, an unknown piece stands behind the last."""
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[token] for token in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without holes")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing}")
    pieces = [_field(1, mapped(t).encode()) + _field(2, float(-r)) + _field(3, 1) for r, t in enumerate(order)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces))
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """One per worker and vocabulary. What pre-tokens encode to is remembered as packed 32-bit ids in two generations: those met lately,
    and those met before; a full generation pushes out the older one."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.token = sorted(self.ranks, key=self.ranks.__getitem__)
        self.split = regex.compile(pattern).findall
        self.remembered = remembered
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.digits = [str(i).encode() for i in range(len(self.token))]

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in _codecs:
            _codecs[path, pattern] = cls(path, pattern)
        return _codecs[path, pattern]

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct pre-tokens; one that is a token itself keeps its own id."""
        raw = [p.encode() for p in parts]
        whole, ends = mapped(b"".join(raw)), list(accumulate(map(len, raw)))
        unknown = [k for k, b in enumerate(raw) if b not in self.ranks]
        found = dict(zip(unknown, self.model.encode([whole[ends[k] - len(raw[k]) : ends[k]] for k in unknown]), strict=True))
        return {p: array("I", found[k] if k in found else (self.ranks[raw[k]],)).tobytes() for k, p in enumerate(parts)}

    def encode(self, values: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        parts = [self.split(v) for v in values]
        met = set(chain.from_iterable(parts))
        known = {p: self.recent[p] for p in met if p in self.recent}
        fresh = {p: self.older[p] for p in met if p not in known and p in self.older}
        if missing := [p for p in met if p not in known and p not in fresh]:
            learned = self.learn(missing)
            known.update(learned)
            fresh.update((p, v) for p, v in learned.items() if len(p) <= LONGEST)
        known.update(fresh)
        self.recent.update(fresh)
        if len(self.recent) > self.remembered:
            self.older, self.recent = self.recent if len(self.recent) < 2 * self.remembered else {}, {}
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, digests: bool = False) -> DataFrame:
    """doc_id, ids and the bytes decoded from them; with ``digests`` their number and SHA-256 instead.

    Rows are independent: one pass over the input, no shuffle. A digest is of the decimal ids joined by commas, or of the bytes.
    """
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded binary"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            for part in portions(batch):
                packed = codec.encode(part.column(1).to_pylist())
                sizes = np.array([len(x) // 4 for x in packed], np.int64)
                if digests:
                    listed, back = [], []
                    for x in packed:
                        ids = memoryview(x).cast("I").tolist()
                        listed.append(hashlib.sha256(b",".join(map(codec.digits.__getitem__, ids))).hexdigest())
                        back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    rest = [pa.array(sizes), pa.array(listed, pa.string()), pa.array(back, pa.string())]
                else:
                    ids = pa.array(np.frombuffer(b"".join(packed), np.int32))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), ids)
                    rest = [lists, pa.array([codec.decode(memoryview(x).cast("I").tolist()) for x in packed], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *rest], names)

    return texts(docs).mapInArrow(run, schema)
