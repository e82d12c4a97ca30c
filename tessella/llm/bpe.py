"""Byte-level BPE on a sentencepiece model that is serialised from a rank file.

The model is built, not trained: every vocabulary entry becomes a piece whose
bytes are mapped one-to-one to printable characters, with score ``-rank``, under
an identity normaliser.  A sentencepiece BPE encoder merges the adjacent pair
with the best score first and the leftmost among equals, which is the rank order.
Decoding maps ids to pieces and pieces to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import trimmed

#: Distinct pre-tokens that a worker remembers before it starts afresh.
MEMO = 200_000
#: Pre-tokens of more bytes than this are encoded but not remembered.
MEMO_BYTES = 64


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes | int) -> bytes:
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the unknown piece comes last.

    Ranks that the file leaves out become unused pieces, so that ids stay ranks.
    """
    alphabet = byte_alphabet()
    by_rank = {r: t for t, r in ranks.items()}
    size = max(by_rank, default=-1) + 1
    out = []
    for rank in range(size):
        token = by_rank.get(rank)
        kind = 1 if token else 5
        text = "".join(alphabet[b] for b in token) if token else f"�{rank}"
        out.append(_field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, kind)))
    out.append(_field(1, _field(1, b"\xef\xbf\xbd") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2)))
    # trainer: model_type BPE, vocabulary size, unk id, no bos, eos or pad
    none = (1 << 64) - 1
    out.append(_field(2, _field(3, 2) + _field(4, size + 1) + _field(40, size) + _field(41, none) + _field(42, none) + _field(43, none)))
    # normaliser: identity, no dummy prefix, white space kept as it is
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Encoder and decoder of one vocabulary; cheap to make once per worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model or serialize_model(ranks))
        self.alphabet = byte_alphabet()
        inverse = {c: b for b, c in enumerate(self.alphabet)}
        unk = self.model.unk_id()
        self.bytes_of = [bytes(inverse[c] for c in self.model.id_to_piece(i)) if i != unk and not self.model.is_unused(i) else b"" for i in range(self.model.get_piece_size())]
        self.memo = _Memo(self)

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-token, packed as little-endian unsigned 32-bit integers."""
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)  # a vocabulary entry is one token even if no merge leads to it
        if whole is not None:
            return struct.pack("<I", whole)
        ids = self.model.encode("".join(map(self.alphabet.__getitem__, raw)))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class _Memo(dict):
    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        out = self.codec.encode_piece(piece)
        if len(piece) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = out
        return out


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every whole text, decode the ids again, and digest both.

    Returns key, n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``, ids (array of int).
    A null text counts as empty: 0 tokens and the digests of no bytes.  Repeated
    rows are encoded each; other columns of ``docs``, whatever their names, are ignored.
    Whole texts are encoded however long; a task holds some hundred of them at a time.
    The vocabulary file (under a few MB) is read on the driver and broadcast.
    """
    ranks = load_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, serialize_model(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        codec = Codec(vocab, pattern, model)
        for batch in batches:
            cols = ([], [], [], [])
            for value in batch.column(1):
                packed = codec.encode(value.as_py() or "")
                cols[0].append(len(packed) // 4)
                cols[1].append(hashlib.sha256(packed).hexdigest())
                cols[2].append(hashlib.sha256(codec.decode(packed)).hexdigest())
                if with_ids:
                    cols[3].append(np.frombuffer(packed, "<i4"))
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(cols[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(trimmed(run), schema).withColumnRenamed("key", key)
