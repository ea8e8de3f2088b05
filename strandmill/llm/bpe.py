"""Byte-level BPE by a sentencepiece model that is written directly from a rank file.

Each byte is mapped to one code point, each entry of the vocabulary to a piece of such code points, scored by
its negative rank: sentencepiece then merges, as the rank file asks, the neighbours of the lowest rank first.
The model neither normalises nor treats white space in any way.  Texts are cut into pre-tokens by the public
pattern first; a pre-token that is itself in the vocabulary is that id.  Decoding maps ids to their pieces
and these back to bytes.

Null text counts as empty: no ids, no bytes.  Repeated rows give repeated results, an empty table none.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from strandmill.llm.common import id_text, rows, tune
from strandmill.llm.pretokens import Words, chunks, pre_tokens

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Byte b is the code point BASE + b: letters without case pairs or decompositions matter not, as nothing is normalised.
BASE = 0x4E00
BYTE_TO_CHAR = {b: BASE + b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protobuf field: varint, 32-bit float or bytes, by the value's type."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def _piece(text: str, score: float, kind: int) -> bytes:
    return _field(1, _field(1, text.encode()) + _field(2, score) + _field(3, kind))


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a rank file; ids are ranks, the unknown piece follows them."""
    table = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in table] != list(range(len(table))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without an entry: {missing}")
    pieces = [_piece("".join(chr(BASE + b) for b in token), -float(rank), 1) for token, rank in table]  # 1: normal
    pieces.append(_piece("<unk>", 0.0, 2))  # 2: unknown
    n = len(table)
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))  # BPE; size; unk_id; no bos, eos, pad
    normalizer = _field(1, b"identity") + _field(2, b"") + b"".join(_field(k, 0) for k in (3, 4, 5))  # no prefix, nothing removed, nothing escaped
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.table = [bytes(ord(c) - BASE for c in self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.packed = Words(self._pack)

    def _words(self, pre_tokens: list[str]) -> dict[str, list[int]]:
        out, split = {}, []
        for w in pre_tokens:
            raw = w.encode()
            if (whole := self.ranks.get(raw)) is not None:
                out[w] = [whole]
            else:
                split.append((w, raw.decode("latin-1").translate(BYTE_TO_CHAR)))
        if split:
            out.update(zip([w for w, _ in split], self.model.encode([x for _, x in split], num_threads=1), strict=True))
        return out

    def _pack(self, chunks: list[str]) -> list[bytes]:
        found = list(map(pre_tokens, chunks))
        ids = self._words(list(set().union(*found)))
        flat = [[i for w in f for i in ids[w]] for f in found]
        return [struct.pack(f"<{len(x)}I", *x) for x in flat]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = list(map(chunks, texts))
        self.packed.of(parts)
        return [b"".join(map(self.packed.__getitem__, p)) for p in parts]

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed([text])[0]).cast("I").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (packed, see Codec.encode_packed)."""
    path = path or public_tokenizers.path(VOCABULARY)
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in rows(batches):
            yield pa.record_batch([b.column(0), pa.array(c.encode_packed(b.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, text (binary) of what ``encode`` returns."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in rows(batches):
            texts = [c.decode(memoryview(x or b"").cast("I").tolist()) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and decoded again, in one pass."""
    path = path or public_tokenizers.path(VOCABULARY)
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in rows(batches):
            out = []
            for ids in c.encode_packed(b.column(1).to_pylist()):
                back = c.decode(memoryview(ids).cast("I").tolist())
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            n, a, d = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
