"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: a sentencepiece BPE model is serialised directly from the vocabulary: every piece in the
byte-to-character mapping, scored by its negative rank, with identity normalisation. Texts are cut
into pre-tokens, distinct pre-tokens are encoded by the library, and ids decode by the inverse
mapping. The model is about 1 MB whatever the corpus; encoding is a narrow pass.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from quarrymill.session import tokenizer_folder

CACHE_ENTRIES = 1 << 18
# Fixed value: the pre-token pattern that belongs to the vocabulary.
PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(1)
def byte_characters() -> list[str]:
    """One visible character per byte: printable Latin-1 as itself, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in visible:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def read_ranks(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> list[bytes]:
    """The byte strings of the vocabulary by id."""
    with open(os.path.join(folder or tokenizer_folder(), name), "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(piece)) for piece, rank in (line.split() for line in lines if line.strip()))
    assert [r for r, _ in pairs] == list(range(len(pairs)))
    return [piece for _, piece in pairs]


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, payload: bytes | int | float) -> bytes:
    """One field in protocol buffer wire format."""
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + struct.pack("<f", payload)
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def serialise_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece model whose ids are the ranks; the unknown piece, never used, comes last."""
    chars = byte_characters()
    out = bytearray()
    for rank, piece in enumerate(pieces):
        text = "".join(chars[b] for b in piece).encode()
        out += _field(1, _field(1, text) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    out += _field(2, _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Encoder:
    """Text to ids and back. Strings of special tokens are ordinary text."""

    def __init__(self, model: bytes) -> None:
        self.processor = sentencepiece.SentencePieceProcessor()
        self.processor.LoadFromSerializedProto(model)
        self.pattern = regex.compile(PRE_TOKENS)
        self.characters = byte_characters()
        self.cache: dict[str, np.ndarray] = {}
        self.pieces: list[bytes] = []

    def _mapped(self, token: str) -> str:
        return token.encode("utf-8", "surrogatepass").decode("latin-1").translate(_TRANSLATE)

    def _learn(self, tokens: Iterable[str]) -> None:
        new = [t for t in tokens if t not in self.cache]
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache.clear()
        if new:
            for token, ids in zip(new, self.processor.encode([self._mapped(t) for t in new], num_threads=1), strict=True):
                self.cache[token] = np.array(ids, np.int32)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Null and empty texts have the empty list."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        out = []
        step = 256
        for start in range(0, len(split), step):
            part = split[start : start + step]
            wanted = set().union(*part) if part else set()
            missing = [t for t in wanted if t not in self.cache]
            if missing:
                if len(self.cache) + len(missing) > CACHE_ENTRIES:
                    self.cache.clear()
                    missing = list(wanted)
                self._learn(missing)
            known = self.cache
            for tokens in part:
                out.append(np.concatenate([known[t] for t in tokens]) if tokens else np.zeros(0, np.int32))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids by the inverse mapping of pieces to bytes."""
        if not self.pieces:
            back = {c: b for b, c in enumerate(self.characters)}
            self.pieces = [bytes(back[c] for c in self.processor.id_to_piece(i)) for i in range(self.processor.get_piece_size() - 1)]
        return b"".join([self.pieces[i] for i in ids]).decode("utf-8", "replace")


_TRANSLATE = {b: c for b, c in enumerate(byte_characters())}


def encode_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", model: bytes | None = None, counts: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, ids`` of every row (``doc_id, tokens`` with ``counts``); null and empty texts have no ids.

    ``carry``: string columns passed through behind the others.

    Whole texts of any length; extra columns are ignored; repeated rows give repeated results.
    """
    model = model or serialise_model(read_ranks())
    shared = df.sparkSession.sparkContext.broadcast(model)
    holder: dict[str, Encoder] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "encoder" not in holder:
            holder["encoder"] = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = holder["encoder"].encode_batch(part.column(1).to_pylist())
                sizes = np.array([len(x) for x in found], np.int64)
                if counts:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), *part.columns[2:]], [key, "tokens", *carry])
                    continue
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                flat = np.concatenate(found) if found else np.zeros(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, *part.columns[2:]], [key, "ids", *carry])

    schema = ", ".join([f"`{key}` long", "tokens long" if counts else "ids array<int>", *[f"`{c}` string" for c in carry]])
    wanted = [f"cast(`{key}` as long) `{key}`", f"cast(`{text}` as string) `{text}`", *[f"cast(`{c}` as string) `{c}`" for c in carry]]
    return df.selectExpr(*wanted).mapInArrow(run, schema)


def decode_documents(df: DataFrame, key: str = "doc_id", ids: str = "ids", model: bytes | None = None) -> DataFrame:
    """``doc_id, text`` of documents given by their ids; no ids give the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(model or serialise_model(read_ranks()))
    holder: dict[str, Encoder] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "encoder" not in holder:
            holder["encoder"] = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [holder["encoder"].decode(x or ()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.selectExpr(f"cast(`{key}` as long) `{key}`", f"`{ids}`").mapInArrow(run, f"`{key}` long, text string")
