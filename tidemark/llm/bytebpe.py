"""Byte-level BPE encoding and decoding of whole texts, in Arrow batches.

The tokenizer file's table maps each byte to a printable character; token strings are written in
these characters. Decoding reverses that table. A character may be split over tokens: its bytes are
joined again before the text is decoded, and each of its tokens carries the offsets of the whole
character.

Nulls are empty texts without tokens. Repeated rows give repeated results. Columns other than
`doc_id` and `text` are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import wordcodes
from tidemark.llm.arrays import slices


def byte_characters() -> list[str]:
    """Character that stands for each byte: printable Latin-1 stays, the rest follow from U+0100 on."""
    stays = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, moved = [], 0
    for b in range(256):
        out.append(chr(b) if b in stays else chr(0x100 + moved))
        moved += b not in stays
    return out


_TABLES: dict[str, tuple[list[bytes], np.ndarray]] = {}


def token_bytes(path: str) -> tuple[list[bytes], np.ndarray]:
    """(bytes of each id, their lengths) from a tokenizer file, by the reversed byte table."""
    if path not in _TABLES:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = spec["model"]["vocab"]
        special = {t["id"]: t["content"] for t in spec.get("added_tokens", ())}
        table = [b""] * (1 + max([*vocab.values(), *special], default=-1))
        for token, i in vocab.items():
            table[i] = special[i].encode() if i in special else bytes(map(back.__getitem__, token))
        _TABLES[path] = table, np.array([len(t) for t in table], np.int64)
    return _TABLES[path]


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """Bytes of a sequence of ids."""
    table, _ = token_bytes(path)
    return b"".join(map(table.__getitem__, ids.tolist()))


def token_offsets(ids: np.ndarray, text: bytes, path: str) -> np.ndarray:
    """(start, end) in code points for each id; a token inside a character gets all of it."""
    _, lengths = token_bytes(path)
    if not len(ids):
        return np.zeros((0, 2), np.int32)
    end = np.cumsum(lengths[ids])
    start = end - lengths[ids]
    raw = np.frombuffer(text, np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    return np.stack([character[start], character[end - 1] + 1], axis=1).astype(np.int32)


ENCODED = "doc_id long, n_tokens long, ids binary, offsets binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str, offsets: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (little-endian unsigned 32-bit) and offsets (start and end of each
    token in code points, little-endian signed 32-bit; null without `offsets`)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = wordcodes.load(path, True)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = wordcodes.spaced(texts, tokenizer)
            at = None
            if offsets:
                at = [token_offsets(np.frombuffer(i, "<u4"), t.encode(), path).tobytes() for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(at or [None] * len(ids), pa.binary())],
                ["doc_id", "n_tokens", "ids", "offsets"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and bytes of each row's ids; cast to string where the ids are those of a whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode_ids(np.frombuffer(i or b"", "<u4"), path) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.selectExpr("doc_id", "ids").mapInArrow(work, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the ids and of what they decode to. Encodes and decodes in
    one pass, so that no ids leave the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = wordcodes.load(path, True)
        for batch in slices(batches):
            ids = wordcodes.spaced([t or "" for t in batch.column(1).to_pylist()], tokenizer)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(decode_ids(np.frombuffer(i, "<u4"), path)).hexdigest() for i in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, DIGESTS)
