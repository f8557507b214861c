"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from .common import safe_chunks, texts

#: Characters from which a text is encoded in chunks cut at safe boundaries.
CHUNK_CHARS = 1 << 20


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(ranks_path: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        ranks_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def encode_text(text: str, ranks_path: str, chunk_chars: int = CHUNK_CHARS) -> list[int]:
    enc = encoding(ranks_path)
    if len(text) <= chunk_chars:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for chunk in safe_chunks(text, chunk_chars):
        ids += enc.encode_ordinary(chunk)
    return ids


def encode(docs: DataFrame, ranks_path: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; a null or empty text has no ids.

    One narrow pass without a shuffle.  Rows that repeat stay repeated; columns
    other than doc_id and text are not read.
    """
    path = ranks_path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode_text(t, path, chunk_chars) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, bytes binary): the raw bytes of each row's ids, whether valid UTF-8 or not."""
    path = ranks_path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            raw = [enc.decode_bytes(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, ranks_path: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Encode, decode and digest each whole text in one pass, so that ids never leave the task.

    Null text counts as empty: no ids.  Texts over ``chunk_chars`` are encoded in
    chunks cut where no match can span.  Repeated rows and rows without a doc_id
    stay; other columns are not read; an empty table gives no rows.
    """
    path = ranks_path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for text in b.column(1).to_pylist():
                ids = encode_text(text, path, chunk_chars)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
