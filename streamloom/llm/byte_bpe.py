"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries first. A long run of white space, at which the library's regex would run out of stack, is a
single match of the split pattern: it is cut out and its bytes are merged without the regex. A long run of any other kind goes to
the regex as it is, which takes time in proportion. Decoding gives raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from streamloom.llm.common import id_and_text, in_batches, is_white, per_batch, read, safe_pieces, sliced

PIECE_CHARS = 65_536


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str):
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, rank_path: str, pattern: str) -> list[int]:
    """The ids of a whole text, special strings as ordinary text."""
    own = encoding(rank_path, pattern)
    if len(text) <= PIECE_CHARS:
        return own.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text, PIECE_CHARS):
        ids += own._encode_single_piece(piece) if len(piece) > PIECE_CHARS and is_white(piece) else own.encode_ordinary(piece)
    return ids


def decode(ids: list[int], rank_path: str, pattern: str) -> bytes:
    return encoding(rank_path, pattern).decode_bytes(ids)


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of long) of every row; a null or empty text has no ids."""
    return per_batch(id_and_text(docs, id_col, text_col), lambda texts: {"ids": [encode(t, rank_path, pattern) for t in texts]}, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: ids are digested where they are made."""

    def compute(texts: list[str]) -> dict:
        ids = [encode(t, rank_path, pattern) for t in texts]
        return {
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(decode(x, rank_path, pattern)).hexdigest() for x in ids],
        }

    return per_batch(id_and_text(docs, id_col, text_col), compute, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """round_trip with the ids themselves: doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""

    def run(batches):
        for batch in batches:
            for part in sliced(batch, 4_000_000):
                ids = [np.array(encode(t, rank_path, pattern), "<u4") for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                digest = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
                back = [hashlib.sha256(decode(x.tolist(), rank_path, pattern)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(digest), pa.array(back)], names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return in_batches(id_and_text(docs, id_col, text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
