"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before a space that stands between two characters that are no white space;
the split pattern never matches across such a place, so the ids are those of the whole text.
Decoding joins the raw bytes of the ids, whether or not they are valid UTF-8.

Cases: a null text counts as empty (no ids); repeated rows give repeated results; a text
without a safe boundary is encoded in one piece; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from basaltic.llm.tokens import settle, sole, stretches

#: Characters of a text that are encoded in one call.
PIECE = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBpe:
    """tiktoken over a rank file, without special tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})

    def encode(self, text: str) -> list[int]:
        ids, lead = [], ""
        for piece in stretches(text, PIECE):
            ids += self.encoding.encode_ordinary(lead + piece)
            lead = " "
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return sole(("bytes", path, pattern), lambda: ByteBpe(path, pattern))


def map_texts(docs: DataFrame, path: str, pattern: str, make, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``make(bpe, ids, texts)`` over bounded slices, as Arrow arrays in schema order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield make(bpe, part.column(0), part.column(1))
            settle()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, **columns: str) -> DataFrame:
    """doc_id and its ids."""

    def make(bpe, keys, texts):
        return pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array([bpe.encode(t.as_py() or "") for t in texts], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_texts(docs, path, pattern, make, "doc_id long, ids array<int>", **columns)


def digests(docs: DataFrame, path: str, pattern: str, **columns: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids, one space between) and decoded_sha256."""

    def make(bpe, keys, texts):
        n, ids_sha, decoded_sha = [], [], []
        for t in texts:
            ids = bpe.encode(t.as_py() or "")
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs, path, pattern, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", **columns)
