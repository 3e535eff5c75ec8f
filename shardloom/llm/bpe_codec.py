"""BPE encoding and decoding (operator 10).

Encoding merges a doubly linked list of symbols in the order of a priority queue of merge ranks;
entries that have become stale are skipped. Decoding puts vocabulary strings together.

Rows: null or empty text has no ids and decodes to the empty text; a null id is kept; repeated rows
each give a row; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import ByteBpe, ChunkMemory, independent, loaded
from .common import columns_of, id_and_text


class Codec:
    """Encoder with a memory of chunks."""

    def __init__(self, spec: str):
        self.bpe = ByteBpe(spec)
        self.memory = ChunkMemory(self._chunk)

    def _chunk(self, text: str) -> bytes:
        return np.array([i for p in self.bpe.pieces(text) for i in self.bpe.piece_ids(p)], dtype="<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if not independent(text):
            return self.bpe.encode(text)
        chunks = text.split(" ")
        return np.frombuffer(b"".join([self._chunk(chunks[0]), *map(self.memory.__getitem__, chunks[1:])]), dtype="<u4")


def encode(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the ids of each whole text, without added special tokens."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        codec = loaded(Codec, spec.value)
        for batch in batches:
            ids, texts = columns_of(batch, "doc_id", "text")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([codec.encode(t).astype(np.int32) for t in texts], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer_json: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: vocabulary strings of the ids put together. Null ids decode to the empty text; null or unknown elements give nothing."""
    from pyspark.sql import functions as F

    spec = rows.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        bpe = loaded(Codec, spec.value).bpe
        for batch in batches:
            keys, ids = columns_of(batch, "doc_id", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([bpe.decode([i for i in x or () if i is not None]) for x in ids], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode() and then decode() give, in one pass without a shuffle."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        codec = loaded(Codec, spec.value)
        bpe = codec.bpe
        decimal = [str(i) for i in range(len(bpe.text_of))]
        for batch in batches:
            keys, texts = columns_of(batch, "doc_id", "text")
            n, a, b = [], [], []
            for text in texts:
                ids = codec.encode(text).tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
