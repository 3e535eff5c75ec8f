"""Token counts by prefix dynamic programming (operator 1).

For each piece of a text the exact token count of every prefix is built up from the counts of
shorter prefixes: the last token of a prefix is the only vocabulary entry ending there that stays
itself beside the last token before it. The stored counts then answer how many tokens a prefix has,
whether a text is within a budget and where to cut it, and nothing is encoded again.

Rows: null or empty text has 0 bytes and 0 tokens; a null id is kept; repeated rows each give a
row; an empty table gives an empty table; extra columns are ignored. Texts of any length are whole
in one task, pieces of any length are counted without a limit.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import ByteBpe, ChunkMemory, independent, loaded
from .common import columns_of, id_and_text


class Counter:
    """Token counts with a memory of chunks."""

    def __init__(self, spec: str):
        self.bpe = ByteBpe(spec)
        self.memory = ChunkMemory(self.whole)

    def whole(self, text: str) -> int:
        return sum([self.bpe.piece_counts(p)[-1] for p in self.bpe.pieces(text)])


def _fit_by_chunks(bpe: ByteBpe, chunks: list[str], counts: list[int], budget: int) -> int:
    """As bpe.fit() for a text whose chunks are independent; only the chunk where the budget ends is looked into."""
    ends = list(accumulate(counts, initial=0))
    k = max(i for i, e in enumerate(ends[:-1]) if e <= budget)
    inside = bpe.prefix_counts((" " if k else "") + chunks[k])
    last = max(i for i, n in enumerate(inside.tolist()) if ends[k] + n <= budget)
    return sum(len(c) for c in chunks[:k]) + max(0, k - 1) + last


def token_counts(docs: DataFrame, tokenizer_json: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars for each row of ``docs``.

    ``tokenizer_json`` is the content of a byte-level BPE file. ``fit_chars`` is the length in
    characters of the longest prefix of at most ``limit`` tokens. One pass, no shuffle.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())])

    def count(batches):
        counter = loaded(Counter, spec.value)
        bpe, whole, memory = counter.bpe, counter.whole, counter.memory
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
                text = text or ""
                if independent(text):
                    chunks = text.split(" ")
                    counts = [whole(chunks[0]), *map(memory.__getitem__, chunks[1:])]
                    n = sum(counts)
                    fit = _fit_by_chunks(bpe, chunks, counts, limit) if n > limit else len(text)
                else:
                    prefix = bpe.prefix_counts(text)
                    n = int(prefix[-1])
                    fit = bpe.fit(text, limit) if n > limit else len(text)
                out.append((doc_id, len(text.encode("utf-8", "surrogatepass")), n, n > limit, fit))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_token_counts(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts: array<int> with the exact token count of every prefix of the text, the empty one first."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = pa.schema([("doc_id", pa.int64()), ("counts", pa.list_(pa.int32()))])

    def count(batches):
        bpe = loaded(Counter, spec.value).bpe
        for batch in batches:
            ids, texts = columns_of(batch, "doc_id", "text")
            for doc_id, text in zip(ids, texts, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([bpe.prefix_counts(text)], schema.types[1])], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(count, "doc_id long, counts array<int>")
