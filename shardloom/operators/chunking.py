"""Splitting texts by size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def even_parts(c: Column, most: int | Column) -> Column:
    """Parts of equal width, as few as ``most`` characters allow; blank parts go."""
    n = F.ceil(F.char_length(c) / F.lit(most))
    width = F.ceil(F.char_length(c) / n).cast("int")
    # the text and its width are worked out once, not for each part
    shared = F.transform(F.array(F.struct(c.alias("text"), width.alias("width"), (n - 1).cast("int").alias("last"))), lambda s: F.transform(F.sequence(F.lit(0), s["last"]), lambda i: F.substring(s["text"], i * s["width"] + 1, s["width"])))
    parts = F.get(shared, F.lit(0))
    return F.when(F.char_length(c) > most, F.filter(parts, lambda p: p.rlike(r"\S"))).when((F.char_length(c) > 0) & c.rlike(r"\S"), F.array(c)).otherwise(F.array().cast("array<string>"))


def balanced_groups(sizes: Column, most: int | Column) -> Column:
    """Group number of each size: a group ends before it would pass ``most``, or once it has reached an even share and groups remain."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.greatest(F.lit(1), F.ceil(total / F.lit(most)))
    share = F.ceil(total / n)
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("group"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        over = (s["held"] > 0) & (s["held"] + x > most)
        full = (s["held"] >= share) & (s["group"] < n - 1)
        ends = over | full
        group = s["group"] + ends.cast("long")
        return F.struct((F.when(ends, 0).otherwise(s["held"]) + x).alias("held"), group.alias("group"), F.concat(s["out"], F.array(group)).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def paragraphs(docs: DataFrame, separator: str = r"\n{2,}", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns of ``keep``, paragraph, start_char, text: non-blank paragraphs; an offset advances by a paragraph and two, whatever the separator."""
    parts = docs.select("doc_id", *keep, F.posexplode(F.split(text, separator)).alias("paragraph", "text"))
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("paragraph").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("start_char", F.coalesce(F.sum(F.char_length("text") + 2).over(w), F.lit(0)))
    return placed.where(F.col("text").rlike(r"\S"))


def _split(text: str, separators: tuple[str, ...], size: int, overlap: int) -> list[str]:
    """Pieces by the first separator that occurs, kept at the start of what follows it, put together up to ``size``."""
    which = next(k for k, s in enumerate(separators) if s == "" or s in text)
    mark, later = separators[which], separators[which + 1 :]
    if mark:
        first, *others = text.split(mark)
        pieces = [p for p in [first, *(mark + p for p in others)] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    held: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            held.append(piece)
            continue
        out += _joined(held, size, overlap)
        held = []
        out += _split(piece, later, size, overlap) if later else [piece]
    return out + _joined(held, size, overlap)


def _joined(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    window: list[str] = []
    total = 0
    for piece in pieces:
        if window and total + len(piece) > size:
            out.append("".join(window).strip())
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(window.pop(0))
        window.append(piece)
        total += len(piece)
    return [p for p in [*out, "".join(window).strip()] if p]


def recursive_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, text: str = "text") -> DataFrame:
    """doc_id, chunk_index, chunk_text: recursive splitting at blank lines, lines, spaces, characters.

    Merging is sequential within a text, so it runs in Arrow batches; texts are independent.
    """

    def run(batches):
        for batch in batches:
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                chunks = _split(body, SEPARATORS, size, overlap) if body else []
                if chunks:
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(chunks), batch.column("doc_id").type), pa.array(range(len(chunks)), pa.int32()), pa.array(chunks)], names=["doc_id", "chunk_index", "chunk_text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, chunk_index int, chunk_text string")
