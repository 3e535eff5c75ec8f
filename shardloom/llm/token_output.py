"""Token-id files with Elias-Fano document boundaries (operator 4).

Documents are put in the order of their ids by a range shuffle of their texts, encoded partition by
partition, and written as blocks of at most ``block_ids`` ids (a longer document has a block alone).
A block is one binary value with everything needed to read it:

    magic, documents, documents without an id, first document id, ids | document ids | boundaries
    | ids as little-endian unsigned 32-bit integers

Document ids (their distance from the first) and the document boundaries inside a block rise, so
both are Elias-Fano encoded: each number's low bits stand in a packed array, its high bits in unary in
a bit array, and select(i) finds the i-th set bit from the sample before it. Blocks are rows of a
Parquet table, so that Spark's committer handles lost tasks and any store that Spark can write to
holds them; each block has the number of ids before it in its shard, and what the driver sees is one
row per shard.

Rows: null or empty text has the end id alone; null ids come first; rows with the same id follow
each other by a hash of their text, then by text; an empty table gives no blocks; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_alphabet, loaded
from .common import columns_of, id_and_text, in_slices, partitions_for, remove_at_exit, shared_dir

MAGIC = b"SLEF"
_HEAD = struct.Struct("<4sQQqQ")
_LIST = struct.Struct("<QQQQQ")
_SAMPLE = 64
#: UTF-8 bytes of text that a partition encodes, about.
PARTITION_BYTES = 64 << 20
#: Shards whose first places, 12 bytes each, are sent to all tasks.
SENT_SHARDS = 1 << 19


class EliasFano:
    """A rising list of non-negative integers below or equal to ``bound``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        # bytes, as single elements of them are read faster than an array's
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, bytes(low), bytes(high), samples

    @classmethod
    def of(cls, values: np.ndarray, bound: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(bound // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low_bits else np.zeros((n, 0), np.uint8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(places[-1]) + 1) if n else 0, np.uint8)
        unary[places] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(unary, bitorder="little"), places[::_SAMPLE].astype("<u8"))

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        return (int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3], "little") >> (at & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, without reading the values before its sample."""
        place = int(self.samples[i // _SAMPLE])
        left = i % _SAMPLE
        byte, bit = place >> 3, place & 7
        word = self.high[byte] >> bit << bit
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        return (((byte << 3) + (word & -word).bit_length() - 1 - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.int64) << self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return high + (bits << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else high


    def pack(self) -> bytes:
        return b"".join([_LIST.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)), self.low, self.high, self.samples.tobytes()])

    @classmethod
    def unpack(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        """A packed list at a place of ``data``, and the place after it; nothing is copied."""
        n, low_bits, low, high, samples = _LIST.unpack_from(data, at)
        at += _LIST.size
        parts = np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low), np.frombuffer(data, "<u8", samples, at + low + high)
        return cls(n, low_bits, *parts), at + low + high + 8 * samples


def pack_block(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A block of documents in the order of their ids, those without an id first."""
    ends = np.cumsum(np.array([len(x) // 4 for x in ids], np.int64))
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    keys = np.array([d - first for d in known], np.uint64)  # the whole range of 64-bit ids fits
    total = int(ends[-1]) if len(ends) else 0
    return b"".join([_HEAD.pack(MAGIC, len(ids), len(ids) - len(known), first, total), EliasFano.of(keys, int(keys[-1]) if known else 0).pack(), EliasFano.of(ends, total).pack(), *ids])


class Block:
    """Reader of one block; documents and their ids are looked up by select, the lists stay packed."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.n_null, self.first, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        self.keys, at = EliasFano.unpack(data, _HEAD.size)
        self.bounds, at = EliasFano.unpack(data, at)
        self.ids = memoryview(data)[at : at + 4 * self.n_ids]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.first + self.keys.select(i - self.n_null)

    def span(self, i: int) -> tuple[int, int]:
        """First id of the i-th document in this block, and one past its last, by select."""
        return (self.bounds.select(i - 1) if i else 0), self.bounds.select(i)

    def find(self, doc_id: int) -> list[int]:
        """Places of the documents with an id, by bisection over select."""
        at = bisect_left(range(self.keys.n), doc_id - self.first, key=self.keys.select)
        found = []
        while at < self.keys.n and self.keys.select(at) == doc_id - self.first:
            found.append(self.n_null + at)
            at += 1
        return found

    def document(self, i: int) -> np.ndarray:
        start, end = self.span(i)
        return np.frombuffer(self.ids[4 * start : 4 * end], "<u4")


#: Words of these characters only are lower-cased and cut by the pattern below as the library does it with word_bpe files.
_LATIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*\Z")
_LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_WORD_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


#: Characters that str.split() takes for white space and the library doesn't.
_NO_SPACES = "\x1c\x1d\x1e\x1f"
#: Pieces and words that a worker remembers, some 240 bytes each; fewer take more time.
_PIECES, _WORDS = 600_000, 150_000
_LEAN_PIECES, _LEAN_WORDS = 150_000, 75_000


class PieceMemory(dict):
    """Lower-cased piece -> its ids as bytes, from the library's model."""

    def __init__(self, model):
        super().__init__()
        self.model, self.most = model, _PIECES
        self.stands_for = {b: c for c, b in byte_alphabet().items()}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        spelled = piece if piece.isascii() else "".join(map(self.stands_for.__getitem__, piece.encode()))
        got = self[piece] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return got


class WordMemory(dict):
    """Word between white space -> its ids as bytes, from the library itself."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_str(spec), _WORDS
        self.pieces = PieceMemory(self.tokenizer.model)
        data = json.loads(spec)
        kinds = [n["type"] for n in (data["normalizer"] or {}).get("normalizers", [])]
        splits = (data["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": _WORD_PIECES} and not splits[1]["use_regex"]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if self.plain and _LATIN.match(word):
            got = b"".join(map(self.pieces.__getitem__, _LATIN_PIECES.findall(word.lower())))
        else:
            got = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = got
        return got

    def hold(self, pieces: int, words: int) -> None:
        """Remembers so many at most from now on; what is more than that is forgotten."""
        for memory, most in ((self.pieces, pieces), (self, words)):
            memory.most = most
            if len(memory) > most:
                memory.clear()

    def ids_of(self, text: str | None) -> bytes:
        if text and ("<|" in text or any(c in text for c in _NO_SPACES)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, (text or "").split()))


def token_sizes(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", lean: bool = False) -> DataFrame:
    """doc_id, text_key, size: the number of ids that each text has in the blocks, without the end id; text_key is the text's MD5 digest, which tells rows with one id, or none, apart.

    ``lean``: workers remember fewer words, and none after their task, for executors that other stages have filled; same results, more time.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        memory = loaded(WordMemory, spec.value)
        memory.hold(*((_LEAN_PIECES, _LEAN_WORDS) if lean else (_PIECES, _WORDS)))
        for batch in in_slices(batches):
            ids, texts = columns_of(batch, "doc_id", "text")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column("text_key"), pa.array([len(memory.ids_of(t)) // 4 for t in texts], pa.int64())], names=["doc_id", "text_key", "size"])
        if lean:
            memory.hold(0, 0)

    return id_and_text(docs, id_col, text_col).withColumn("text_key", F.md5("text")).mapInArrow(run, "doc_id long, text_key string, size long")


def token_ids(docs: DataFrame, tokenizer_json: str, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, ids array<int>: the ids that each text has in the blocks, without the end id; without ``id_col`` doc_id is null."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        memory = loaded(WordMemory, spec.value)
        memory.hold(_PIECES, _WORDS)
        for batch in in_slices(batches):
            ids, texts = columns_of(batch, "doc_id", "text")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column("text_key"), pa.array([np.frombuffer(memory.ids_of(t), "<i4") for t in texts], pa.list_(pa.int32()))], names=["doc_id", "text_key", "ids"])

    rows = id_and_text(docs, id_col, text_col) if id_col else docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.withColumn("text_key", F.md5("text")).mapInArrow(run, "doc_id long, text_key string, ids array<int>")


def write_token_blocks(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 1, block_ids: int = 1 << 20, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the blocks of ``docs`` to ``path`` in ascending order of their ids.

    For a tokenizer that drops white space, so that words between white space are encoded alone as
    in the text; a text that holds a special string goes through the library as one. Without
    ``partitions`` there are as many as the texts' bytes need. Ranges are of id and text hash, so that
    rows that repeat an id, or have none, are dealt over several.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_json)
    d = id_and_text(docs, id_col, text_col)
    if partitions is None:
        size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), partitions_for(size, PARTITION_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    ordered = d.withColumn("text_hash", F.xxhash64("text")).repartitionByRange(partitions, *order).sortWithinPartitions(*order, "text")
    end = struct.pack("<I", end_id)

    def run(batches):
        from pyspark import TaskContext

        memory = loaded(WordMemory, spec.value)
        memory.hold(_PIECES, _WORDS)
        shard, seq = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        held: list[bytes] = []
        size, before = 0, 0

        def block():
            values = [(shard, pa.int32()), (seq, pa.int32()), (len(held), pa.int64()), (size, pa.int64()), (before, pa.int64()), (pack_block(keys, held), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=["shard", "seq", "n_docs", "n_ids", "inside", "block"])

        for batch in in_slices(batches):
            for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
                ids = memory.ids_of(text) + end
                if held and size + len(ids) // 4 > block_ids:
                    yield block()
                    before += size
                    keys, held, size, seq = [], [], 0, seq + 1
                keys.append(doc_id)
                held.append(ids)
                size += len(ids) // 4
        if held:
            yield block()

    ordered.select("doc_id", "text").mapInArrow(run, _BLOCKS).write.option("compression", "zstd").parquet(path)


_BLOCKS = "shard int, seq int, n_docs long, n_ids long, inside long, block binary"


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """shard, seq, n_docs, n_ids, block, start: the blocks with the number of ids in all blocks before.

    Each shard's total (a row per shard) goes through the driver; while there are at most SENT_SHARDS they are sent to all tasks, beyond that joined.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    before, at = [], 0
    for shard, n in sorted(tuple(r) for r in blocks.groupBy("shard").agg(F.sum("n_ids")).collect()):
        before.append((shard, at))
        at += n
    base = spark.createDataFrame(before, "shard int, base long")
    if len(before) <= SENT_SHARDS:
        base = F.broadcast(base)
    return blocks.join(base, "shard").select("shard", "seq", "n_docs", "n_ids", "block", (F.col("base") + F.col("inside")).alias("start"))


def documents_in(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from what read_token_blocks() gives. Each boundary is found by select."""

    def run(batches):
        for batch in batches:
            for data, start in zip(*columns_of(batch, "block", "start"), strict=True):
                block = Block(data)
                ends = list(map(block.bounds.select, range(block.n_docs)))
                spans = list(zip([0, *ends[:-1]], ends, strict=True))
                crc = [zlib.crc32(block.ids[4 * a : 4 * b]) for a, b in spans]
                columns = [list(map(block.doc_id, range(block.n_docs))), [start + a for a, _ in spans], [b - a for a, b in spans], crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("block", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer_json: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the blocks into the shared folder, reads them back and returns documents_in() of them."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-blocks-{uuid.uuid4().hex}"
    write_token_blocks(docs, path, tokenizer_json, end_id, id_col=id_col, text_col=text_col)
    remove_at_exit(spark, path)
    return documents_in(read_token_blocks(spark, path))
