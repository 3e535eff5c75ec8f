import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.llm.bpe import ByteBpe
from shardloom.llm.bpe_codec import decode, encode, round_trip_digests
from shardloom.llm.token_counts import prefix_token_counts, token_counts
from shardloom.llm.token_output import Block, EliasFano, WordMemory, documents_in, pack_block, read_token_blocks, token_file_digests, write_token_blocks

from shardloom.llm.common import shared_dir

from .helpers import TEXTS, frame, library, rows, spec

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(spec(BYTE))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t'<|>srtevd0129aébñ!日😀endoftx.", max_size=40))
def test_encoding_and_prefixes_equal_the_library(text):
    own, lib = ByteBpe_once(), library_once()
    ids = lambda s: lib.encode(s, add_special_tokens=False).ids
    assert own.encode(text).tolist() == ids(text)
    assert own.decode(ids(text)) == lib.decode(ids(text), skip_special_tokens=False)
    assert own.prefix_counts(text).tolist() == [len(ids(text[:i])) for i in range(len(text) + 1)]


def ByteBpe_once(cache={}):  # noqa: N802, B006
    return cache.setdefault("b", ByteBpe(spec(BYTE)) if "b" not in cache else None)


def library_once(cache={}):  # noqa: B006
    return cache.setdefault("l", library(BYTE) if "l" not in cache else None)


def test_counts(spark):
    lib = library(BYTE)
    got = rows(token_counts(frame(spark), spec(BYTE), limit=50))
    want = []
    for d, t in TEXTS:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 50))
    assert [r[:4] for r in got] == sorted(want, key=repr)
    for d, _, n, over, fit in got:
        if over and d in (0, 8, 12):
            text = dict(TEXTS)[d]
            assert len(lib.encode(text[:fit], add_special_tokens=False).ids) <= 50
            assert all(len(lib.encode(text[:i], add_special_tokens=False).ids) > 50 for i in range(fit + 1, min(len(text), fit + 40) + 1))
    assert token_counts(frame(spark, []), spec(BYTE)).count() == 0


def test_prefix_column(spark):
    lib = library(BYTE)
    got = {r.doc_id: r.counts for r in prefix_token_counts(frame(spark, [(1, "it's  a test"), (2, None)]), spec(BYTE)).collect()}
    assert got[2] == [0]
    assert got[1] == [len(lib.encode("it's  a test"[:i], add_special_tokens=False).ids) for i in range(13)]


def test_codec(spark):
    lib = library(BYTE)
    want = []
    for d, t in TEXTS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(round_trip_digests(frame(spark), spec(BYTE))) == sorted(want, key=repr)
    back = decode(encode(frame(spark), spec(BYTE)), spec(BYTE))
    assert rows(back) == sorted([(d, t or "") for d, t in TEXTS], key=repr)
    odd = spark.createDataFrame([(1, [None, 50255, 10**8, 128]), (2, None)], "doc_id long, ids array<int>")
    assert decode(odd, spec(BYTE)).count() == 2
    assert encode(frame(spark, []), spec(BYTE)).count() == 0


def test_files(spark):
    lib = library(WORD)
    got = token_file_digests(frame(spark), spec(WORD), end_id=1).collect()
    at, want = 0, []
    for d, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_file_digests(frame(spark, []), spec(WORD)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=700))
def test_elias_fano(lengths):
    ends = np.cumsum(np.array(lengths, np.int64)) if lengths else np.zeros(0, np.int64)
    ef = EliasFano.of(ends, int(ends[-1]) if len(ends) else 0)
    assert ef.all().tolist() == ends.tolist()
    assert [ef.select(i) for i in range(0, len(ends), 7)] == ends[::7].tolist()


def test_block_reads_single_documents():
    ids = [np.arange(k, dtype="<u4").tobytes() for k in (3, 0, 5)]
    block = Block(pack_block([5, None, 7], ids))
    assert [block.document(i).tolist() for i in range(3)] == [[0, 1, 2], [], [0, 1, 2, 3, 4]]
    assert block.span(2) == (3, 8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1), st.integers(0, 40)), max_size=200))
def test_block_keeps_document_ids(ids):
    ids = sorted(ids, key=lambda d: (d is not None, d or 0))
    block = Block(pack_block(ids, [b"abcd"] * len(ids)))
    assert [block.doc_id(i) for i in range(len(ids))] == ids
    for d in (0, 7, *[d for d in ids[-3:] if d is not None]):
        assert block.find(d) == [i for i, x in enumerate(ids) if x == d]


LATIN = "".join(map(chr, range(0x100)))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=LATIN, max_size=30))
def test_words_equal_the_library(text):
    own, lib = WordMemory_once(), word_library_once()
    for t in (text, text.upper(), text.lower(), text.title(), text.swapcase()):
        assert np.frombuffer(own.ids_of(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_each_latin_character_equals_the_library():
    own, lib = WordMemory_once(), word_library_once()
    for c in LATIN:
        for t in (c, f"a{c}b", f"A{c}{c}B", f"{c}'S 1{c}2", f" {c} {c.upper()}{c.lower()}"):
            assert np.frombuffer(own.ids_of(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def WordMemory_once(cache={}):  # noqa: N802, B006
    return cache.setdefault("w", WordMemory(spec(WORD)) if "w" not in cache else None)


def word_library_once(cache={}):  # noqa: B006
    return cache.setdefault("w", library(WORD) if "w" not in cache else None)


def test_rows_that_repeat_an_id_are_dealt_over_partitions(spark):
    texts = [(None if k % 2 else 5, f"text number {k}") for k in range(400)]
    path = f"{shared_dir(spark)}/dealt"
    write_token_blocks(frame(spark, texts), path, spec(WORD), partitions=6)
    per = [r.n for r in spark.read.parquet(path).groupBy("shard").agg({"n_docs": "sum"}).toDF("shard", "n").collect()]
    assert sum(per) == 400 and len(per) >= 4 and max(per) < 200
    assert [r.doc_id for r in documents_in(read_token_blocks(spark, path)).orderBy("start").collect()] == [None] * 200 + [5] * 200
