"""What tasks make of a batch of texts in Python stays small."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from shardloom.llm import bpe, jaccard_join, quality_classifier, token_output

from .helpers import TEXTS, frame, spec


class Plan:
    """Stands for a table, and gives what its tasks would run."""

    sparkSession = sparkContext = property(lambda self: self)
    select = withColumn = lambda self, *names: self
    mapInArrow = lambda self, run, schema: run

    def broadcast(self, value):
        return SimpleNamespace(value=value)


def tasks():
    every = SimpleNamespace(value=np.full(1 << (jaccard_join._BITS - 3), 255, np.uint8))
    order = SimpleNamespace(value=jaccard_join.Frequent(np.zeros(1, np.uint64), np.ones(1, np.int64)))
    return {
        "_sets": lambda: jaccard_join._sets(Plan(), 5),
        "_prefixes": lambda: jaccard_join._prefixes(Plan(), 5, 80, order),
        "_members": lambda: jaccard_join._members(Plan(), 5, every),
        "token_sizes": lambda: token_output.token_sizes(Plan(), spec("word_bpe_49k.json")),
        "measure": lambda: quality_classifier.measure(Plan()),
    }


def peak_of(work):
    tracemalloc.start()
    try:
        assert work() >= 20_000
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("name", sorted(tasks()))
def test_memory_of_a_batch(spark, name):
    """A batch of 60 MB of text, which was made a list of Python strings whole."""
    run = tasks()[name]()
    rows = lambda n: pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": ["x" * 3000] * n, "text_key": ["k"] * n, "text_hash": [1] * n})
    large, small = rows(20_000), rows(1)
    list(run(iter([small])))
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([large]))) >= 20_000
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30 << 20


def test_memory_of_verdicts(monkeypatch):
    """The function that decides beside the text took a list of all texts of a batch."""
    made = []
    model = SimpleNamespace(score=lambda x: np.ones(len(x)))
    for name, value in {"measure": lambda *a: Plan(), "staged": lambda *a: Plan(), "fit": lambda *a: model}.items():
        monkeypatch.setattr(quality_classifier, name, value)
    monkeypatch.setattr(quality_classifier, "F", SimpleNamespace(arrow_udf=lambda f, kind: made.append(f) or (lambda c: c), col=lambda c: SimpleNamespace(cast=lambda kind: c)))
    quality_classifier.good_rows(SimpleNamespace(where=lambda c: c), None)
    texts = pa.array(["x" * 3000] * 20_000)
    assert made[0](texts[:1]).to_pylist() == [True] and made[0](texts[:0]).to_pylist() == []
    assert peak_of(lambda: len(made[0](texts))) < 30 << 20


def test_memory_of_words(spark):
    """A worker remembered 600,000 pieces, and kept them through the stages that followed."""
    texts = [" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}q" for k in range(10 * i, 10 * i + 10)) for i in range(20_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "text_key": ["k"] * len(texts)})
    lean, other = (token_output.token_sizes(Plan(), spec("word_bpe_49k.json"), lean=x) for x in (True, False))
    sizes = lambda run: [x for b in run(iter([batch])) for x in b.column("size").to_pylist()]
    list(lean(iter([batch.slice(0, 1)])))
    assert peak_of(lambda: len(sizes(lean))) < 48 << 20
    memory = bpe.loaded(token_output.WordMemory, spec("word_bpe_49k.json"))
    assert not memory and not memory.pieces
    assert sizes(lean) == sizes(other)


def test_batches_of_stages(spark):
    """A task's Arrow batches held up to 10,000 texts, whatever their bytes; a limit that the user has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('many words ', 1000) AS text")

    def largest(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)])], names=["most"])

    for name, stage in corpus_pipeline.STAGES:
        if name in ("quality_classifier", "ngram_jaccard_join", "best_fit_packing"):
            spark.conf.unset(key)
            stage(spark, frame(spark).select("doc_id", "text"), "/root/testdata/sf0.001")
            assert texts.mapInArrow(largest, "most long").first().most < 6 << 20
            spark.conf.set(key, 12345)
            stage(spark, frame(spark, TEXTS[:2]).select("doc_id", "text"), "/root/testdata/sf0.001")
            assert int(spark.conf.get(key)) == 12345
    spark.conf.unset(key)
