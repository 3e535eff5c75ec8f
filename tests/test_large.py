"""What went wrong only on large or odd tables: texts of one long line, many questions alike, vectors and tokens in numbers."""

import random

from pyspark.sql import functions as F

from shardloom.functions import text as tx
from shardloom.operators import rerank, search, structure
from shardloom.plans import batch, catalogue, registry


def test_one_long_line_without_headings_gives_even_chunks(spark):
    line = "word " * 700 + "end"
    docs = spark.createDataFrame([(1, line), (2, "short line of a title\n\n" + "x" * 1500)], "doc_id long, text string")
    got = structure.structure_chunks(docs, most=1000).orderBy("doc_id", "chunk_index").collect()
    one = [r.chunk_text for r in got if r.doc_id == 1]
    assert len(one) == 8 and max(map(len, one)) <= 1000 and sum(map(len, one)) == 2 * len(line) + 3
    assert "".join(one) == f"# {line}\n{line}"
    assert max(len(r.chunk_text) for r in got) <= 1000
    assert {r.role for r in got} == {"fallback"}


def test_faster_text_functions_keep_their_results(spark):
    rows = [(f"{chr(c)}a {chr(c)}{chr(c)}b{chr(c)}",) for c in [*range(1, 0x3100), *range(0xFE00, 0x10000)]] + [("あ 1\nい。\nう \t漢",), ("",), (" \n　",)]
    d = spark.createDataFrame(rows, "t string")
    t = F.col("t")
    plain = F.regexp_replace(F.regexp_replace(t, f"^{tx.ANY_SPACE}+", ""), f"{tx.ANY_SPACE}+\\z", "")
    spaces = F.regexp_replace(F.translate(t, tx.ZERO_WIDTH, ""), f"[{tx.OTHER_SPACES}]", " ")
    closed = F.regexp_replace(t, f"(?<=[{tx.GLUE}\n]){tx.BLANKS}+(?=[{tx.GLUE}\n])", "")
    joined = F.regexp_replace(t, f"(?<=[{tx.GLUE}])(?<![{tx.KEEP_BREAK_AFTER}])\n(?!\n)(?=[{tx.GLUE}])", "")
    assert d.where((tx.stripped(t) != plain) | (tx.unified_spaces(t) != spaces) | (tx.closed_spaces(t) != closed) | (tx.joined_breaks(t) != joined)).count() == 0
    kinds = F.coalesce(*[F.when(t.rlike(p), F.lit(n)) for n, p, _ in structure.RULES])
    assert d.where(~structure.heading_type(t).eqNullSafe(kinds)).count() == 0


def test_questions_of_one_vector_are_searched_once(spark):
    v = spark.createDataFrame([(k, [float(k % 7), float(k % 5)]) for k in range(300)], "record_id long, embedding array<double>")
    q = spark.createDataFrame([(k, [float(k % 2), 1.0]) for k in range(50)] + [(90, None), (91, [1.0, None])], "query_id long, embedding array<double>")
    assert search._distinct_vectors(q, "query_id", "embedding")[1].count() == 2
    want = {}
    for k in range(50):
        d = sorted(((k % 2 - i % 7) ** 2 + (1 - i % 5) ** 2, i) for i in range(300))[:4]
        want |= {(k, i): (float(x), n + 1) for n, (x, i) in enumerate(d)}
    for found in (search.vector_top_k(q, v, 4, block=40), search.vector_top_k_pruned(q, v, 4, block=40)):
        assert {(r.query_id, r.record_id): (r.distance, r.rank) for r in found.collect()} == want


def test_long_tokens_cost_a_sketch_and_are_counted_as_by_hand(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab漢") for _ in range(rnd.randint(0, 200))) for _ in range(40)] + ["ab" * 400, "a" * 300, "", None]
    tokens = sorted({t[a : a + n] for t in texts if t for n in (1, 2, 3, 7, 16, 31, 33, 90) for a in (0, 5) if len(t) >= a + n} | {"ab" * 300 + "x", "aaa", "aab漢" * 20})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, document_lower string")
    asked = spark.createDataFrame([(t,) for t in tokens], "token string")
    want = {(i, k, t.count(k)) for i, t in enumerate(texts) if t for k in tokens if k in t}
    assert {tuple(r) for r in search._token_hits(docs, asked).collect()} == want
    sketch = search._sketches(spark.createDataFrame([("x" * 100_000,)], "token string")).drop("token").first()
    assert len(sketch.key) == 16 and sketch.length == 100_000 and sketch.width == 32


def test_a_batch_leaves_out_questions_that_reranking_left_nothing(spark):
    registry.register("reranking", "logic_nothing", registry.Reranker(lambda c, k: rerank.identity(c, k).where("false"), lambda k: 0))
    try:
        assert catalogue._batch(spark, "/root/testdata/sf0.001", "logic_nothing").count() == 0
    finally:
        registry._LOGIC["reranking"].pop("logic_nothing")


def test_numbering_makes_its_rows_once(spark):
    """A batch's records are a long plan: the sample that finds ranges of keys made them a second time."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(0, 500, 1, 3).mapInArrow(seen, "id long")
    got = batch.numbered(rows, "id").collect()
    assert sorted((r.id, r.question_index) for r in got) == [(k, k) for k in range(500)]
    assert made.value == 500
