import numpy as np
from pyspark.sql import functions as F

from shardloom.operators import search


def test_pruned_search_reads_few_balls_and_gives_the_same_rows(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (12, 8))
    vectors = [(k, (centres[k % 12] + rng.normal(0, 0.05, 8)).round(3).tolist()) for k in range(1200)]
    vectors += [(2000 + k, vectors[k][1]) for k in range(40)] + [(3000, None), (3001, []), (3002, [0.0, None] * 4), (3003, [1.0, 2.0]), (3004, [1.0, 2.5])]
    v = spark.createDataFrame(vectors, "record_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(k, vectors[7 * k][1]) for k in range(30)] + [(90, [1.0, 2.1]), (91, [9.0] * 3), (92, None)], "query_id long, embedding array<double>")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "record_id", "distance", "rank").collect()))
    for k in (1, 5, 3000):
        assert rows(search.vector_top_k_pruned(q, v, k, block=32)) == rows(search.vector_top_k(q, v, k))
    held = search.balls(v, block=32).cache()
    read = search.balls_to_read(q, held, 5).groupBy("query_id").count().where("query_id < 30").agg(F.avg("count")).first()[0]
    assert read < 0.5 * held.count()
    assert held.agg(F.sum("n")).first()[0] == 1242 and held.agg(F.max("n")).first()[0] <= 64
    held.unpersist()
    assert search.vector_top_k_pruned(q, v, 0).count() == search.vector_top_k_pruned(q, v.where("false"), 3).count() == 0


def test_many_small_automatons_find_what_one_finds(spark):
    docs = spark.createDataFrame([(k, " ".join(f"word{j}" for j in range(k, k + 30)) + " abab ababab") for k in range(60)], "doc_id long, document_lower string")
    q = spark.createDataFrame([(k, [f"word{k} word{k + 1}"]) for k in range(80)] + [(200, ["abab"]), (201, ["nowhere at all, but it begins so"]), (202, ["word5", "word5", "word6"])], "query_id long, tokens array<string>")
    rows = lambda **kw: sorted(map(tuple, search.keyword_search(q, docs, 10, **kw).collect()))
    one = rows()
    assert one == rows(most_chars=64) and len(one) > 300
    plan = search._token_hits(docs, q.select(F.explode("tokens").alias("token")), 64)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
