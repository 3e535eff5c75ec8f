import dataclasses
import json
import pytest
from pyspark.sql import functions as F

from shardloom.functions import text as tx
from shardloom.operators import chunking, rerank, search, store
from shardloom.operators import structure as st
from shardloom.sources import config
from shardloom.sources import documents as src
from shardloom.streaming import ingest


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("第 9 条　目的", "第9条目的"),
        ("日本\n語。\n次の行", "日本語。\n次の行"),
        ("a​b c\r\n\r\n\r\n\r\nd  ", "ab c\n\nd"),
        ("plain  text\nstays here", "plain text\nstays here"),
        ("１ ２\n３", "１２３"),
    ],
)
def test_normalised(spark, raw, want):
    assert one(spark, raw, tx.normalised) == want


@pytest.mark.parametrize(("raw", "want"), [("十", 10), ("二十三", 23), ("百五", 105), ("１２", 12), ("7", 7), ("〇", None), ("2十", None), ("0", None), ("", None), ("x", None)])
def test_numerals(spark, raw, want):
    assert one(spark, raw, tx.numeral) == want


def test_cells(spark):
    assert one(spark, " a\r\nb ", tx.snippet) == "a  b"
    assert len(one(spark, "x" * 900, tx.snippet)) == 800
    assert one(spark, "### H\n- **b** `c`\n> q", tx.markdown_plain) == "H\nb c\nq"
    assert one(spark, "#### a\n#### b", tx.demoted) == "- a\n- b"
    assert one(spark, "- x\n#### a", tx.demoted) == "- x\n#### a"
    assert one(spark, "  Query ", tx.query_tokens) == ["query"] and one(spark, " ", tx.query_tokens) == []


def test_recursive_splitting(spark):
    d = spark.createDataFrame([(1, "aaa bbb ccc ddd"), (2, ""), (3, None), (4, "x" * 25)], "doc_id long, text string")
    got = {}
    for r in sorted(chunking.recursive_chunks(d, 8, 3).collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        got.setdefault(r.doc_id, []).append(r.chunk_text)
    assert got[1] == ["aaa bbb", "ccc ddd"] and set(got) == {1, 4}
    assert all(len(c) <= 8 for c in got[4]) and got[4][0] == "x" * 8


def test_even_parts(spark):
    assert one(spark, "abcdefghij", lambda c: chunking.even_parts(c, 4)) == ["abcd", "efgh", "ij"]
    assert one(spark, "", lambda c: chunking.even_parts(c, 4)) == []


def hits(spark, rows):
    return spark.createDataFrame([("q", i + 1, *r) for i, r in enumerate(rows)], "query_id string, pos int, chunk_id string, score double, role string, parent_key string, child_key string")


def test_rerank_guards_and_ties(spark):
    few = hits(spark, [("a", 0.1, "parent", "p", None), ("a", 0.2, "child", "p", "c")])
    assert [(r.chunk_id, r["rank"], r.effective_top_k) for r in rerank.hierarchical(few, 30).orderBy("rank").collect()] == [("a", 1, 2), ("a", 2, 2)]
    equal = hits(spark, [(f"k{i}", 1.0, "", None, None) for i in range(6)])
    assert rerank.hierarchical(equal, 30).count() == 0  # nothing is over the average
    kept = rerank.hierarchical(equal, 30, cut_at_average=False).orderBy("rank").collect()
    assert [r.chunk_id for r in kept] == ["k0", "k1", "k2", "k3"]


def test_orphans(spark):
    rows = hits(spark, [("a", 0.3, "parent", "p", None), ("b", 0.9, "grandchild", "p", "c"), ("c", 0.8, "grandchild", None, "d"), ("d", 0.5, "grandchild", "x", "e")])
    got = {r.chunk_id: r.score for r in rerank.orphans_to_parents(rows).collect()}
    assert got == {"a": 0.9, "d": 0.5}  # a null parent key goes as soon as another group exists


def test_promotion_needs_enough_givers(spark):
    rows = hits(spark, [("a", 0.3, "parent", "p", None), ("b", 0.9, "child", "p", "c"), ("c", 0.2, "parent", "p", None)])
    assert rerank.promoted(rows, "parent_key", "child", "parent", 2).count() == 3
    got = {r.chunk_id: r.score for r in rerank.promoted(rows, "parent_key", "child", "parent", 1).collect()}
    assert got == {"a": 0.9, "c": 0.2}


def test_vector_search_equals_the_plain_form(spark):
    v = spark.createDataFrame([(i, [float(i % 5), float(i // 5)]) for i in range(40)] + [(99, None)], "record_id long, embedding array<float>")
    q = v.where("record_id < 7").withColumnRenamed("record_id", "query_id")
    got = {(r.query_id, r.record_id): r.distance for r in search.vector_top_k(q, v, 6, block=4).collect()}
    x = q.alias("q").crossJoin(v.where("embedding IS NOT NULL").alias("v")).select("query_id", "record_id", search.squared_distance(F.col("q.embedding"), F.col("v.embedding")).alias("d"))
    plain = {}
    for r in sorted(x.collect(), key=lambda r: (r.query_id, r.d, r.record_id)):
        plain.setdefault(r.query_id, []).append(r)
    assert got == {(r.query_id, r.record_id): r.d for rs in plain.values() for r in rs[:6]}
    assert search.vector_top_k(q, v, 0).count() == 0


def test_vector_search_with_many_ties(spark):
    near = [(i, [1.0, 0.5, 0.25]) for i in range(300, 0, -1)]  # equal vectors, smallest ids last
    v = spark.createDataFrame(near + [(1000, [9.0, 9.0, 9.0])], "record_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    assert sorted(r.record_id for r in search.vector_top_k(q, v, 5).collect()) == [1, 2, 3, 4, 5]
    # copies whose differences drown in the rough distances
    far = [(i, [1e8, 1e8 + 1e-6 * (i % 97), float(i == 400)]) for i in range(500)]
    v = spark.createDataFrame(far, "record_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1e8, 1e8, 0.0])], "query_id long, embedding array<double>")
    want = sorted(((x[1] - 1e8) ** 2 + x[2] ** 2, i) for i, x in far)[:5]
    assert sorted((r.distance, r.record_id) for r in search.vector_top_k(q, v, 5).collect()) == want


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("s", 1), ("t", 2)], "source string, v int")
    new = spark.createDataFrame([("s", 3)], "source string, v int")
    once = store.upserted(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, store.upserted(once, new).collect())) == [("s", 3), ("t", 2)]


RULES = "就業規則\n\n第1章 総則\n\n第1条（目的）\n1. この規則は目的を定める。\n2. 次に従う。\n3. 以上。\n\n第2条（適用）\n1. 全員に適用する。\n2. 例外はない。\n\n第2章 服務\n\n第3条（服務）\n1. 守る。\n2. 努める。\n\n第4条（休暇）\n1. 取る。\n2. 届ける。\n\n附則\nこの規則は施行する。"


def test_structure(spark):
    docs = spark.createDataFrame([(1, RULES), (2, "no heading\n\nsecond part")], "doc_id long, text string")
    c = st.candidates(docs).where("doc_id = 1").orderBy("start_char").collect()
    assert [r.heading[:3] for r in c if r.marker_type == "japanese_article"] == ["第1条", "第2条", "第3条", "第4条"]
    assert {r.marker_type for r in c} == {"japanese_chapter", "japanese_article", "numeric_dot", "appendix"}
    assert [r.value for r in c if r.marker_type == "numeric_dot"] == [1, 2, 3, 1, 2, 1, 2, 1, 2]
    chunks = st.structure_chunks(docs).orderBy("doc_id", "chunk_index").collect()
    assert [r.chunk_text for r in chunks if r.doc_id == 2] == ["# no heading\nno heading", "# no heading\nsecond part"]
    assert all(r.role == "fallback" for r in chunks if r.doc_id == 2)
    first = [r for r in chunks if r.doc_id == 1]
    assert len({r.chunk_id for r in first}) == len(first) and all(r.chunk_text.startswith("# 就業規則\n## ") for r in first)


def test_configuration(tmp_path):
    base = {f"{k}_logic_id": "Logic-01" for k in ("search", "chunking", "reranking", "tokenizer", "prompt")}
    e = config.Experiment(research_pair_id="x", top_k=4, qa_dataset="qa/a.json", document_set_id="set", embedding_provider=" Ruri ", rag_hybrid_delegate="keyword", **base)
    assert e.search_logic_id == "logic_01" and e.embedding_provider == "ruri" and e.rag_hybrid_delegate == "keyword_search"
    assert e.ingest_fingerprint() == config.with_top_k(e, 30).ingest_fingerprint()
    for wrong in ({"top_k": 0}, {"qa_dataset": "../x"}, {"document_set_id": "/x"}, {"research_pair_id": ""}, {"search_logic_id": "x"}):
        with pytest.raises(ValueError):
            config.Experiment(**{**{"research_pair_id": "x", "top_k": 4, "qa_dataset": "q", "document_set_id": "d"}, **base, **wrong})
    (tmp_path / "x.json").write_text(e.canonical(), encoding="utf-8")
    assert config.read_experiment(str(tmp_path), "x") == config.read_experiment(str(tmp_path), "other/x.json") == e
    with pytest.raises(FileNotFoundError):
        config.read_experiment(str(tmp_path), "y")


def test_files_and_questions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("text", encoding="utf-8")
    (tmp_path / "in/b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "in/c.exe").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[-1]: (r.ok, r.text) for r in src.ingest_status(src.read_files(spark, str(tmp_path / "in"))).collect()}
    assert got == {"a.txt": (True, "text"), "b.md": (False, None), "c.exe": (False, None)}
    (tmp_path / "qa.json").write_text('[{"question": "one"}, {"question": "two", "reference_answer": "x"}]')
    assert [(r.query_id, r.question) for r in src.read_questions(spark, str(tmp_path / "qa.json")).orderBy("query_id").collect()] == [(0, "one"), (1, "two")]


def test_incremental_ingest(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("first text", encoding="utf-8")
    ingest.ingest(spark, folder, out, check).awaitTermination(60)
    (tmp_path / "in/b.txt").write_text("second text", encoding="utf-8")
    ingest.ingest(spark, folder, out, check).awaitTermination(60)
    rows = ingest.latest(spark, out).collect()
    assert sorted((r.source, r.chunk_text) for r in rows) == [("uploaded/a.txt", "first text"), ("uploaded/b.txt", "second text")]
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in rows)


BROKEN = """就業規程

第1章 総則
第1条（目的）

この規程は労働基準法第89条に基づき働き方を定め
る。第2条（定義）
次のとおりとする。1. 社員とは雇用された者をいう。2. 役員とは次の者をいう。

(1) 取締役となった者

(2) 監査役となった者

3. 顧問とはそれ以外の者をいう。
第2章 服務
第3条（義務）
誠実に働く。
規律を守る。
附則
この規程は公布の日から施行する。"""


def test_broken_lines_and_whole_chunk_list(spark):
    """Worked out by hand: two sections in the first chapter, one in the second, which stands for it; items nested in items."""
    docs = spark.createDataFrame([(1, BROKEN), (2, ""), (3, None)], "doc_id long, text string")
    fixed = {r.doc_id: r.text for r in st.repaired(docs).collect()}
    assert fixed[1] == "就業規程\n\n第1章 総則\n\n第1条（目的）\nこの規程は労働基準法第89条に基づき働き方を定める。\n\n第2条（定義）\n次のとおりとする。\n1. 社員とは雇用された者をいう。\n2. 役員とは次の者をいう。\n\n(1) 取締役となった者\n(2) 監査役となった者\n\n3. 顧問とはそれ以外の者をいう。\n\n第2章 服務\n\n第3条（義務）\n誠実に働く。\n規律を守る。\n\n附則この規程は公布の日から施行する。"
    up, second = "# 就業規程\n## 第1章 総則\n", "### 第2条（定義）\n"
    third = "#### 2. 役員とは次の者をいう。\n\n- (1) 取締役となった者\n- (2) 監査役となった者"
    want = [
        ("parent", up + "### 第1条（目的）\nこの規程は労働基準法第89条に基づき働き方を定める。"),
        ("parent", up + second + "次のとおりとする。\n#### 1. 社員とは雇用された者をいう。\n" + third + "\n\n#### 3. 顧問とはそれ以外の者をいう。"),
        ("child", up + "### 第1条（目的）\nこの規程は労働基準法第89条に基づき働き方を定める。"),
        ("child", up + second + "次のとおりとする。\n#### 1. 社員とは雇用された者をいう。\n" + third),
        ("child", up + second + "次のとおりとする。\n#### 3. 顧問とはそれ以外の者をいう。"),
        ("grandchild", up + second + "#### 1. 社員とは雇用された者をいう。"),
        ("grandchild", up + second + third),
        ("grandchild", up + second + "#### 3. 顧問とはそれ以外の者をいう。"),
        ("parent", "# 就業規程\n## 第2章 服務\n### 第3条（義務）\n誠実に働く。\n規律を守る。"),
        ("parent", "# 就業規程\n## 附則この規程は公布の日から施行する。"),
    ]
    got = st.structure_chunks(docs, most=120).orderBy("chunk_index").collect()
    assert [(r.role, r.chunk_text) for r in got] == want
    assert got[8].parent_chunk_id == got[8].child_chunk_id == got[8].grandchild_chunk_id and got[0].child_chunk_id is None
    assert got[6].parent_chunk_id == got[2].parent_chunk_id and got[6].child_chunk_id == got[3].child_chunk_id and got[2].grandchild_chunk_id == got[2].chunk_id


def test_nested_items(spark):
    for items, want in (([("a", 1), ("a", 1), ("a", 2), ("a", 3), ("a", 2), ("a", 3), ("a", 4)], [0, 1, 1, 1, 0, 0, 0]), ([("a", 2), ("a", 3), ("b", 1), ("b", 2), ("a", 4), ("a", 5)], [0, 0, 1, 1, 0, 0]), ([], [])):
        df = spark.createDataFrame([(items,)], "x array<struct<type:string,value:int>>")
        assert df.select(st.nested_levels(F.col("x")).alias("d")).first().d == want


def test_vectors_of_several_lengths(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 1.0]), (4, [2.0]), (5, None)], "record_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(7, [1.0, 0.1]), (8, [1.9])], "query_id long, embedding array<double>").coalesce(1)
    assert sorted((r.query_id, r.rank, r.record_id) for r in search.vector_top_k(q, v, 3).collect()) == [(7, 1, 1), (7, 2, 3), (8, 1, 4), (8, 2, 2)]


def test_keywords_are_counted_without_overlaps(spark):
    docs = spark.createDataFrame([(1, "aaaa b"), (2, "aa"), (3, None), (4, "x" * 40 + "y")], "doc_id long, document_lower string")
    q = spark.createDataFrame([(1, ["aa"]), (2, ["x" * 40 + "?"]), (3, []), (4, ["aa", "b"])], "query_id long, tokens array<string>")
    got = sorted((r.query_id, r.rank, r.doc_id, r.keyword_score_raw) for r in search.keyword_search(q, docs, 5).collect())
    assert got == [(1, 1, 1, 2.0), (1, 2, 2, 1.0), (2, 1, 4, 0.0), (4, 1, 1, 3.0), (4, 2, 2, 1.0)]
