import csv
import dataclasses
import io
import json

import pytest
from pyspark.sql import functions as F

from shardloom.functions import models
from shardloom.functions import text as tx
from shardloom.operators import store
from shardloom.plans import batch, experiment, registry
from shardloom.sources import config
from shardloom.sources import documents as src

BASE = {f"{k}_logic_id": "logic_01" for k in ("search", "reranking", "tokenizer", "chunking")}
E = config.Experiment(research_pair_id="p", prompt_logic_id="logic_05", top_k=3, qa_dataset="q.json", document_set_id="d", embedding_provider="digest", **BASE)


def put(spark, tmp_path, **texts):
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / f"{name}.txt").write_text(text, encoding="utf-8")
    return src.read_files(spark, str(tmp_path / "in"))


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions, 5)), "query_id long, question string")


def test_run_and_exports(spark, tmp_path, capsys):
    files = put(spark, tmp_path, a="plain words about holidays\n\nand more words about work", b='odd, "quoted" cells')
    q = asked(spark, "words about holidays", "  ", 'odd, "quoted"\ncells?')

    def judge():
        def one(question, answer, contexts):
            if "odd" in question:
                raise RuntimeError("the judge is down")
            return len(contexts) / 8, None

        return one

    e = dataclasses.replace(E, ragas_enabled=True)
    out = batch.run(spark, e, files, q, str(tmp_path / "records"), judge=judge)
    assert out.columns == batch.columns(3) and len(batch.FIXED) == 21
    rows = {r.question_index: r for r in out.collect()}
    assert rows["0"].retrieved_source_1 == "uploaded/a.txt" and "holidays" in rows["0"].llm_user_prompt and rows["0"].output == "words about holidays"
    assert rows["1"].llm_user_prompt == "" and rows["1"].retrieved_source_1 == "" and "見つかりません" in rows["1"].output and rows["1"].top_k == "3"
    assert (rows["0"].ragas_faithfulness, rows["0"].ragas_answer_relevancy) == ("0.250000", "")  # two contexts, no relevancy
    assert rows["1"].ragas_faithfulness == rows["2"].ragas_faithfulness == ""  # nothing to judge; the judge failed
    assert json.loads(rows["0"].research_pair_spec) == {k: getattr(e, k) for k in config.SPEC} and len(config.SPEC) == 15
    printed = capsys.readouterr()
    assert "# experiment ingest progress: [p] 取り込み進捗: 2/2 (100.0%)" in printed.out and "[p] 進捗: 3/3 (100.0%)" in printed.err

    batch.export_csv(out, str(tmp_path / "csv"))
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    held = io.StringIO()
    w = csv.DictWriter(held, fieldnames=out.columns)
    w.writeheader()
    w.writerows(rows[k].asDict() for k in sorted(rows))
    assert whole == held.getvalue().encode("utf-8-sig")
    batch.export_json(out, str(tmp_path / "json"), "q")
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "json").glob("part-*")))
    items = [{"question": rows[k].input, "answer": rows[k].output} for k in sorted(rows)]
    assert whole.decode() == json.dumps({"dataset_name": "q", "items": items}, ensure_ascii=False, indent=2) + "\n"

    again = batch.run(spark, dataclasses.replace(E, search_logic_id="logic_02", reranking_logic_id="logic_02"), None, q, str(tmp_path / "records"), skip_ingest=True)
    assert {(r.top_k, r.llm_user_prompt, r.retrieved_chunk_id_1) for r in again.collect()} == {("0", "", "")}
    with pytest.raises(LookupError):
        registry.preflight(dataclasses.replace(E, chunking_logic_id="logic_99"))
    with pytest.raises(ValueError):
        registry.preflight(dataclasses.replace(E, embedding_provider="none such"))
    with pytest.raises(FileNotFoundError):
        batch.run(spark, E, None, q, str(tmp_path / "nowhere"), skip_ingest=True)


def test_exports_of_many_questions_are_whole_in_order(spark, tmp_path):
    wide = spark.range(500).select(F.col("id").cast("string").alias("question_index"), F.concat(F.lit("qé "), "id").alias("input"), F.concat(F.lit("a,"), "id").alias("output")).repartition(7)
    batch.export_csv(wide, str(tmp_path / "csv"))
    parts = sorted((tmp_path / "csv").glob("part-*"))
    assert b"".join(p.read_bytes() for p in parts).decode("utf-8-sig").split("\r\n")[:-1] == ["question_index,input,output", *(f'{k},qé {k},"a,{k}"' for k in range(500))]
    batch.export_json(wide.where("false"), str(tmp_path / "none"), "n")
    assert json.loads(b"".join(p.read_bytes() for p in sorted((tmp_path / "none").glob("part-*")))) == {"dataset_name": "n", "items": []}


def test_search_logic_by_id():
    kinds = {k: registry.search_kind(dataclasses.replace(E, search_logic_id=k)) for k in registry.ids("search")}
    assert kinds == {"logic_01": "vector", "logic_02": "none", "logic_03": "vector"}
    assert registry.search_kind(dataclasses.replace(E, rag_hybrid_delegate="keyword")) == "keyword"


def records(spark, rows):
    made = [(k, f"t{k}", f"d:{c}", f"text {k}", role, parent, child, None, [x, 0.0]) for k, (c, role, parent, child, x) in enumerate(rows)]
    return spark.createDataFrame(made, "record_no long, source string, chunk_id string, chunk_text string, role string, parent_chunk_id string, child_chunk_id string, grandchild_chunk_id string, embedding array<float>")


def test_hits_keep_their_record_and_hierarchy(spark):
    from pyspark.sql import DataFrame

    def fixed(params):
        return lambda rows, text, kind: rows.withColumn("embedding", F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>"))

    models.register_embedding("zero", fixed)
    r = records(spark, [(0, "parent", "A", None, 3.0), (1, "child", "A", "a", 2.0), (1, "child", "A", "a", 2.5), (2, "grandchild", "A", "a", 1.0), (3, "grandchild", "A", "b", 1.5), (4, None, None, None, 9.0)])
    q = asked(spark, "anything", "")

    def got(logic, k=6) -> list:
        hits = batch.searched(dataclasses.replace(E, top_k=k, reranking_logic_id=logic, embedding_provider="zero"), q, r)
        assert isinstance(hits, DataFrame)
        return [(x.record_no, x.chunk_id, x.effective_top_k, round(x.raw, 6)) for x in hits.orderBy("rank").collect()]

    assert got("logic_01") == [(3, "d:2", 6, 1.0), (4, "d:3", 6, 2.25), (1, "d:1", 6, 4.0), (2, "d:1", 6, 6.25), (0, "d:0", 6, 9.0), (5, "d:4", 6, 81.0)]  # two texts of a chunk, a distance each
    assert [x[0] for x in got("logic_03")] == [1, 0, 5]  # the better text stands for its chunk and takes its items' score; an orphan's goes to the chapter
    assert [x[0] for x in got("logic_02")] == [1, 0]
    assert [x[0] for x in got("logic_02", 3)] == [3, 4, 1]  # under four hits nothing is done


def test_pipelines_stand_for_the_stages_they_name(spark, tmp_path):
    files = put(spark, tmp_path, a="first. second.", b="third.")

    def sentences(rows, chunk):
        assert (chunk is None) == own
        text = F.decode("content", "UTF-8")
        if chunk is not None:
            return chunk(rows.select(F.col("path").alias("doc_id"), text.alias("text"))).select(tx.upload_source(F.col("doc_id")).alias("source"), "chunk_text", F.col("chunk_index").alias("chunk_no"))
        return rows.select(tx.upload_source(F.col("path")).alias("source"), F.posexplode(F.split(text, "(?<=\\.) ")).alias("chunk_no", "chunk_text"))

    for own, want in ((True, ["first.", "second.", "third."]), (False, ["first. second.", "third."])):
        registry.register_pipeline(registry.IngestPipeline("sentences", frozenset({"chunking"} if own else set()), sentences))
        e = dataclasses.replace(E, ingest_pipeline_id="sentences", chunking_logic_id="logic_77" if own else "logic_01")
        registry.preflight(e)
        got = batch.ingested(e, files).orderBy("record_no").collect()
        assert sorted(r.chunk_text for r in got) == want and [r.record_no for r in got] == list(range(len(want)))
        assert all(r.chunk_id == f"{r.doc_id}:{r.chunk_no}" and len(r.embedding) == 64 for r in got)
    (tmp_path / "in/c.exe").write_text("x")
    with pytest.raises(Exception, match="unsupported suffix"):
        batch.ingested(e, src.read_files(spark, str(tmp_path / "in"))).collect()


def prompts(spark, n=5):
    q = asked(spark, *(f"q{k}" for k in range(n)))
    hits = q.where("question <> 'q1'").select("query_id", F.lit(1).alias("rank"), F.lit("s").alias("source"), F.lit("t").alias("chunk_text"))
    return experiment.prompts(q, hits, "be brief")


def test_chat_messages_retries_and_errors(spark, tmp_path):
    p = prompts(spark).coalesce(1)
    first = p.where("question = 'q0'").first().messages
    assert [(m.role, m.content) for m in first] == [("system", "be brief"), ("user", "コンテキスト:\n---\n出典: s\nt\n\n\n質問:\nq0")]
    calls = str(tmp_path / "calls")

    def flaky():
        def ask(batch_):
            with open(calls, "a") as f:
                f.write("x")
            with open(calls) as f:
                if len(f.read()) < 3:
                    raise OSError("busy")
            assert len(batch_) <= 2
            return [["parts ", "of ", m[-1]["content"][-2:]] for m in batch_]

        return ask

    done = spark.sparkContext.accumulator(0)
    got = {r.question: r.answer for r in models.answered(p, lambda: flaky(), size=2, retries=2, done=done).collect()}
    assert got["q3"] == "parts of q3" and got["q1"] == experiment.NO_DOCUMENTS and done.value == 5
    for bad in (lambda: lambda b: [], lambda: lambda b: 1 / 0):
        with pytest.raises(Exception, match="answers to|division"):
            models.answered(p, bad, retries=1).collect()
    odd = p.withColumn("messages", F.transform("messages", lambda m: F.struct(F.lit(" Robot").alias("role"), m["content"].alias("content"))))
    with pytest.raises(Exception, match="unknown message role"):
        models.answered(odd, models.echo_chat).collect()
    loud = p.withColumn("messages", F.transform("messages", lambda m: F.struct(F.lit(" USER ").alias("role"), m["content"].alias("content"))))
    assert {m.role for r in models.answered(loud, models.echo_chat).collect() for m in r.messages or []} == {"user"}


def test_providers():
    with pytest.raises(ValueError, match="no chat provider"):
        models.chat_factory("nobody")
    made = []
    models.register_chat(" Own ", lambda params: (made.append(params), models.echo_chat)[1])
    e = dataclasses.replace(E, llm_model="m", llm_temperature=0.5)
    assert models.chat_factory("OWN", registry.chat_params(e)) is models.echo_chat and made[0].model == "m" and made[0].temperature == 0.5


def chunks(spark, *rows):
    made = [(f"{s}:{k}", s, t, None) for k, (s, t) in enumerate(rows)]
    return spark.createDataFrame(made, "chunk_id string, source string, chunk_text string, vector_texts array<struct<name:string,text:string>>")


def test_record_store_versions(spark, tmp_path):
    table = store.RecordStore(spark, str(tmp_path / "records"))
    assert table.current() is None
    table.reset()  # one that isn't there is fine
    vectors = lambda n: lambda rows: models.embedded(rows, lambda: lambda texts: [[float(len(t))] * n for t in texts], "document_lower", n)
    table.add(chunks(spark, ("a", "one"), ("a", "two"), ("b", "three")), vectors(2))
    first = table.current()
    table.add(chunks(spark, ("a", "four")), vectors(2))
    rows = lambda df: sorted((r.source, r.chunk_text, len(r.embedding)) for r in df.collect())
    assert rows(table.current()) == [("a", "four", 2), ("b", "three", 2)]
    assert rows(first) == [("a", "one", 2), ("a", "two", 2), ("b", "three", 2)]  # those who still read the version before

    def failing(rows_):
        return models.embedded(rows_, lambda: lambda texts: 1 / 0, "document_lower", 2)

    with pytest.raises(Exception, match="division"):
        table.add(chunks(spark, ("c", "five")), failing)
    assert rows(table.current()) == [("a", "four", 2), ("b", "three", 2)]
    with pytest.raises(Exception, match="dimension"):
        table.add(chunks(spark, ("c", "five")), vectors(3), reset_on_dimension=False)
    assert rows(table.current()) == [("a", "four", 2), ("b", "three", 2)]
    table.add(chunks(spark, ("c", "five"), ("c", "six")), vectors(3))  # the whole store is reset, the new rows are there once
    assert rows(table.current()) == [("c", "five", 3), ("c", "six", 3)]
    tries = []

    def recovering(rows_):
        tries.append(1)
        return vectors(4)(rows_) if len(tries) > 1 else models.embedded(rows_, lambda: lambda texts: [[0.0]] * len(texts), "document_lower", 4)

    table.add(chunks(spark, ("d", "seven")), recovering)
    assert len(tries) == 2 and rows(table.current()) == [("d", "seven", 4)]
    assert len([p for p in (tmp_path / "records").iterdir() if p.name.startswith("v-")]) == 1


def test_named_texts_and_suffixes(spark):
    df = chunks(spark, ("a", "x")).withColumn("vector_texts", F.array(F.struct(F.lit("only one").alias("name"), F.lit("Text").alias("text"))))
    (r,) = store.record_ids(store.vector_records(df)).collect()
    assert (r.record_id, r.logical_chunk_id, r.vector_text_variant_count, r.document_lower) == ("a:0::vector::only_one", "a:0", 1, "text")
    status = src.ingest_status(spark.createDataFrame([("/x/a.TXT", b"ok"), ("/x/b.doc", b"x"), ("/x/c.md", b"\xff"), ("/x/noext", b"x")], "path string, content binary"))
    assert {(r.path[-5:], r.ok) for r in status.collect()} == {("a.TXT", True), ("b.doc", False), ("/c.md", False), ("noext", False)}


def test_ocr_languages(spark):
    rows = spark.createDataFrame([("eng+ jpn,fra",), ("  ",), ("",)], "c string").select(src.ocr_languages(F.col("c")).alias("r")).collect()
    assert [r.r for r in rows] == [["eng", "jpn", "fra"], ["jpn", "eng"], ["jpn", "eng"]]
