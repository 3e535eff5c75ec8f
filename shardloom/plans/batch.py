"""Batches: an experiment run over a question set, its result table and exports, and the command line."""

from __future__ import annotations

import argparse
import json
import sys
import threading
import time
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from shardloom.functions import models
from shardloom.functions import text as tx
from shardloom.functions.lineage import cut
from shardloom.operators import search, store
from shardloom.plans import experiment, registry
from shardloom.sources import config
from shardloom.sources import documents as src

# The columns of a result table, in order; four more follow for each rank.
FIXED = ("research_pair_id", "research_pair_spec", "question_index", "document_set_id", "dataset_name", "input", "llm_user_prompt", "output", "rag_latency_ms", "total_latency_ms", "top_k", "chunking_logic_id", "tokenizer_logic_id", "search_logic_id", "reranking_logic_id", "prompt_logic_id", "llm_model", "embedding_provider", "embedding_model", "ragas_faithfulness", "ragas_answer_relevancy")
RANKED = ("retrieved_source", "retrieved_chunk_id", "retrieved_distance", "retrieved_text")


def columns(top_k: int) -> list[str]:
    return [*FIXED, *(f"{c}_{i}" for i in range(1, top_k + 1) for c in RANKED)]


def numbered(rows: DataFrame, *by: str, name: str = "question_index") -> DataFrame:
    """``rows`` with numbers from 0 in the order of ``by``: counts per range of keys are added up first, so that no task ranks all. ``rows`` are written first: ranges are found by a sample, which would make them twice."""
    ranged = cut(cut(rows).repartitionByRange(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return ranged.withColumn("_inside", inside).join(offsets.drop("_n"), "_part").withColumn(name, F.col("_offset") + F.col("_inside")).drop("_part", "_offset", "_inside")


def result_table(e: config.Experiment, questions: DataFrame, hits: DataFrame, chat: Callable[[], models.Chat] = models.echo_chat, milliseconds: tuple[float, float] = (0.0, 0.0), judge: Callable[[], models.Judge] = models.overlap_judge, done=None) -> DataFrame:
    """The columns of columns(e.top_k), all text. ``questions``: query_id, question_index, question, and dataset_name where the set has one; ``hits``: those of searched().

    top_k is what reranking left, and cells of ranks beyond it are blank. A question without hits has the fixed
    reply, no prompt and no call of the model. Times are of the whole plan divided by its questions, as
    questions don't run one by one.
    """
    asked = experiment.prompts(questions.select("query_id", "question"), hits, registry.system_prompt(e.prompt_logic_id))
    answers = models.answered(asked, chat, done=done)
    if e.ragas_enabled:
        answers = models.judged(answers, judge)
    score = lambda c: F.col(c) if c in answers.columns else F.lit("")
    cells = dict(zip(RANKED, (F.col("source"), F.col("chunk_id"), experiment.significant(F.col("raw")), tx.snippet(F.col("chunk_text"))), strict=True))
    wide = hits.groupBy("query_id").agg(*[F.max(F.when(F.col("rank") == i, cell)).alias(f"{name}_{i}") for i in range(1, e.top_k + 1) for name, cell in cells.items()], F.max("effective_top_k").alias("_top_k"))
    d = questions.join(answers.drop("question"), "query_id").join(wide, "query_id", "left")
    none = registry.resolve("reranking", e.reranking_logic_id).without_hits(e.top_k)
    named = F.lit(Path(e.qa_dataset).stem)
    fixed: dict[str, Column] = {
        "research_pair_id": F.lit(e.research_pair_id),
        "research_pair_spec": F.lit(e.spec()),
        "question_index": F.col("question_index").cast("string"),
        "document_set_id": F.lit(e.document_set_id.strip()),
        "dataset_name": F.coalesce(F.nullif("dataset_name", F.lit("")), named) if "dataset_name" in questions.columns else named,
        "input": F.col("question"),
        "llm_user_prompt": F.col("prompt"),
        "output": F.col("answer"),
        "rag_latency_ms": F.lit(f"{milliseconds[0]:.3f}"),
        "total_latency_ms": F.lit(f"{milliseconds[1]:.3f}"),
        "top_k": F.coalesce("_top_k", F.lit(none)).cast("string"),
        "chunking_logic_id": F.lit(e.chunking_logic_id),
        "tokenizer_logic_id": F.lit(e.tokenizer_logic_id),
        "search_logic_id": F.lit(e.search_logic_id),
        "reranking_logic_id": F.lit(e.reranking_logic_id),
        "prompt_logic_id": F.lit(e.prompt_logic_id),
        "llm_model": F.lit(e.llm_model or ""),
        "embedding_provider": F.lit(e.embedding_provider or ""),
        "embedding_model": F.lit(e.embedding_model or ""),
        "ragas_faithfulness": score("faithfulness"),
        "ragas_answer_relevancy": score("relevancy"),
    }
    ranked = [F.coalesce(f"{c}_{i}", F.lit("")).alias(f"{c}_{i}") for i in range(1, e.top_k + 1) for c in RANKED]
    return d.select(*[fixed[c].alias(c) for c in FIXED], *ranked)


def chunked(e: config.Experiment, files: DataFrame) -> DataFrame:
    """doc_id, source, chunk_no, chunk_id, chunk_text, vector_texts and store.HIERARCHY of files (path, content), by the experiment's chunker or pipeline.

    A file of another suffix, or a text that isn't UTF-8, fails the job. Empty chunks go before chunks are numbered.
    """
    own = registry.pipeline(e.ingest_pipeline_id) if e.ingest_pipeline_id else None
    chunk = None if own and "chunking" in own.superseded else registry.chunker(e.chunking_logic_id)
    if own:
        made = own.ingest(src.supported_only(files), chunk).withColumn("doc_id", tx.doc_key(F.col("source")))
        order = ["chunk_no"]
    else:
        read = src.failed_unless_ok(src.ingest_status(files)).where("text IS NOT NULL")
        docs = cut(read.select(tx.upload_source(F.col("path")).alias("source"), tx.normalised(F.col("text")).alias("text")).withColumn("doc_id", tx.doc_key(F.col("source"))))
        made = chunk(docs.select("doc_id", "text"))
        order = [c for c in ("chunk_index", "start_char", "part", "chunk") if c in made.columns] or ["chunk_text"]
        made = (made if "chunk_text" in made.columns else made.withColumnRenamed("text", "chunk_text")).join(docs.select("doc_id", "source"), "doc_id")
    made = made.where("chunk_text <> ''").withColumn("_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)
    given = lambda c, kind: (F.col(c) if c in made.columns else F.lit(None)).cast(kind).alias(c)
    return made.select("doc_id", "source", F.col("_no").alias("chunk_no"), F.concat_ws(":", "doc_id", F.col("_no").cast("string")).alias("chunk_id"), "chunk_text", given("vector_texts", "array<struct<name:string,text:string>>"), *[given(c, "string") for c in store.HIERARCHY])


def ingested(e: config.Experiment, files: DataFrame) -> DataFrame:
    """Vector records of files: chunked() by vector text, with record_id, record_no, document_lower and embedding. record_no follows documents, chunks and texts; ties of a search go by it."""
    records = store.record_ids(store.vector_records(chunked(e, files)))
    return registry.embedding(e)(numbered(records, "doc_id", "chunk_no", "variant_no", name="record_no"), "document_lower", "document")


FOUND = "query_id long, record_no long, pos int, score double, raw double"


def found(e: config.Experiment, questions: DataFrame, records: DataFrame) -> DataFrame:
    """Hits before reranking: query_id, record_no, pos, score and raw (the distance, or how often tokens occur). Blank questions find nothing."""
    q = questions.where(tx.stripped(F.coalesce("question", F.lit(""))) != "").select("query_id", "question")
    kind = registry.search_kind(e)
    if kind == "none":
        return questions.sparkSession.createDataFrame([], FOUND)
    if kind == "keyword":
        tokens = q.select("query_id", registry.resolve("tokenizer", e.tokenizer_logic_id)(F.col("question")).alias("tokens"))
        hits = search.keyword_search(tokens, records.select(F.col("record_no").alias("doc_id"), "document_lower"), e.top_k)
        return hits.select("query_id", F.col("doc_id").alias("record_no"), F.col("rank").alias("pos"), F.col("final_score").alias("score"), F.col("keyword_score_raw").alias("raw"))
    asked = registry.embedding(e)(q, "question", "query")
    hits = search.scored_hits(search.vector_top_k(asked, records.select(F.col("record_no").alias("record_id"), "embedding"), e.top_k))
    return hits.select("query_id", F.col("record_id").alias("record_no"), F.col("rank").alias("pos"), F.col("final_score").alias("score"), F.col("distance").alias("raw"))


def searched(e: config.Experiment, questions: DataFrame, records: DataFrame) -> DataFrame:
    """Reranked hits: query_id, rank, effective_top_k, record_no, source, chunk_id, chunk_text, score, raw and store.HIERARCHY.

    Hits keep their record through reranking, so two texts of one chunk are two hits until a reranker merges them.
    """
    known = records.select("record_no", "chunk_id", *store.HIERARCHY)
    candidates = found(e, questions, records).join(known, "record_no").withColumns({"parent_key": F.col("parent_chunk_id"), "child_key": F.col("child_chunk_id")})
    ranked = registry.resolve("reranking", e.reranking_logic_id).rank(cut(candidates), e.top_k)
    kept = ranked.where(F.col("rank") <= F.col("effective_top_k")).drop("pos", "parent_key", "child_key")
    return kept.join(records.select("record_no", "source", "chunk_text"), "record_no")


def run(spark: SparkSession, e: config.Experiment, files: DataFrame | None, questions: DataFrame, records_path: str, chat: Callable[[], models.Chat] | None = None, skip_ingest: bool = False, provider: str | None = None, judge: Callable[[], models.Judge] = models.overlap_judge) -> DataFrame:
    """An experiment's result table, written once: its logic and models are checked, files are ingested to the store at ``records_path`` (a new version, or its last one used again), questions are searched and answered."""
    registry.preflight(e)
    chat = chat or models.chat_factory(provider, registry.chat_params(e))
    table = store.RecordStore(spark, records_path)
    if not skip_ingest:
        n = files.count()
        progress(0, n, e.research_pair_id, INGEST)
        table.write(ingested(e, files))
        progress(n, n, e.research_pair_id, INGEST)
    records = table.current()
    if records is None:
        raise FileNotFoundError(f"no records at {records_path}")
    order = cut(numbered(questions, "query_id"))
    n = order.count()
    began = time.monotonic()
    hits = cut(searched(e, order, records))
    each = (time.monotonic() - began) * 1000 / max(1, n)
    with Progress(spark, n, e.research_pair_id) as running:
        answers = cut(result_table(e, order, hits, chat, (each, each), judge, running.done))
    total = (time.monotonic() - began) * 1000 / max(1, n)
    return answers.withColumn("total_latency_ms", F.lit(f"{total:.3f}"))


# The formats of progress lines.
QUESTIONS = ("experiment progress", "進捗", "質問 0 件（データ行なし）")
INGEST = ("experiment ingest progress", "取り込み進捗", "ファイル 0 件（データなし）")


def progress(done: int, total: int, name: str, kind: tuple[str, str, str] = QUESTIONS) -> None:
    """A line on standard output after a mark, and on standard error."""
    title, word, none = kind
    line = f"[{name}] {word}: {done}/{total} ({100.0 * done / total:.1f}%)" if total > 0 else f"[{name}] {word}: {none}"
    print(f"# {title}: {line}", flush=True)
    print(line, file=sys.stderr, flush=True)


class Progress:
    """While a job runs, lines of how many rows its finished tasks have dealt with, from the accumulator ``done``; a last line at the end."""

    def __init__(self, spark: SparkSession, total: int, name: str, every: float = 2.0):
        self.done, self.total, self.name, self.every = spark.sparkContext.accumulator(0), total, name, every
        self._over = threading.Event()

    def _watch(self) -> None:
        shown = 0
        while not self._over.wait(self.every):
            now = min(self.done.value, self.total)  # tasks that run again count again
            if shown < now < self.total:
                shown = now
                progress(now, self.total, self.name)

    def __enter__(self) -> Progress:
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind, *_) -> None:
        self._over.set()
        self._thread.join()
        if kind is None:
            progress(self.total, self.total, self.name)


def _ordered_parts(lines: DataFrame, path: str, end: str) -> None:
    """Lines (at, value) as text files whose order by name is that of ``at``: ranges of it are written side by side."""
    lines.orderBy("at").select("value").write.mode("overwrite").option("lineSep", end).text(path)


def _csv_cell(c: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line end."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def export_csv(results: DataFrame, path: str) -> None:
    """CSV in the questions' order whose parts, put together by name, are one file: a byte-order mark and the header once, then a line for each question, all ended by CR and LF."""
    head = results.sparkSession.createDataFrame([(-1, "\ufeff" + ",".join(results.columns))], "at long, value string")
    rows = results.select(F.col("question_index").cast("long").alias("at"), F.concat_ws(",", *[_csv_cell(F.col(c)) for c in results.columns]).alias("value"))
    _ordered_parts(head.unionByName(rows), path, "\r\n")


def export_json(results: DataFrame, path: str, dataset_name: str) -> None:
    """{dataset_name, items: [{question, answer}]} as indented lines in the questions' order; parts, put together by name, are one file."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    n = results.count()
    at = F.col("question_index").cast("long")
    item = F.concat(F.lit('    {\n      "question": '), quoted("input"), F.lit(',\n      "answer": '), quoted("output"), F.lit("\n    }"), F.when(at < n - 1, F.lit(",")).otherwise(F.lit("")))
    ends = [(-1, f'{{\n  "dataset_name": {json.dumps(dataset_name, ensure_ascii=False)},\n  "items": ['), (n, "  ]\n}")] if n else [(-1, f'{{\n  "dataset_name": {json.dumps(dataset_name, ensure_ascii=False)},\n  "items": []\n}}')]
    lines = results.select(at.alias("at"), item.alias("value")).unionByName(results.sparkSession.createDataFrame(ends, "at long, value string"))
    _ordered_parts(lines, path, "\n")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Runs an experiment over a question set")
    parser.add_argument("--research-pair", required=True, help="id or file name of the configuration")
    parser.add_argument("--skip-ingest", action="store_true", help="use the records of the last run with the same ingest settings again")
    parser.add_argument("--provider", default=None, help="provider of the chat model")
    parser.add_argument("--root", default=".", help="folder with research_pairs, qa, documents and outputs")
    args = parser.parse_args(argv)
    root = Path(args.root)
    e = config.read_experiment(str(root / "research_pairs"), args.research_pair)
    spark = SparkSession.builder.appName(f"experiment {e.research_pair_id}").getOrCreate()
    questions = src.read_questions(spark, str(root / "qa" / e.qa_dataset))
    files = None if args.skip_ingest else src.read_files(spark, str(root / "documents" / e.document_set_id))
    out = run(spark, e, files, questions, str(root / "records" / e.ingest_fingerprint()), skip_ingest=args.skip_ingest, provider=args.provider)
    stem = f"{e.research_pair_id}_{datetime.now(timezone.utc).strftime('%Y%m%dT%H%M%SZ')}"
    export_json(out, str(root / "outputs" / "json" / f"{stem}.json"), Path(e.qa_dataset).stem)
    export_csv(out, path := str(root / "outputs" / "csv" / f"{stem}.csv"))
    print(path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
