"""One plan for a whole question set: prompts, results and their export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.functions import models
from shardloom.functions.text import snippet

NO_DOCUMENTS = "参照ドキュメントから該当箇所が見つかりませんでした。"  # a fixed value


def contexts(hits: DataFrame) -> DataFrame:
    """query_id, n_hits, context: a block for each hit in the order of ranks. ``hits``: query_id, rank, source, chunk_text."""
    block = F.concat(F.lit("---\n出典: "), "source", F.lit("\n"), "chunk_text", F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.array_join(F.transform(ordered, lambda b: b["block"]), "\n").alias("context"))


def prompts(questions: DataFrame, hits: DataFrame, system: str | None = None) -> DataFrame:
    """query_id, question, n_hits, prompt, answer: a question without hits has the fixed reply and no prompt.

    With a ``system`` prompt also messages, which are null without hits, and contexts, the hits' texts in order.
    """
    blocks = contexts(hits)
    if system is not None:
        texts = F.array_sort(F.collect_list(F.struct("rank", "chunk_text")))
        blocks = blocks.join(hits.groupBy("query_id").agg(F.transform(texts, lambda h: h["chunk_text"]).alias("contexts")), "query_id")
    d = questions.join(blocks, "query_id", "left")
    found = F.col("n_hits") > 0
    text = F.concat(F.lit("コンテキスト:\n"), "context", F.lit("\n\n質問:\n"), "question")
    out = ["query_id", "question", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce(F.when(found, text), F.lit("")).alias("prompt"), F.when(found, F.lit(None).cast("string")).otherwise(F.lit(NO_DOCUMENTS)).alias("answer")]
    if system is not None:
        out += [F.when(found, models.messages(system=F.lit(system), user=text)).alias("messages"), "contexts"]
    return d.select(*out)


def significant(x: Column, digits: int = 8) -> Column:
    """A number as text with so many significant digits and no zeros at the end, with a power of ten where it is under 0.0001 or too long."""
    x = x.cast("double")
    short = F.format_string(f"%.{digits - 1}e", x)
    power = F.split_part(short, F.lit("e"), F.lit(-1)).cast("int")
    plain = lambda s: F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    fixed = F.coalesce(*[F.when(power == k, plain(F.format_string(f"%.{digits - 1 - k}f", x))) for k in range(-4, digits)])
    return F.when(x == 0, F.lit("0")).otherwise(F.coalesce(fixed, F.concat(plain(F.split_part(short, F.lit("e"), F.lit(1))), F.lit("e"), F.split_part(short, F.lit("e"), F.lit(-1)))))


def result_table(hits: DataFrame, top_k: int) -> DataFrame:
    """A row per query with source, chunk id, distance and text of ranks 1 to ``top_k``; missing ranks are blank."""
    cells = {"retrieved_source": F.col("source"), "retrieved_chunk_id": F.col("chunk_id"), "retrieved_distance": significant(F.col("vector_score_raw") if "vector_score_raw" in hits.columns else 1.0 / (1.0 + F.least(F.lit(100.0), F.col("distance")))), "retrieved_text": snippet(F.col("chunk_text"))}
    columns = [F.coalesce(F.max(F.when(F.col("rank") == i, cell)), F.lit("")).alias(f"{name}_{i}") for i in range(1, top_k + 1) for name, cell in cells.items()]
    return hits.groupBy("query_id").agg(*columns)


def matrix(experiments: DataFrame, questions: DataFrame) -> DataFrame:
    """Every experiment with every question; which side goes to all tasks is left to Spark's own limit."""
    return questions.crossJoin(experiments)
