"""A training corpus from ``documents``: classify, filter by rules, keep one of each group of near copies, mask secrets, pack.

Each stage works on all rows that the stage before it kept. Stages but the last return the columns
of their input; the last returns where each piece of each text lies.

Decisions are made by row, not by id: rows that share an id or have none, but differ in their texts,
each follow their own verdict. Texts that are null or empty fail the rules and go; an empty table
gives an empty result; other columns than doc_id and text are carried along, whatever their names.

Stages run one after the other on the same executors, so they hold little beside the JVM's heap: they leave
the session with Arrow batches of 4 MB, where it has no limit of its own, and packing forgets words after each task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import jaccard_join, packing, quality_classifier, quality_rules, secret_scan
from shardloom.llm.common import remove_at_exit, shared_dir, small_batches, staged, table
from shardloom.llm.queries import tokenizer_spec


def _keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_pipeline_hash`` of each text, which tells rows with one id, or none, apart."""
    return docs.withColumn("_pipeline_hash", F.xxhash64(F.col(text).cast("string")))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text aren't in ``gone`` (_pipeline_id, _pipeline_gone); null ids match null ids.

    Those are written first, so that Spark knows their size and sends them to all tasks only while
    they are under its limit; beyond, both sides are shuffled.
    """
    rows = staged(gone.select("_pipeline_id", "_pipeline_gone").distinct(), "pipeline-gone")
    keyed = _keyed(docs)
    same = keyed["doc_id"].eqNullSafe(F.col("_pipeline_id")) & (keyed["_pipeline_hash"] == F.col("_pipeline_gone"))
    return keyed.join(rows, same, "left_anti").drop("_pipeline_hash")


def _rejected(decided: DataFrame, kept: str) -> DataFrame:
    """Id and text hash of rows that aren't kept. A verdict depends on the text alone, so rows alike in both share it."""
    return decided.where(f"NOT ({kept})").select(F.col("doc_id").alias("_pipeline_id"), F.col("text_hash").alias("_pipeline_gone"))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good ones."""
    small_batches(spark)
    return quality_classifier.good_rows(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return _without(docs, _rejected(quality_rules.quality_rules(docs), "kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are at least 0.8 alike: that with the smallest id; a null id is the largest.

    Nodes are 64-bit hashes of id and text, so rows that share an id but not their text are decided
    each for itself; of rows alike in both, one stays. Texts without a word are in no group and all stay.
    """
    small_batches(spark)
    node = F.xxhash64("doc_id", F.col("text").cast("string"))
    names = docs.columns
    groups = jaccard_join.jaccard_groups(docs.withColumn("_pipeline_node", node), n=5, percent=80, id_col="_pipeline_node").select(F.col("doc_id").alias("_pipeline_node"), "component_id", "n_shingles")
    many = groups.where("n_shingles > 0").groupBy("_pipeline_node", "component_id").agg(F.count("*").alias("copies"))
    many = staged(many, "pipeline-groups")
    shared = many.groupBy("component_id").agg(F.count("*").alias("nodes"), F.sum("copies").alias("rows")).where("rows > 1").select("component_id", "nodes")
    members = staged(many.join(shared, "component_id").select("_pipeline_node", "component_id", "copies", "nodes"), "pipeline-members")
    ids = docs.select(node.alias("_pipeline_node"), "doc_id").join(members.where("nodes > 1"), "_pipeline_node").select("component_id", "_pipeline_node", "doc_id")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_pipeline_node")).alias("first")).select("component_id", F.col("first._pipeline_node").alias("stays"))
    gone = members.where("nodes > 1").join(first, "component_id").where("_pipeline_node <> stays").select(F.col("_pipeline_node").alias("_pipeline_gone"))
    gone = staged(gone, "pipeline-gone")
    again = staged(many.where("copies > 1").select(F.col("_pipeline_node").alias("_pipeline_again")), "pipeline-repeated")
    numbered = docs.withColumn("_pipeline_node", node)
    kept = numbered.join(gone, F.col("_pipeline_node") == F.col("_pipeline_gone"), "left_anti")
    repeated = F.col("_pipeline_node") == F.col("_pipeline_again")
    once = kept.join(again, repeated, "left_semi").dropDuplicates(["_pipeline_node"])
    return kept.join(again, repeated, "left_anti").unionByName(once).select(*[f"`{c}`" for c in names])


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the secrets in their texts masked; n_chars, where there is one, follows the text."""
    names = docs.columns
    out = secret_scan.with_spans(docs).withColumn("text", secret_scan.masked("text", "_spans")).drop("_base", "_spans")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each text lies in sequences of the permitted lengths."""
    small_batches(spark)
    return packing.best_fit_tokens(docs, tokenizer_spec("word_bpe_49k.json"), lean=True)


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("ngram_jaccard_join", one_of_each), ("secret_scans", mask), ("best_fit_packing", pack)]
#: Boosted tables, estimated rules and packing orders aren't SQL; tests hold each stage against a brute-force version of what its operator decides.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet into the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    remove_at_exit(spark, base)
    return docs
