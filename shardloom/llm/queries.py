"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .oracles import ORACLES as ORACLES


def tokenizer_spec(name: str) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_spec("byte_bpe_50k.json"), limit=1024)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_file_digests

    return token_file_digests(table(spark, sf_dir, "documents"), tokenizer_spec("word_bpe_49k.json"), end_id=1)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_spec("byte_bpe_50k.json"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return quality_rules(table(spark, sf_dir, "documents")).select(*columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_tokens

    return best_fit_tokens(table(spark, sf_dir, "documents"), tokenizer_spec("word_bpe_49k.json"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import digests, fill_in_middle

    return digests(fill_in_middle(table(spark, sf_dir, "documents")))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import clusters

    return clusters(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_lm_scoring, op3_quality_rules, op4_token_output, op5_jaccard_join, op6_embedding_dedup, op7_best_fit_packing, op8_secret_scan, op9_quality_classifier, op10_bpe_codec, op11_fill_in_middle, op12_centroid_clustering, op13_toxicity, pipeline)}
