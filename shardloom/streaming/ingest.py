"""Incremental ingest: new files become chunks and vector records as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shardloom.functions.models import hashed_embedding
from shardloom.functions.text import doc_key, normalised, upload_source
from shardloom.operators.chunking import even_parts
from shardloom.sources.documents import ingest_status

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def chunk_rows(files: DataFrame, most: int = 1000, dimension: int = 16) -> DataFrame:
    """source, doc_id, chunk_index, chunk_text, embedding of the text files among ``files``; files that can't be read give nothing."""
    read = ingest_status(files).where("ok AND text IS NOT NULL")
    source = upload_source(F.col("path"))
    parts = read.select(source.alias("source"), doc_key(source).alias("doc_id"), F.posexplode(even_parts(normalised(F.col("text")), most)).alias("chunk_index", "chunk_text"))
    return parts.withColumn("embedding", hashed_embedding(F.col("chunk_text"), dimension))


def stream_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, records: Callable[[DataFrame], DataFrame] = chunk_rows) -> StreamingQuery:
    """Appends the records of new files to ``store`` under the number of their batch; latest() gives a source's newest ones.

    ``records`` maps files (path, content) to rows with source: an experiment's, for one, are those of
    ``lambda files: batch.ingested(e, files)``, which fails a batch that holds a file it can't read.

    A batch that is repeated after a failure replaces what it had written, so each file counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        records(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream_files(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, store: str) -> DataFrame:
    """Chunks of each source's newest batch."""
    rows = spark.read.option("basePath", store).parquet(f"{store}/batch=*")
    newest = rows.groupBy("source").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["source", "batch"], "left_semi")
