"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java/RE2/Python class of the six ASCII white-space characters; a word is a run of anything else.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters for Python's split; bytes.split() without argument splits on exactly these.
UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, unchanged case. bytes.split() splits on the six ASCII spaces only."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; other letters stay as they are."""
    return text.encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    It is the one named in ``spark.checkpoint.dir``; where that is unset, a local master (tests) gets a
    temporary folder of this machine, and any other is an error.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shardloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; a folder stays behind, no result is lost
            pass

    atexit.register(remove)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """Writes ``df`` once into the shared folder and reads it back, which cuts its lineage; also gives the place.

    The table survives the loss of executors. It is removed when the driver ends, if not before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """written() without the place."""
    return written(df, name, partition_by)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Removes a table of written() that nothing reads any more, so that rounds don't add up on disk."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; extra columns never reach it."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(n).to_pylist() for n in names]


def in_slices(batches, rows: int = 512):
    """Slices of record batches, at most ``rows`` rows each: what a task makes of a slice in Python stays small, however many texts a batch holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on this session's Arrow batches end at ``most`` bytes, where the user hasn't set a limit: each running task holds a batch or two beside
    the JVM's heap, and as much in its Python worker, and 10,000 texts are 20 MB and more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, most)


def sized_batches(rows, schema: pa.Schema, limit: int = 4096):
    """Record batches from an iterator of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def partitions_for(rows: int, rows_each: int) -> int:
    """Partitions so that each holds about ``rows_each`` rows; grows with the input, has no upper limit."""
    return max(1, -(-rows // rows_each))


def most_frequent(counts: DataFrame, count_col: str, most: int) -> DataFrame:
    """The rows with the largest counts, at most ``most``, without a sort: whole classes of nearly equal counts are taken from the top while they fit.

    Only the sizes of the classes, some 3,000 numbers whatever the input, go through the driver.
    """
    kind = F.floor(F.log(F.col(count_col).cast("double")) * 64).cast("int")
    sizes = sorted(((r["kind"], r["count"]) for r in counts.groupBy(kind.alias("kind")).count().collect()), reverse=True)
    taken, least = 0, None
    for k, size in sizes:
        if taken + size > most:
            break
        taken, least = taken + size, k
    return counts.where(kind >= least) if least is not None else counts.where(F.lit(False))
