"""Sources: files, questions, pages, and what may be read of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = ("pdf", "txt", "md")

QA_SCHEMA = "dataset_name string, items array<struct<question:string, reference_answer:string>>"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, content of all files under a folder; none is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no files in {folder}")
    return files.select("path", "content")


def in_order(files: DataFrame) -> DataFrame:
    """path, position of files, suffixes in lower case first, then by path; contents aren't sorted along."""
    paths = files.select("path").orderBy(F.regexp_extract("path", r"\.([^./]+)$", 1).rlike("^[A-Z]+$"), "path")
    return paths.withColumn("position", F.monotonically_increasing_id())


def ingest_status(files: DataFrame) -> DataFrame:
    """path, suffix, ok, error, text: text files decoded strictly; other suffixes and broken bytes are errors of their row, not of the job. PDF files need a converter and have no text here."""
    kind = suffix(F.col("path"))
    plain = kind.isin("txt", "md")
    valid = F.is_valid_utf8(F.col("content"))
    error = F.when(~kind.isin(*SUPPORTED), F.concat(F.lit("unsupported suffix: "), kind)).when(plain & ~valid, F.lit("text is not UTF-8"))
    return files.select("path", kind.alias("suffix"), error.isNull().alias("ok"), error.alias("error"), F.when(plain & valid, F.decode("content", "UTF-8")).alias("text"))


def supported_only(files: DataFrame) -> DataFrame:
    """The files, of which one with another suffix fails the job when it is read."""
    kind = suffix(F.col("path"))
    return files.where(F.assert_true(kind.isin(*SUPPORTED), F.concat(F.lit("unsupported suffix: "), "path")).isNull())


def failed_unless_ok(status: DataFrame) -> DataFrame:
    """The rows, of which one that isn't ok fails the job when it is read."""
    return status.where(F.assert_true(F.col("ok"), F.concat_ws(": ", "path", "error")).isNull())


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """query_id, question, reference_answer, dataset_name of a JSON file: an object with ``items``, or a bare list of them."""
    raw = spark.read.text(path, wholetext=True)
    bare = F.ltrim("value").startswith("[")
    whole = F.when(bare, F.concat(F.lit('{"items":'), "value", F.lit("}"))).otherwise(F.col("value"))
    parsed = raw.select(F.from_json(whole, QA_SCHEMA, {"mode": "FAILFAST"}).alias("q"))
    return checked_questions(parsed.select("q.dataset_name", F.posexplode("q.items").alias("query_id", "item")).select("query_id", "item.question", "item.reference_answer", "dataset_name"))


def checked_questions(questions: DataFrame) -> DataFrame:
    ok = F.assert_true(F.char_length(F.coalesce("question", F.lit(""))) > 0, F.lit("a question is empty"))
    return questions.where(ok.isNull())


def needs_ocr(pages: DataFrame, least_chars: int = 50) -> DataFrame:
    """doc, pages, chars, ocr: whether a document's native text is too little, by the sum over its pages."""
    per = pages.groupBy("doc").agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.char_length(F.trim(F.coalesce("text", F.lit(""))))), F.lit(0)).alias("chars"))
    return per.withColumn("ocr", (F.col("pages") > 0) & (F.col("chars") < F.greatest(F.lit(1), F.col("pages")) * max(0, least_chars)))


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc, text: non-blank pages in order with a blank line between."""
    kept = pages.where(F.trim("text") != "")
    ordered = F.array_sort(F.collect_list(F.struct("page", F.trim("text").alias("text"))))
    return kept.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"))


def ocr_languages(c: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(c, "[+, ]+", " "), " "), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("jpn"), F.lit("eng")))
