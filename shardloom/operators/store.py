"""The vector-record store as tables: expansion, metadata, upsert and reset."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.functions.text import record_key, stripped

#: Where a chunk stands among the sections of its document; null where a chunker doesn't say.
HIERARCHY = ("role", "parent_chunk_id", "child_chunk_id", "grandchild_chunk_id")
RESERVED = ("doc_id", "chunk_id", "source", "chunk_text")


def clean_variants(c: Column) -> Column:
    """Named texts with names and texts stripped; those without either go."""
    trimmed = F.transform(c, lambda v: F.struct(stripped(v["name"]).alias("name"), stripped(v["text"]).alias("text")))
    return F.filter(trimmed, lambda v: (v["name"] != "") & (v["text"] != ""))


def vector_records(chunks: DataFrame) -> DataFrame:
    """A row per named text of each chunk, or one named ``default`` with the chunk's text.

    ``chunks``: chunk_id, chunk_text, vector_texts array<struct<name,text>>, and others, which are kept.
    The record and variant columns are filled only for chunks with named texts.
    """
    variants = clean_variants(F.coalesce("vector_texts", F.array().cast("array<struct<name:string,text:string>>")))
    default = F.array(F.struct(F.lit("default").alias("name"), F.col("chunk_text").alias("text")))
    d = chunks.withColumn("_named", F.size(variants) > 0).withColumn("_v", F.when(F.col("_named"), variants).otherwise(default)).withColumn("_n", F.size("_v"))
    d = d.select("*", F.posexplode("_v").alias("variant_no", "_one"))
    many = F.col("_named")
    return d.withColumns(
        {
            "vector_record_id": F.when(many, record_key(F.col("chunk_id"), F.col("_one.name"))),
            "logical_chunk_id": F.when(many, F.col("chunk_id")),
            "vector_text_variant": F.when(many, F.col("_one.name")),
            "vector_text_variant_count": F.when(many, F.col("_n")),
            "document_lower": F.lower("_one.text"),
        }
    ).drop("_v", "_n", "_one", "_named", "vector_texts")


def record_ids(records: DataFrame) -> DataFrame:
    return records.withColumn("record_id", F.coalesce(F.nullif("vector_record_id", F.lit("")), "chunk_id"))


def flat_metadata(metadata: Column, schema: T.StructType) -> Column:
    """Map of a metadata struct: scalars as text, containers as JSON, nulls left out."""
    fields = []
    for f in schema.fields:
        value = metadata[f.name]
        text = F.to_json(value) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else value.cast("string")
        fields += [F.lit(f.name), text]
    return F.map_filter(F.create_map(*fields), lambda k, v: v.isNotNull())


def custom_metadata(c: Column) -> Column:
    """Without the reserved keys, which the store's own columns hold."""
    return F.map_filter(c, lambda k, v: ~k.isin(*RESERVED))


def with_reserved(c: Column, **columns: Column) -> Column:
    """Metadata in which the store's own values win."""
    own = F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v)])
    return F.map_concat(F.map_filter(c, lambda k, v: ~k.isin(*columns)), own)


def deleted_by_source(store: DataFrame, sources: DataFrame) -> DataFrame:
    return store.join(sources.select("source").distinct(), "source", "left_anti")


def upserted(store: DataFrame, new: DataFrame) -> DataFrame:
    """New rows in place of all rows of their sources."""
    return deleted_by_source(store, new).unionByName(new)


def appended_keep_first(store: DataFrame, new: DataFrame, key: str = "record_id") -> DataFrame:
    """New rows whose key the store doesn't have yet; rows that are there stay as they are."""
    return store.unionByName(new.join(store.select(key), key, "left_anti").dropDuplicates([key]))


def checked_dimension(records: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """Rows as they are; a vector of another length fails the job."""
    ok = F.assert_true(F.size(vector) == dimension, F.concat(F.lit("embedding has dimension "), F.size(vector).cast("string")))
    return records.where(ok.isNull())


def is_dimension_error(error: BaseException) -> bool:
    """Whether an error says that an embedding has another dimension than the store's."""
    text = str(error).lower()
    return "dimension" in text and "embedding" in text


class RecordStore:
    """A table of records in versions: each write makes a new folder, and a pointer is swapped when it is whole.

    Readers see the last whole version; a write that fails leaves it as it was. The version before the current one
    stays for those who still read it, older ones go. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        """Names in the pointer, the current one last."""
        where, fs = self._at("_current")
        if not fs.exists(where):
            return []
        with_lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = fs.open(where)
        try:
            return with_lines.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def _point(self, names: list[str]) -> None:
        """The pointer is written beside and renamed over the old one in one step."""
        new, fs = self._at(f"_next-{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray("\n".join(names).encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        old, _ = self._at("_current")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, old, options)

    def current(self) -> DataFrame | None:
        """The last whole version, or None."""
        names = self._versions()
        return self.spark.read.parquet(f"{self.path}/{names[-1]}") if names else None

    def write(self, records: DataFrame) -> DataFrame:
        """``records``, which may read the current version, as the new one."""
        name = f"v-{uuid.uuid4().hex}"
        place, fs = self._at(name)
        try:
            records.write.parquet(f"{self.path}/{name}")
        except BaseException:
            fs.delete(place, True)
            raise
        names = self._versions()
        self._point([*names[-1:], name])
        for gone in names[:-1]:
            fs.delete(self._at(gone)[0], True)
        return self.current()

    def reset(self) -> None:
        """No version any more; a store that isn't there is fine."""
        where, fs = self._at("")
        fs.delete(where, True)

    def replace_sources(self, new: DataFrame) -> DataFrame:
        """New rows in place of all rows of their sources."""
        was = self.current()
        return self.write(new if was is None else upserted(was, new))

    def add(self, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], reset_on_dimension: bool = True) -> DataFrame:
        """Chunks' records with their vectors, in place of those of their sources.

        ``embed`` is called once over all texts and adds ``embedding``. Vectors must have the length of those in the
        store. If they don't, or the model says so, the whole store is reset and the same rows are tried once more, so that
        only they remain; without ``reset_on_dimension``, and for any other error, the store stays as it was.
        """
        was = self.current()
        made = embed(record_ids(vector_records(chunks)))
        first = was.select(F.size("embedding").alias("n")).first() if was is not None else None
        try:
            return self.replace_sources(made if first is None else checked_dimension(made, first["n"]))
        except Exception as error:
            if not (reset_on_dimension and is_dimension_error(error)):
                raise
        self.reset()
        return self.write(embed(record_ids(vector_records(chunks))))
