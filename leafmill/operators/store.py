"""The store of embedded chunks: a table with one row per chunk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.vectors import usable
from leafmill.tables import stripped, written

BUCKETS = 64  # partitions of a store
BUCKET = "_bucket"


def valid(records: DataFrame) -> DataFrame:
    """Records with a vector: not null, not empty, no null or NaN element."""
    return records.filter(usable("embedding"))


def with_ids(records: DataFrame) -> DataFrame:
    """Blank chunk_ids replaced by the file and the record's number among the file's records without one, from 0."""
    blank = F.coalesce(stripped(F.col("chunk_id")), F.lit("")) == ""
    file = F.coalesce(F.nullif("source_file", F.lit("")), F.nullif("file_name", F.lit("")), F.lit("unknown"))
    n = F.row_number().over(Window.partitionBy(file, blank).orderBy("embedded_at", "order_start", "text")) - 1
    return records.withColumn("chunk_id", F.when(blank, F.concat(file, F.lit("::record_"), F.format_string("%06d", n))).otherwise(stripped(F.col("chunk_id"))))


def latest(records: DataFrame, key: str = "chunk_id", time: str = "embedded_at") -> DataFrame:
    """The latest row of each key; of rows of one time, that with the smaller content hash. Null keys are one key."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(time), F.xxhash64(*[c for c, t in records.dtypes if not t.startswith("map")]))
    return records.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def json_text(values: Column | str) -> Column:
    """A list as JSON text, with a space after each comma; null for null."""
    one = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"(?s)\A\[|\]\z", "")
    v = F.col(values) if isinstance(values, str) else values
    return F.when(v.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(v, one), ", ", "null"), F.lit("]")))


def document(retrieval_text: Column | str = "retrieval_text", text: Column | str = "text") -> Column:
    """The stored text of a record: its retrieval text, or its text where there is none."""
    return stripped(F.coalesce(F.nullif(retrieval_text, F.lit("")), F.nullif(text, F.lit("")), F.lit("")))


def metadata(records: DataFrame, runs: DataFrame) -> DataFrame:
    """The stored document and metadata of each record: fallbacks for names and titles, empty strings as null, lists as JSON, run facts joined."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    r = runs.select("run_id", F.col("source_path").alias("embedding_source_path"), F.col("model.name").alias("embedding_model"), F.col("model.normalized_embeddings").alias("normalized_embeddings")).dropDuplicates(["run_id"])
    return records.join(r, "run_id", "left").select(
        "chunk_id", F.coalesce(blank("file_name"), blank("source_file")).alias("file_name"), blank("source_file").alias("source_file"), blank("source_path").alias("source_path"),
        "doc_type", "chunk_type", F.coalesce(blank("section_title"), blank("heading"), blank("section_key")).alias("section_title"), blank("section_key").alias("section_key"), blank("heading").alias("heading"),
        "page_number", "order_start", "order_end", "char_count", "embedding_source_path", "embedding_model", "normalized_embeddings",
        *(json_text(c).alias(c) for c in ("section_path", "page_numbers", "slide_numbers", "block_ids", "block_types")), document().alias("document"),
    )


def model_name(runs: DataFrame, default: str) -> str:
    """The name of the latest run's model that has one, to encode questions with; `default` if none has."""
    found = runs.select(F.col("model.name").alias("name"), "created_at").filter(stripped(F.coalesce("name", F.lit(""))) != "").orderBy(F.desc_nulls_last("created_at"), "name").first()
    return found.name.strip() if found else default


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The records of the store at `path`; an error where there is none."""
    try:
        return spark.read.parquet(path).filter("chunk_id IS NOT NULL").drop(BUCKET)
    except AnalysisException as e:
        raise ValueError(f"no store at {path}") from e


def upsert(spark: SparkSession, path: str, records: DataFrame, reset: bool = False, whole_files: bool = False) -> dict[str, int]:
    """Stores records at `path`: rows of known chunk_ids are replaced, others added; with `reset` only these stay. With
    `whole_files` the records are all there is of their source_files: other rows of these go.

    The store is partitioned by a hash of chunk_id. The records are computed once, into the shared folder; of the store
    only touched partitions are read, and replaced when their new rows are written whole. Returns records_seen and
    records_stored."""
    batch = written(records.withColumn("_usable", usable("embedding")), "batch")
    fresh = written(latest(with_ids(batch.filter("_usable").drop("_usable"))).withColumn(BUCKET, F.pmod(F.xxhash64("chunk_id"), F.lit(BUCKETS)).cast("int")), "fresh")
    try:
        old = None if reset else spark.read.parquet(path)
    except AnalysisException:  # the first records
        old = None
    new = fresh
    if old is not None:
        touched = fresh.select(BUCKET)
        if whole_files:
            files = batch.select("source_file").distinct()
            touched = touched.union(old.join(files, "source_file", "left_semi").select(BUCKET))
            old = old.join(files, "source_file", "left_anti")
        touched = written(touched.distinct(), "touched")  # at most BUCKETS numbers
        kept = old.filter("chunk_id IS NOT NULL").join(F.broadcast(touched), BUCKET, "left_semi").join(fresh.select("chunk_id"), "chunk_id", "left_anti")
        new = written(kept.unionByName(fresh, allowMissingColumns=True), "store")
        emptied = touched.join(new.select(BUCKET).distinct(), BUCKET, "left_anti")  # a row without chunk_id replaces what a partition held
        new = new.unionByName(emptied, allowMissingColumns=True)
    w = new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "static" if old is None else "dynamic")
    w.partitionBy(BUCKET).parquet(path)
    return {"records_seen": batch.count(), "records_stored": fresh.count()}
