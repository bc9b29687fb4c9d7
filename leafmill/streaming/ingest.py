"""Incremental ingestion: new files of a folder become chunks with embeddings in the store, file by file arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators.chunker import ChunkConfig, chunk
from leafmill.operators.encode import embedded
from leafmill.operators.store import upsert


def new_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the rows of the Parquet files that arrive in a folder."""
    return spark.readStream.format("parquet").schema(schema).load(folder)


def store_blocks(blocks: DataFrame, store_path: str, checkpoint: str, config: ChunkConfig | None = None, blocks_path: str | None = None) -> StreamingQuery:
    """Chunks, embeds and stores each micro-batch of blocks.

    The blocks are kept at `blocks_path` (beside the store if none is given), by batch: a batch that is run again replaces
    its own. Files of which blocks arrive are chunked whole, from all of their blocks so far, and their chunks replace
    those that the store had of them; so a file may arrive in several batches, or again with fewer blocks in later versions of them."""
    kept = blocks_path or f"{store_path.rstrip('/')}_blocks"

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(kept)
        every = spark.read.parquet(kept)
        files = every.filter(F.col("_batch") == number).select(F.coalesce("source_file", F.lit("")).alias("_file")).distinct()
        whole = every.join(files, F.coalesce("source_file", F.lit("")) == F.col("_file"), "left_semi").drop("_batch")
        records = embedded(chunk(whole, config)).withColumns({"run_id": F.lit(f"stream_{number}"), "embedded_at": F.current_timestamp()})
        upsert(spark, store_path, records, whole_files=True)

    return blocks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def blocks_per_hour(blocks: DataFrame, late: str = "2 hours") -> DataFrame:
    """Blocks by doc_type and hour of ingestion, each block once; rows later than `late` are dropped by the watermark."""
    once = blocks.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["block_id"])
    return once.groupBy(F.window("ingested_at", "1 hour").alias("hour"), "doc_type").agg(F.count("*").alias("n_blocks"))
