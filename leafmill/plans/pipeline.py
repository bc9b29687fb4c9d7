"""From a folder of files to evidence for questions, each stage a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import preview, retrieved_text
from leafmill.operators import answer, expand, rerank, search
from leafmill.operators.chunker import ChunkConfig, chunk
from leafmill.operators.encode import Encoder, embedded, encoder_udf, hashing_encoder
from leafmill.operators.store import upsert
from leafmill.sources.files import ingest
from leafmill.sources.stages import read_stage, write_stage


def build(spark: SparkSession, folder: str, work: str, config: ChunkConfig | None = None, load: Callable[[], Encoder] = hashing_encoder, permissive: bool = False, reset: bool = False) -> dict[str, int]:
    """Blocks, chunks and the store of a folder's files under `work`; gives the counts of each stage."""
    write_stage(ingest(spark, folder, permissive).withColumn("ingested_at", F.current_timestamp()), f"{work}/blocks", "doc_type")
    blocks = read_stage(spark, f"{work}/blocks")
    write_stage(chunk(blocks, config), f"{work}/chunks")
    chunks = read_stage(spark, f"{work}/chunks")
    records = embedded(chunks, load).withColumns({"run_id": F.lit("build"), "embedded_at": F.current_timestamp()})
    return {"blocks": blocks.count(), "chunks": chunks.count()} | upsert(spark, f"{work}/store", records, reset)


def questions(spark: SparkSession, texts: list[str], load: Callable[[], Encoder] = hashing_encoder) -> DataFrame:
    """query_id (from 1), query and vector of a few questions."""
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id int, query string").withColumn("v", encoder_udf(load, role="query")("query"))


def retrieve(store: DataFrame, asked: DataFrame, k: int = 5, candidates: int = 25, config: rerank.RerankConfig | None = None) -> DataFrame:
    """The k best chunks of each question: nearest candidates first, then reranked by their text and metadata."""
    if k <= 0 or candidates < k:
        raise ValueError("k must be positive and at most candidates")
    near = search.top_k_batch(store.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v")), asked.select("query_id", "v"), candidates).withColumnsRenamed({"id": "chunk_id", "rank": "position", "score": "raw_score"})
    found = near.join(store.drop("embedding", "retrieval_text"), "chunk_id").join(asked.select("query_id", "query"), "query_id").withColumn("source_block_count", F.greatest(F.size("block_ids"), F.lit(1)))
    return rerank.best(rerank.rerank(found, config), k)


def results(found: DataFrame) -> DataFrame:
    """Found chunks for reading: scores with six decimals, reasons, repaired text and a preview."""
    text = retrieved_text("text", "title")
    return found.select(
        "query_id", F.col("seed").alias("place"), "chunk_id", "file_name", F.col("title").alias("section_title"), "page_number", F.bround("final_score", 6).alias("score"), F.bround("raw_score", 6).alias("raw_vector_score"),
        F.bround("rerank_delta", 6).alias("rerank_delta"), rerank.reasons("signals").alias("reasons"), text.alias("text"), preview(text).alias("preview"), F.length("text").alias("chunk_length"),
    )


def evidence(store: DataFrame, asked: DataFrame, seeds: int = 8, candidates: int = 80, window: int = 2, most: int = 24) -> DataFrame:
    """Seeds of each question with the context around them, with texts, in reading order."""
    titled = store.withColumn("title", rerank.section_title_of(F.col("section_title"), F.col("heading"), F.col("section_key")))
    got = expand.expanded(retrieve(store, asked, seeds, candidates), titled, window, most)
    return got.join(titled.select("chunk_id", F.col("title").alias("section_title"), "page_number", retrieved_text("text", "title").alias("text")), "chunk_id").withColumn("preview", preview("text"))


def ask(store: DataFrame, asked: DataFrame, load: Callable[[], Callable[[str], str]], **limits: int) -> DataFrame:
    """query_id and answer of each question, from its evidence and a text generator."""
    return answer.answers(answer.prompts(asked.select("query_id", "query"), answer.citations(evidence(store, asked, **limits))), load)
