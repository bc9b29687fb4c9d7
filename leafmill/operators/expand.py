"""Context around found chunks: of their section, and next to them in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_ranks(seeds: DataFrame) -> DataFrame:
    """Adds group_rank: the first seed of the query with the same source_file and title."""
    return seeds.withColumn("group_rank", F.min("seed").over(Window.partitionBy("query_id", "source_file", "title")))


def associated(seeds: DataFrame, chunks: DataFrame, window: int = 2) -> DataFrame:
    """For each seed (query_id, seed, chunk_id, source_file, title, order_start) the chunks of its file with the same title
    (case aside) or at most `window` away in order: the chunk's columns, query_id, seed, group_rank, relationship.

    An equality join on the file with the rest as a condition on it; seeds are the small side. A seed without
    source_file has no associates, and null orders are never near."""
    if window < 0:
        raise ValueError("window cannot be negative")
    s = group_ranks(seeds).filter(F.coalesce("source_file", F.lit("")) != "").select("query_id", "seed", "group_rank", F.col("source_file").alias("_file"), F.col("title").alias("_title"), F.col("order_start").alias("_order"))
    same = (F.col("_title") != "") & (F.lower("_title") == F.lower("title"))
    near = F.coalesce(F.abs(F.col("order_start") - F.col("_order")) <= window, F.lit(False))
    joined = chunks.join(s, (F.col("source_file") == F.col("_file")) & (same | near))
    return joined.withColumn("relationship", F.when(same, "same_section").otherwise("nearby_context")).drop("_file", "_title", "_order")


def expanded(seeds: DataFrame, chunks: DataFrame, window: int = 2, most: int = 24) -> DataFrame:
    """Seeds and their context for each query, each chunk once, in reading order, at most `most`: query_id, place,
    chunk_id, relationship, group_rank, file_name, order_start, score.

    A seed wins over an association, and the earliest seed's association over later ones. Associates score 0."""
    if most <= 0:
        raise ValueError("most must be positive")
    columns = ["query_id", "seed", "chunk_id", "relationship", "group_rank", "file_name", "order_start", "score"]
    own = group_ranks(seeds).withColumn("relationship", F.lit("semantic_seed")).withColumn("score", F.col("final_score")).select(*columns)
    others = associated(seeds, chunks, window).withColumn("score", F.lit(0.0)).select(*columns)
    first = Window.partitionBy("query_id", "chunk_id").orderBy(F.when(F.col("relationship") == "semantic_seed", 0).otherwise(1), "seed")
    once = own.union(others).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    order = Window.partitionBy("query_id").orderBy(
        "group_rank", F.coalesce("file_name", F.lit("")), F.coalesce("order_start", F.lit(1_000_000_000)), F.when(F.col("relationship") == "semantic_seed", 0).otherwise(1), "chunk_id"
    )
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("seed")
