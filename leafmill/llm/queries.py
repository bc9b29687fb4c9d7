"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import budget, canonical, encoding, garble, leaks, lines, neardup, neighbours, splitting
from leafmill.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _pages(s: SparkSession, d: str) -> DataFrame:
    return lines.page_texts(table(s, d, "blocks"))


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return lines.lines_to_delete(_pages(s, d)).select("block_id", F.col("line_no").cast("int").alias("line_no")).distinct()


def p1_lines(s: SparkSession, d: str) -> DataFrame:
    gone = lines.lines_to_delete(_pages(s, d))
    return gone.groupBy("source_file", "line_key").agg(F.min("line").alias("line"), F.max("n_pages").alias("n_pages"), F.max("file_pages").alias("file_pages")).drop("line_key")


def p1_clean(s: SparkSession, d: str) -> DataFrame:
    return lines.without_lines(_pages(s, d)).select("block_id", "text", "n_removed")


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunk_records").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return neighbours.found_pairs(_vectors(s, d))


def p2_neighbours(s: SparkSession, d: str) -> DataFrame:
    return neighbours.most_similar(_vectors(s, d), candidates=3000, recall=0.93).select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"), "similarity", "rank")


def p3_pieces(s: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(s, d, "blocks"), table(s, d, "chunk_limits")).dropDuplicates(["block_id", "piece_no"])


def p3_joined(s: SparkSession, d: str) -> DataFrame:
    """Of each block that is cut: a digest of its pieces put together again without their overlaps, whether all of them keep the limit, and whether their numbers have no gap."""
    limits = table(s, d, "chunk_limits").groupBy("doc_type").agg(F.min("max_chars").alias("max_chars"))
    each = p3_pieces(s, d).join(F.broadcast(limits), "doc_type").groupBy("block_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", F.expr("substring(text, overlap_chars + 1)").alias("new")))).alias("x"), F.max(F.length("text") - F.col("max_chars")).alias("over"), F.max("piece_no").alias("last"), F.count("*").alias("n"),
        F.max(F.expr("if(overlap_chars = length(text), 1, 0)")).alias("nothing_new"),
    )
    return each.select("block_id", F.md5(F.array_join(F.transform("x", lambda x: x["new"]), "")).alias("digest"), (F.col("over") <= 0).alias("within"), ((F.col("last") == F.col("n")) & (F.col("n") > 1) & (F.col("nothing_new") == 0)).alias("whole"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(table(s, d, "blocks"), table(s, d, "chunk_limits"))
    return pieces.filter("piece_no = 2").select("block_id").distinct()


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return canonical.same_look(table(s, d, "citations"), table(s, d, "blocks"))


def p4_texts(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "blocks").select(F.lit("block").alias("kind"), F.col("block_id").alias("id"), "text").dropDuplicates(["id"])
    c = table(s, d, "citations").select(F.lit("citation").alias("kind"), F.col("citation_id").cast("string").alias("id"), "text").dropDuplicates(["id"])
    return b.union(c).select("kind", "id", canonical.readable("text").alias("text"), canonical.canonical("text").alias("form"))


def p5_budget(s: SparkSession, d: str) -> DataFrame:
    return budget.budget(table(s, d, "blocks"), table(s, d, "documents"), table(s, d, "source_files"))


def p5_counts(s: SparkSession, d: str) -> DataFrame:
    b, docs = budget.with_counts(table(s, d, "blocks"), table(s, d, "documents"))
    return b.select(F.lit("block").alias("kind"), F.col("block_id").alias("id"), "n_tokens").union(docs.select(F.lit("document"), F.col("doc_id").cast("string"), "n_tokens"))


def _records(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "blocks").select(F.lit("block").alias("kind"), F.col("block_id").alias("id"), "text", "doc_type")
    return b.union(table(s, d, "chunk_records").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), F.col("retrieval_text").alias("text"), "doc_type"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(_records(s, d).filter(F.coalesce("doc_type", F.lit("")) != "xlsx"), similarity=0.6, k=3).select("rec_kind", "id_a", "id_b")


def p6_groups(s: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_records(s, d), every=True)


def p7_ids(s: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(s, d, "documents"))


def p8_found(s: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_passages(s: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(table(s, d, "documents"), table(s, d, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("n_words").alias("longest_run"))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return garble.restored(table(s, d, "documents")).select("doc_id").distinct()


def p9_texts(s: SparkSession, d: str) -> DataFrame:
    return garble.restored(table(s, d, "documents")).dropDuplicates(["doc_id"])


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_lines, p1_clean, p2_found, p2_neighbours, p3_found, p3_pieces, p3_joined, p4_found, p4_texts, p5_budget, p5_counts, p6_found, p6_groups, p7_ids, p8_found, p8_passages, p9_found, p9_texts)}
