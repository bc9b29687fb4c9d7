"""Lines that one source repeats on many of its pages.

Every line of a source has a bitmap of the pages it stands on. The bitmaps are compressed by leaving out empty
words: a row (source_file, line, word) holds the 64 pages of one word, so no row and no group grows with the
number of pages, and a source with a third of all pages spreads over its lines and words. Variants of a line
(other digits, punctuation, spacing or case) have the same letters; their bitmaps are united with bit_or, the
cardinality is exact, and a page's line is deleted when its own bit is set in the bitmap of a repeated line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.tables import clean_type

MIN_PAGES = 5
MIN_SHARE_PERCENT = 30


def page_texts(blocks: DataFrame) -> DataFrame:
    """The page_text blocks of pdf files."""
    return blocks.filter((F.col("doc_type") == "pdf") & (clean_type("block_type") == "page_text"))


def page_lines(pages: DataFrame) -> DataFrame:
    """One row per line with letters: block_id, source_file, line_no, line, line_key, word, bit.

    A null text has no line. A null page number has no bit; its word is -1."""
    return (
        pages.filter(F.col("text").isNotNull())
        .select("block_id", "source_file", "page_number", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .withColumn("letters", F.regexp_replace(F.lower("line"), r"[^\p{L}]", ""))
        .filter("letters <> ''")
        .select(
            "block_id",
            "source_file",
            (F.col("at") + 1).alias("line_no"),
            "line",
            F.xxhash64("letters", F.length("letters")).alias("line_key"),
            F.coalesce(F.shiftright("page_number", 6), F.lit(-1)).alias("word"),
            F.coalesce(F.expr("shiftleft(1L, page_number & 63)"), F.lit(0).cast("long")).alias("bit"),
        )
    )


def line_bitmaps(lines: DataFrame) -> DataFrame:
    """The bitmap of each line as it is written: source_file, line_key, variant, word, bits."""
    return lines.groupBy("source_file", "line_key", F.xxhash64("line").alias("variant"), "word").agg(F.bit_or("bit").alias("bits"))


def union_variants(bitmaps: DataFrame) -> DataFrame:
    """The bitmap of each line by its letters: source_file, line_key, word, bits."""
    return bitmaps.groupBy("source_file", "line_key", "word").agg(F.bit_or("bits").alias("bits"))


def source_pages(pages: DataFrame) -> DataFrame:
    """source_file and its number of distinct page numbers."""
    words = (
        pages.filter(F.col("page_number").isNotNull())
        .groupBy("source_file", F.shiftright("page_number", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, page_number & 63)")).alias("bits"))
    )
    return words.groupBy("source_file").agg(F.sum(F.bit_count("bits")).alias("file_pages"))


def repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES, min_share_percent: int = MIN_SHARE_PERCENT) -> DataFrame:
    """The lines on at least `min_pages` and `min_share_percent` of their source's pages: source_file, line_key, n_pages, file_pages, and bitmap rows (word, bits)."""
    united = union_variants(line_bitmaps(page_lines(pages)))
    often = united.groupBy("source_file", "line_key").agg(F.sum(F.bit_count("bits")).alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    sizes = source_pages(pages).withColumnRenamed("source_file", "of")
    repeated = often.join(sizes, often.source_file.eqNullSafe(sizes.of)).filter(F.col("n_pages") * 100 >= F.col("file_pages") * min_share_percent).drop("of")
    r = repeated.withColumnsRenamed({"source_file": "of", "line_key": "of_key"})
    return united.join(r, united.source_file.eqNullSafe(r.of) & (united.line_key == r.of_key)).drop("of", "of_key")


def lines_to_delete(pages: DataFrame, **limits: int) -> DataFrame:
    """Each line that its source repeats: block_id, line_no, source_file, line, line_key, n_pages, file_pages.

    Looked up by bitmap: the line's word must be among the repeated line's words with the page's bit set. A line
    of a page without number counts as repeated if its letters are (its word is -1). Rows of a repeated block are
    found once for each row; callers take the distinct ones."""
    lines = page_lines(pages)
    m = repeated_lines(pages, **limits).withColumnsRenamed({"source_file": "of", "line_key": "of_key", "word": "of_word"})
    hit = lines.join(m, lines.source_file.eqNullSafe(m.of) & (lines.line_key == m.of_key) & (lines.word == m.of_word))
    return hit.filter((F.col("bit") == 0) | (F.col("bits").bitwiseAND(F.col("bit")) != 0)).select("block_id", "line_no", "source_file", "line", "line_key", "n_pages", "file_pages")


def without_lines(pages: DataFrame, **limits: int) -> DataFrame:
    """Each page text without the repeated lines: block_id, source_file, page_number, text, n_removed.

    A null text stays null, and a text of which every line goes becomes empty. Rows of a repeated block count once."""
    gone = lines_to_delete(pages, **limits).groupBy("block_id").agg(F.collect_set("line_no").alias("gone"))
    once = pages.select("block_id", "source_file", "page_number", "text").dropDuplicates(["block_id"])
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.coalesce(F.array_contains("gone", i + 1), F.lit(False)))
    return once.join(gone, "block_id", "left").select(
        "block_id", "source_file", "page_number",
        F.when(F.col("text").isNotNull(), F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
    )
