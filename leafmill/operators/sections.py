"""Blocks into sections: headings, forward fill and islands along a file's blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import narrative, word_count
from leafmill.tables import clean_type, stripped, written

SPAN = 4096  # orders of a range

# Fixed values.
HEADING_TYPES = ("heading", "title", "header")
TABLE_TYPES = ("table",)
NEVER_HEADING = ("table", "row", "page_text", "document_metadata", "workbook_metadata")


def empty_path() -> Column:
    return F.array().cast("array<string>")


def prepared(blocks: DataFrame) -> DataFrame:
    """Blocks in the chunker's form: trimmed text and type, a path without blanks, order 0 for none. The latest row of
    each block_id counts; blocks without text are dropped. A block without an id has one made of its place and text, so
    only equal rows without an id count once."""
    columns = ["source_path", "doc_type", "page_number", "slide_number", "shape_index", "sheet_name", "row_number"]
    place = F.xxhash64("source_file", "doc_type", "block_type", "order", "text", *(c for c in columns if c != "doc_type"))
    own = F.concat(F.lit("unnamed_"), F.lower(F.lpad(F.hex(place), 16, "0")))
    blocks = blocks.withColumn("block_id", F.when(F.trim(F.coalesce("block_id", F.lit(""))) == "", own).otherwise(F.col("block_id")))
    once = blocks.withColumn("_n", F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc_nulls_last(F.col("ingested_at") if "ingested_at" in blocks.columns else F.lit(0)), F.xxhash64("text")))).filter("_n = 1")
    path = F.filter(F.transform(F.coalesce("section_path", empty_path()), stripped), lambda x: x != "")
    return once.select(
        F.coalesce("source_file", F.lit("")).alias("source_file"), "block_id", F.coalesce("order", F.lit(0)).alias("order"), clean_type("block_type").alias("block_type"), stripped("text").alias("text"), path.alias("path"), *columns
    ).filter("text <> ''")


def inferred_heading(block_type: Column, text: Column) -> Column:
    """A short paragraph that ends in a colon."""
    t = narrative(text)
    return t.endswith(":") & ~F.coalesce(block_type, F.lit("")).isin(*NEVER_HEADING) & (F.length(t) <= 120) & (word_count(t) <= 12)


def sections(blocks: DataFrame, heading_types: tuple[str, ...] = HEADING_TYPES, table_types: tuple[str, ...] = TABLE_TYPES) -> DataFrame:
    """Prepared blocks with is_heading, is_table, path (carried forward), section_id (from 1), part (the tables before the
    block in its section, itself included) and heading (its section's heading block, null for none).

    A section begins at a heading and where the path changes. What runs along a file is computed in two steps, so that a
    file of any length is no single task: within ranges of SPAN orders, and over the ranges, of which a file has few."""
    colon = inferred_heading(F.col("block_type"), F.col("text"))
    df = blocks.withColumn("block_type", F.when(colon, "heading").otherwise(F.col("block_type")))
    df = df.withColumns({"is_heading": F.coalesce(F.col("block_type").isin(*heading_types), F.lit(False)), "is_table": F.coalesce(F.col("block_type").isin(*table_types), F.lit(False)), "_range": F.floor(F.col("order") / SPAN)})
    df = written(df.withColumn("_own", F.when(F.size("path") > 0, F.col("path")).when(F.col("is_heading"), F.array("text"))), "prepared")
    keys, place = ["source_file", "_range"], F.struct("order", "block_id")
    inside = Window.partitionBy(*keys).orderBy("order", "block_id")
    before = Window.partitionBy("source_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))

    paths = df.groupBy(*keys).agg(F.max_by("_own", F.when(F.col("_own").isNotNull(), place)).alias("p")).select(*keys, F.last("p", ignorenulls=True).over(before).alias("_path_before"))
    df = df.join(paths, keys)
    so_far = lambda w: F.coalesce(F.last("_own", ignorenulls=True).over(w), F.col("_path_before"), empty_path())
    df = df.withColumns({"path": so_far(inside), "_previous": so_far(inside.rowsBetween(Window.unboundedPreceding, -1))})
    table = F.col("is_table").cast("int")
    df = df.withColumns({"_begins": F.col("is_heading") | (F.col("path") != F.col("_previous")), "_tables": F.sum(table).over(inside)})
    head = F.struct(F.when(F.col("is_heading"), F.struct("block_id", "block_type", "text", "order", "page_number", "slide_number", "shape_index", "sheet_name", "row_number")).alias("heading"))
    df = df.withColumn("_start", F.when(F.col("_begins"), F.struct((F.col("_tables") - table).alias("tables"), head.alias("head"))))

    ranges = df.groupBy(*keys).agg(F.sum(F.col("_begins").cast("int")).alias("begins"), F.sum(table).alias("tables"), F.max_by("_start", F.when(F.col("_begins"), place)).alias("start"))
    ranges = ranges.withColumn("_base", total("tables")).withColumn("_at", F.col("_base") + F.col("start.tables"))
    ranges = ranges.select(*keys, total("begins").alias("_sections"), F.last("start.head", ignorenulls=True).over(before).alias("_head"), (F.col("_base") - F.coalesce(F.last("_at", ignorenulls=True).over(before), F.lit(0))).alias("_open"))
    df = df.join(ranges, keys)
    start = F.last("_start", ignorenulls=True).over(inside)
    df = df.withColumns({"section_id": F.sum(F.col("_begins").cast("int")).over(inside) + F.col("_sections"), "_start": start})
    df = df.withColumns({"part": F.col("_tables") - F.coalesce(F.col("_start.tables"), -F.col("_open")), "heading": F.coalesce("_start.head", "_head")["heading"]})
    return df.select(*blocks.columns, "is_heading", "is_table", "section_id", "part", "heading")
