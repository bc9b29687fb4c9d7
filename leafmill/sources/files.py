"""Folders of office files as blocks: a binary scan, one pass over the XML, and DataFrame plans for the rest."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.text import heading_score, let, page_normal, slide_normal
from leafmill.sources.elements import FIELDS, READERS, SCHEMA
from leafmill.tables import stripped, written

# Fixed values.
HEADING_THRESHOLD = 3
SKIPPED_PLACEHOLDERS = ("dt", "ftr", "sldNum", "dgm", "obj")
SLIDE_ROW = 50_000  # EMU
NOTES_INDEX = 9999
EMPTY_NOTES = ("click to add notes", "notes")
BULLET = r"\A([•\-*–—]|\d+[.)])\s+"
BLOCK = ["block_id", "source_file", "source_path", "doc_type", "block_type", "order", "text", "section_path", "page_number", "slide_number", "shape_index", "sheet_name", "row_number", "metadata_json"]


def relative(path: Column, folder: str) -> Column:
    """The part of a path below the folder; the whole path where the folder isn't in it (as of a pattern)."""
    base = posixpath.normpath(re.sub(r"\A[a-z0-9+.-]+:(//[^/]*)?(?=/)", "", folder)).removeprefix(".").rstrip("/") + "/"
    return F.when(path.contains(base), F.substring_index(F.regexp_replace(path, F.lit(f"\\A.*?{re.escape(base)}"), F.lit("\n")), "\n", -1)).otherwise(path)


def discover(spark: SparkSession, folder: str, types: tuple[str, ...] = tuple(READERS), recursive: bool = True) -> DataFrame:
    """The files of the supported types, without lock files (~$): source_path, source_file (the path below the folder, so that
    files of one name in two folders are two), doc_type, content. Other files aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)\z", 1))
    return files.filter(kind.isin(*types) & ~name.startswith("~$")).select(F.col("path").alias("source_path"), relative(F.col("path"), folder).alias("source_file"), kind.alias("doc_type"), "content")


def elements(files: DataFrame, permissive: bool = False) -> DataFrame:
    """source_path, source_file, doc_type, error and an element's fields. A file that can't be read raises an error, or, if
    permissive, gives one row with the error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                error = None
                try:
                    found = list(READERS[r.doc_type](bytes(r.content)))
                except Exception as e:
                    if not permissive:
                        raise ValueError(f"can't read {posixpath.basename(r.source_path)}: {e}") from e
                    found, error = [{}], f"{type(e).__name__}: {e}"
                rows = [{**dict.fromkeys(FIELDS), **x, "n": n} for n, x in enumerate(found)]
                out = pd.DataFrame(rows, columns=FIELDS).astype(object)
                out = out.where(out.notna(), None)
                yield pd.DataFrame({"source_path": r.source_path, "source_file": r.source_file, "doc_type": r.doc_type, "error": error}, index=out.index).join(out)

    return files.mapInPandas(read, f"source_path string, source_file string, doc_type string, error string, {SCHEMA}")


def _finish(df: DataFrame, sort: list[str]) -> DataFrame:
    """Numbers the blocks of each file and gives ids where there are none: a hash of the path and the number."""
    order = F.row_number().over(Window.partitionBy("source_path").orderBy(*sort))
    df = df.withColumn("order", order)
    for c, kind in (("page_number", "int"), ("slide_number", "int"), ("shape_index", "int"), ("sheet_name", "string"), ("row_number", "int"), ("metadata_json", "string"), ("block_id", "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    own = F.concat("doc_type", F.lit("_"), F.substring(F.sha2(F.concat_ws("|", "source_path", F.col("order").cast("string")), 256), 1, 12))
    return df.withColumn("block_id", F.coalesce("block_id", own)).select(*BLOCK)


def _cells(row: Column) -> Column:
    return F.transform(row, lambda c: stripped(F.coalesce(c, F.lit(""))))


def rows_to_text(rows: Column, first: str = "Columns: ", glue: str = ", ") -> Column:
    """A table's rows as lines: the first names the columns, the others are numbered. Empty rows are left out."""
    full = F.filter(F.transform(rows, _cells), lambda r: F.exists(r, lambda c: c != ""))
    return F.array_join(F.transform(full, lambda r, i: F.concat(F.when(i == 0, first).otherwise(F.concat(F.lit("Row "), i.cast("string"), F.lit(": "))), F.array_join(r, glue))), "\n")


def docx_blocks(found: DataFrame) -> DataFrame:
    """Headings (by score), paragraphs and tables, each under the heading that runs there."""
    text = F.when(F.col("kind") == "table", rows_to_text(F.col("rows"))).otherwise(stripped(F.coalesce("text", F.lit(""))))
    df = found.filter("doc_type = 'docx' AND error IS NULL").withColumn("text", text).filter("text <> ''")
    score = heading_score("text", F.coalesce("bold", F.lit(False)), "style")
    df = df.withColumn("score", F.when(F.col("kind") == "paragraph", score))
    df = df.withColumn("block_type", F.when(F.col("kind") == "table", "table").when(F.col("score") >= HEADING_THRESHOLD, "heading").otherwise("paragraph"))
    w = Window.partitionBy("source_path").orderBy("n")
    section = F.last(F.when(F.col("block_type") == "heading", F.col("text")), ignorenulls=True).over(w)
    df = df.withColumn("section_path", F.when(section.isNull(), F.array().cast("array<string>")).otherwise(F.array(section)))
    facts = F.to_json(F.struct(F.col("style").alias("style_name"), F.col("score").alias("heading_score"), F.size("rows").alias("row_count")))
    return _finish(df.withColumn("metadata_json", facts), ["n"])


def pptx_blocks(found: DataFrame, skip: tuple[str, ...] = SKIPPED_PLACEHOLDERS) -> DataFrame:
    """Titles, texts, bullets, tables, images and notes, shapes of a slide in the order in which they are seen."""
    df = found.filter("doc_type = 'pptx' AND error IS NULL").withColumn("is_title", F.coalesce(F.col("placeholder").isin("title", "ctrTitle"), F.lit(False)) | F.lower(F.coalesce("name", F.lit(""))).contains("title"))
    seen = Window.partitionBy("source_path", "slide").orderBy(F.bround(F.col("top") / SLIDE_ROW), "left", "top", "n")
    shapes = df.filter("kind <> 'notes'").withColumn("shape_index", F.row_number().over(seen)).filter(~F.coalesce(F.col("placeholder").isin(*skip), F.lit(False)))
    lines = F.filter(F.transform(F.coalesce("paragraphs", F.array().cast("array<struct<level:int,text:string>>")), lambda p: F.struct(p["level"].alias("level"), slide_normal(p["text"]).alias("text"))), lambda p: p["text"] != "")
    bullet = lambda p: (p["level"] > 0) | p["text"].rlike(BULLET)
    plain = lambda xs: F.array_join(F.transform(xs, lambda p: p["text"]), "\n")
    body_type = F.when(F.lower(F.coalesce("name", F.lit(""))).contains("callout"), "callout").when(F.coalesce(F.col("placeholder") == "subTitle", F.lit(False)), "subtitle").otherwise("text")
    table = F.array_join(F.filter(F.transform(F.transform("rows", lambda r: F.transform(r, slide_normal)), lambda r: F.when(F.exists(r, lambda c: c != ""), F.array_join(r, " | "))), lambda x: x.isNotNull()), "\n")
    part = lambda kind, text, suffix: F.struct(kind.alias("block_type") if isinstance(kind, Column) else F.lit(kind).alias("block_type"), text.alias("text"), suffix.alias("suffix"))
    texts = lines
    parts = (
        F.when(F.col("kind") == "table", F.array(part("table", table, F.lit(""))))
        .when(F.col("kind") == "picture", F.array(part("image", F.lit("[image]"), F.lit(""))))
        .when(F.col("is_title"), F.array(part("title", plain(texts), F.lit("::title"))))
        .otherwise(F.array(
            part(body_type, plain(F.filter(texts, lambda p: ~bullet(p))), F.concat(F.lit("::"), body_type)),
            part("bullet", F.array_join(F.transform(F.filter(texts, bullet), lambda p: F.concat(F.repeat(F.lit("  "), p["level"]), p["text"])), "\n"), F.lit("::bullets")),
        ))
    )
    named = F.coalesce(F.col("placeholder").isin("title", "ctrTitle"), F.lit(False))
    title = F.first(F.when(named & (F.size(lines) > 0), plain(lines)), ignorenulls=True).over(Window.partitionBy("source_path", "slide").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shapes = shapes.withColumn("hint", title).select("*", F.posexplode(parts).alias("pos", "b"))
    shapes = shapes.select("source_path", "source_file", "doc_type", "slide", "shape_index", "pos", "hint", F.col("b.block_type").alias("block_type"), F.col("b.text").alias("text"), F.col("b.suffix").alias("suffix"),
                           F.to_json(F.struct("name", F.col("placeholder").alias("placeholder_type"), "shape_path", "parent_group", "top", "left")).alias("metadata_json")).filter("text <> ''")
    hints = shapes.filter("hint IS NOT NULL").groupBy("source_path", "slide").agg(F.first("hint").alias("hint"))
    notes = df.filter("kind = 'notes'").withColumn("text", slide_normal("text")).filter(~F.col("text").rlike(r"\A\d*\z") & ~F.lower("text").isin(*EMPTY_NOTES)).groupBy("source_path", "source_file", "doc_type", "slide").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("text"))
    notes = notes.join(hints, ["source_path", "slide"], "left").withColumns({"shape_index": F.lit(NOTES_INDEX), "pos": F.lit(0), "block_type": F.lit("notes"), "suffix": F.lit(""), "metadata_json": F.lit(None).cast("string")})
    both = shapes.unionByName(notes)
    place = F.when(F.col("block_type") == "notes", "notes").otherwise(F.concat(F.lit("shape_"), F.col("shape_index").cast("string"), "suffix"))
    both = both.withColumns({
        "block_id": F.concat_ws("::", "source_file", F.concat(F.lit("slide_"), F.col("slide").cast("string")), place),
        "section_path": F.filter(F.array("hint"), lambda x: x.isNotNull()),
        "slide_number": F.col("slide"),
    })
    return _finish(both, ["slide", "shape_index", "pos"])


def column_letter(n: Column) -> Column:
    """1 as A, 27 as AA; up to three letters."""
    at = lambda x: F.chr((x % 26) + 65)
    x, y = n - 1, F.floor((n - 1) / 26) - 1
    z = F.floor(y / 26) - 1
    return F.concat(F.when(z >= 0, at(z)).otherwise(""), F.when(y >= 0, at(y)).otherwise(""), at(x))


def labels(cells: Column) -> Column:
    """The labels of header cells: blank ones are their column's letter, and the n-th of a name is "name (n)"."""
    named = F.transform(cells, lambda x, i: F.when(stripped(F.coalesce(x, F.lit(""))) == "", column_letter(i + 1)).otherwise(stripped(x)))
    nth = lambda all_, x, i: F.size(F.filter(F.slice(all_, F.lit(1), i + 1), lambda y: y == x))
    numbered = lambda x, n: F.when(n == 1, x).otherwise(F.concat(x, F.lit(" ("), n.cast("string"), F.lit(")")))
    return let(named, lambda all_: F.transform(all_, lambda x, i: numbered(x, nth(all_, x, i))))


def xlsx_blocks(found: DataFrame) -> DataFrame:
    """Workbook facts, and of each sheet a summary, the header (its first row with content) and the rows under its labels."""
    df = found.filter("doc_type = 'xlsx' AND error IS NULL")
    keys = ["source_path", "source_file", "doc_type"]
    rows = df.filter("kind = 'row'").withColumn("is_header", F.row_number().over(Window.partitionBy("source_path", "sheet_index").orderBy("row")) == 1)
    head = rows.filter("is_header").select("source_path", "sheet_index", F.map_from_arrays(F.transform("cells", lambda c: c["col"]), labels(F.transform("cells", lambda c: c["value"]))).alias("labels"))
    size = rows.groupBy("source_path", "sheet_index").agg(F.count("*").alias("n_rows"), F.max("row").alias("last_row"), F.max(F.array_max(F.transform("cells", lambda c: c["col"]))).alias("last_col"))
    base = [*keys, "sheet", "sheet_index"]
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit(0)).cast("string"))
    summary = df.filter("kind = 'sheet'").join(size, ["source_path", "sheet_index"], "left").select(
        *base, F.lit(-2).alias("at"), F.lit("sheet_metadata").alias("block_type"), F.lit(None).cast("int").alias("row_number"), F.col("facts").alias("metadata_json"),
        F.concat_ws("\n", F.concat(F.lit("Sheet: "), "sheet"), line("Rows With Content", F.col("n_rows")), line("Data Rows", F.greatest(F.coalesce("n_rows", F.lit(0)) - 1, F.lit(0))), line("Worksheet Max Row", F.col("last_row")), line("Worksheet Max Column", F.col("last_col")), line("Max Populated Column Index", F.col("last_col"))).alias("text"),
    )
    of_rows = rows.join(head, ["source_path", "sheet_index"])
    header = of_rows.filter("is_header").select(*base, F.lit(-1).alias("at"), F.lit("header").alias("block_type"), F.col("row").alias("row_number"), F.to_json(F.struct(F.map_values("labels").alias("columns"))).alias("metadata_json"), F.concat(F.lit("Columns: "), F.array_join(F.map_values("labels"), ", ")).alias("text"))
    named = F.transform("cells", lambda c: F.concat(F.coalesce(F.try_element_at("labels", c["col"]), column_letter(c["col"])), F.lit(": "), c["value"]))
    facts = F.to_json(F.struct(F.transform("cells", lambda c: c["ref"]).alias("cell_refs"), F.size("cells").alias("non_empty_cell_count"), F.transform(F.filter("cells", lambda c: c["formula"]), lambda c: F.struct(c["ref"].alias("ref"), c["value"].alias("formula"))).alias("formulas")))
    body = of_rows.filter("NOT is_header").select(*base, F.col("row").alias("at"), F.lit("row").alias("block_type"), F.col("row").alias("row_number"), facts.alias("metadata_json"), F.array_join(named, " | ").alias("text"))
    book = df.filter("kind = 'workbook'").select(*keys, F.lit(None).cast("string").alias("sheet"), F.lit(0).alias("sheet_index"), F.lit(-3).alias("at"), F.lit("workbook_metadata").alias("block_type"), F.lit(None).cast("int").alias("row_number"), F.col("facts").alias("metadata_json"), facts_text("facts").alias("text"))
    both = reduce(DataFrame.unionByName, (book, summary, header, body)).withColumns({"sheet_name": F.col("sheet"), "section_path": F.filter(F.array("sheet"), lambda x: x.isNotNull())})
    return _finish(both, ["sheet_index", "at"])


def facts_text(json: str) -> Column:
    """A JSON object as lines of titled keys and values; lists by commas."""
    entries = F.map_entries(F.from_json(json, "map<string,string>"))
    value = lambda v: F.when(v.startswith("["), F.array_join(F.from_json(v, "array<string>"), ", ")).when(v.isin("true", "false"), F.initcap(v)).otherwise(v)
    return F.array_join(F.transform(F.filter(entries, lambda e: F.coalesce(value(e["value"]), F.lit("")) != ""), lambda e: F.concat(F.initcap(F.translate(e["key"], "_", " ")), F.lit(": "), value(e["value"]))), "\n")


def pdf_blocks(found: DataFrame, empty_pages: bool = True) -> DataFrame:
    """The document's facts, and of each page its text or a notice why there is none."""
    df = found.filter("doc_type = 'pdf' AND error IS NULL").withColumn("clean", page_normal("text"))
    images = F.coalesce(F.get_json_object("facts", "$.image_count").cast("int"), F.lit(0)) > 0
    failed = F.get_json_object("facts", "$.extraction_error").isNotNull()
    page = F.concat(F.lit("Page "), F.col("page").cast("string"))
    notice = F.when(images, F.concat(page, F.lit(" appears to be image-based or scanned. No embedded text was extracted."))).otherwise(F.concat(page, F.lit(" did not yield extractable text.")))
    df = df.withColumns({
        "block_type": F.when(F.col("kind") == "document", "document_metadata").when(F.col("clean") != "", "page_text").otherwise("page_notice"),
        "text": F.when(F.col("kind") == "document", facts_text("facts")).when(F.col("clean") != "", F.col("clean")).otherwise(notice),
        "page_number": F.col("page"), "metadata_json": F.col("facts"), "section_path": F.array().cast("array<string>"),
    })
    return _finish(df.filter((F.col("block_type") != "page_notice") | images | failed | F.lit(empty_pages)), ["n"])


def blocks_of(found: DataFrame) -> DataFrame:
    """The blocks of elements of all types."""
    return reduce(DataFrame.unionByName, (docx_blocks(found), pptx_blocks(found), xlsx_blocks(found), pdf_blocks(found)))


def ingest(spark: SparkSession, folder: str, permissive: bool = False, recursive: bool = True, types: tuple[str, ...] = tuple(READERS)) -> DataFrame:
    """The blocks of all supported files of a folder. Each file is parsed once: its elements are written. See `elements` for files that can't be read."""
    return blocks_of(written(elements(discover(spark, folder, types, recursive), permissive), "elements"))


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """The files that can't be read, and why: source_path, doc_type, error."""
    return elements(discover(spark, folder), permissive=True).filter("error IS NOT NULL").select("source_path", "doc_type", "error")
