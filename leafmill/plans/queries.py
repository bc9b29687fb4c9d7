"""The registered queries of the core, by name. Each reads the given tables whole; a search takes as its queries every
citation whose id is divisible by 100, against all chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import answer, chunker, encode, expand, rerank, search, sections, store
from leafmill import tables
from leafmill.sources import files, office
from leafmill.tables import clean_type, stripped, table, written

Query = Callable[[SparkSession, str], DataFrame]
BEST, CANDIDATES = 5, 25  # of a question
SEEDS, SEED_CANDIDATES = 8, 80  # where context is added


def _blocks(s: SparkSession, d: str) -> DataFrame:
    """Each block once."""
    return tables.once_per_key(table(s, d, "blocks").drop("metadata_json", "ingested_at"), "block_id")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """The latest row of each chunk with an id and its title."""
    c = store.latest(table(s, d, "chunk_records").filter("chunk_id IS NOT NULL"))
    return c.withColumn("title", rerank.section_title_of(F.col("section_title"), F.col("heading"), F.col("section_key")))


def doc_scan_filter(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").filter(F.col("doc_type").isin("pdf", "docx") & (F.col("n_chars") > 0)).select("doc_id", "doc_type", "source", "n_chars")


def text_clean(s: SparkSession, d: str) -> DataFrame:
    return _blocks(s, d).select("block_id", T.clean_text("text").alias("clean"))


def text_narrative(s: SparkSession, d: str) -> DataFrame:
    n = T.narrative("text")
    return _blocks(s, d).select("block_id", n.alias("line"), T.word_count(n).alias("n_words"))


def text_sentence_end(s: SparkSession, d: str) -> DataFrame:
    n = T.narrative("text")
    return _blocks(s, d).select("block_id", T.sentence_end(n, False).alias("soft"), T.sentence_end(n, True).alias("forced"))


def text_tokens(s: SparkSession, d: str) -> DataFrame:
    return _blocks(s, d).select("block_id", F.size(T.tokens("text")).alias("n_tokens"), T.token_estimate("text").alias("estimate"))


def text_preview(s: SparkSession, d: str) -> DataFrame:
    return _blocks(s, d).select("block_id", T.preview("text").alias("preview"))


def text_variants(s: SparkSession, d: str) -> DataFrame:
    return _blocks(s, d).select("block_id", T.page_normal("text").alias("page"), T.slide_normal("text").alias("slide"), T.content_part("text").alias("content"))


def heading_prefix(s: SparkSession, d: str) -> DataFrame:
    n = T.narrative("text")
    return _blocks(s, d).select("block_id", T.heading_like(n).alias("heading_like"), sections.inferred_heading(clean_type("block_type"), F.col("text")).alias("inferred"))


def joined_parts(s: SparkSession, d: str) -> DataFrame:
    return _blocks(s, d).select("block_id", T.join_parts(F.split(F.coalesce("text", F.lit("")), "\n")).alias("sentences"))


def heading_body(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("chunk_id", T.with_heading("heading", F.split(F.coalesce("text", F.lit("")), "\n")).alias("rendered"))


def retrieved_text(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("chunk_id", T.retrieved_text("text", "title").alias("repaired"))


def block_counts(s: SparkSession, d: str) -> DataFrame:
    b = _blocks(s, d)
    return b.groupBy("doc_type", clean_type("block_type").alias("block_type")).agg(F.count("*").alias("n_blocks"), F.countDistinct("source_file").alias("n_files"), F.sum(F.length("text")).alias("n_chars"))


def file_counts(s: SparkSession, d: str) -> DataFrame:
    return _blocks(s, d).groupBy("source_file").agg(F.count("*").alias("n_blocks"), F.max("page_number").alias("last_page"), F.max("slide_number").alias("last_slide"), F.countDistinct("sheet_name").alias("n_sheets"))


def heading_scores(s: SparkSession, d: str) -> DataFrame:
    """Headings of the given files count as bold."""
    b = tables.once_per_key(table(s, d, "blocks").filter("doc_type = 'docx'").select("block_id", "block_type", "text", "metadata_json"), "block_id")
    return b.select("block_id", T.heading_score("text", F.coalesce(clean_type("block_type") == "heading", F.lit(False)), F.get_json_object("metadata_json", "$.style")).alias("score"))


def heading_forward_fill(s: SparkSession, d: str) -> DataFrame:
    b = _blocks(s, d).filter("doc_type = 'docx'")
    w = Window.partitionBy("source_file").orderBy("order", "block_id")
    is_heading = clean_type("block_type") == "heading"
    return b.select("block_id", F.last(F.when(is_heading, F.col("text")), ignorenulls=True).over(w).alias("running_heading"))


def section_islands(s: SparkSession, d: str) -> DataFrame:
    got = sections.sections(sections.prepared(table(s, d, "blocks")))
    return got.select("block_id", F.array_join("path", " > ").alias("section_key"), "section_id", "part", F.col("heading.block_id").alias("heading_id"))


def section_summary(s: SparkSession, d: str) -> DataFrame:
    got = sections.sections(sections.prepared(table(s, d, "blocks")))
    return got.groupBy("source_file", "section_id").agg(
        F.count("*").alias("n_blocks"), F.min("order").alias("order_start"), F.max("order").alias("order_end"), F.array_join(F.sort_array(F.collect_set("page_number")).cast("array<string>"), ",").alias("pages"), F.min(F.struct("order", "block_id"))["block_id"].alias("first_block")
    )


def label_dedupe(s: SparkSession, d: str) -> DataFrame:
    """The labels of header blocks: blank ones are column letters, repeated ones numbered."""
    b = _blocks(s, d).filter(clean_type("block_type") == "header")
    cells = F.split(F.coalesce("text", F.lit("")), r"\|")
    blank = F.lit("|  | a | a |")  # each header has further columns: two blank ones, and two of one name
    return b.select("block_id", F.posexplode(files.labels(F.concat(cells, F.split(blank, r"\|")))).alias("column", "label"))


def slide_rollup(s: SparkSession, d: str) -> DataFrame:
    """The text of each slide, images left out, shapes in order."""
    b = _blocks(s, d).filter("doc_type = 'pptx' AND slide_number IS NOT NULL")
    b = b.withColumn("kept", F.when((clean_type("block_type") != "image") & (stripped(F.coalesce("text", F.lit(""))) != ""), F.col("text")))
    shapes = F.array_sort(F.collect_list(F.struct(F.coalesce("shape_index", F.lit(-1)).alias("i"), "block_id", "kept", F.try_element_at("section_path", F.lit(1)).alias("hint"))))
    g = b.groupBy("source_file", "slide_number").agg(shapes.alias("x"))
    texts = F.filter(F.transform("x", lambda x: x["kept"]), lambda t: t.isNotNull())
    return g.select("source_file", "slide_number", F.get("x", F.lit(0))["hint"].alias("section_hint"), stripped(F.array_join(texts, "\n")).alias("text"))


def sentence_split(s: SparkSession, d: str) -> DataFrame:
    each = _blocks(s, d).select("block_id", F.posexplode(F.split(T.clean_text("text"), r"(?<=[.!?])[\s\x0B\x1C-\x1F\x85\p{Z}]+")).alias("position", "sentence"))
    return each.withColumn("sentence", stripped("sentence")).filter("sentence <> ''")


def chunk_full(s: SparkSession, d: str) -> DataFrame:
    return chunker.chunk(table(s, d, "blocks"))


def chunk_cover(s: SparkSession, d: str) -> DataFrame:
    """Each block's chunks: whether they are of its file, hold its order, and keep the budget (unless short headings were attached or a word is beyond it)."""
    c = written(chunk_full(s, d).select("source_file", "order_start", "order_end", "block_ids", "section_key", F.array_join("section_path", " > ").alias("joined"), "char_count", F.length("text").alias("n"), (F.col("metadata.source_block_count") == F.size("block_ids")).alias("counted")), "cover")
    b = sections.prepared(table(s, d, "blocks")).select("block_id", F.col("source_file").alias("of"), F.col("order").alias("o"))
    each = b.join(c.withColumn("block_id", F.explode("block_ids")), "block_id")
    return each.groupBy("block_id", F.col("of").alias("source_file")).agg(
        F.bool_and(F.col("of") == F.col("source_file")).alias("same_file"), F.bool_and(F.col("o").between(F.col("order_start"), F.col("order_end"))).alias("in_range"),
        F.bool_and((F.col("char_count") == F.col("n")) & (F.col("section_key") == F.col("joined")) & F.col("counted")).alias("consistent"),
    )


PART = 200  # blocks, slides or rows of a file that is written and parsed again


def _again(parts: DataFrame, doc_type: str, order: list[str]) -> DataFrame:
    """The elements of office files that are made of blocks."""
    return written(files.elements(office.as_files(parts, doc_type, order)), "elements")


def parse_docx(s: SparkSession, d: str) -> DataFrame:
    """The docx blocks written as documents and parsed again: headings by score, sections, tables as text."""
    b = tables.once_per_key(table(s, d, "blocks").filter("doc_type = 'docx'").select("block_id", "source_file", "order", "block_type", "text", "metadata_json"), "block_id")
    parts = b.select(office.part_of(F.col("source_file"), F.col("order"), PART).alias("file"), F.coalesce("order", F.lit(0)).alias("order"), "block_id", clean_type("block_type").alias("kind"), "text", F.get_json_object("metadata_json", "$.style").alias("style"))
    got = files.docx_blocks(_again(parts, "docx", ["order", "block_id"]))
    return got.select(F.col("source_path").alias("file"), "order", "block_type", "text", F.array_join("section_path", " > ").alias("section_key"), F.get_json_object("metadata_json", "$.heading_score").cast("int").alias("score"))


def parse_pptx(s: SparkSession, d: str) -> DataFrame:
    """The pptx blocks written as slides and parsed again: shapes in visual order, titles, bullets, tables, notes."""
    b = tables.once_per_key(table(s, d, "blocks").filter("doc_type = 'pptx' AND slide_number IS NOT NULL").select("block_id", "source_file", "slide_number", "shape_index", "block_type", "text"), "block_id")
    parts = b.select(office.part_of(F.col("source_file"), F.col("slide_number"), PART // 4).alias("file"), F.col("slide_number").alias("slide"), F.coalesce("shape_index", F.lit(0)).alias("index"), "block_id", clean_type("block_type").alias("kind"), "text")
    got = files.pptx_blocks(_again(parts, "pptx", ["slide", "index", "block_id"]))
    return got.select(F.col("source_path").alias("file"), "order", "slide_number", "block_type", "text", F.get("section_path", F.lit(0)).alias("hint"))


def parse_xlsx(s: SparkSession, d: str) -> DataFrame:
    """The header and row blocks written as sheets and parsed again: workbook and sheet facts, labels, rows under their labels."""
    b = tables.once_per_key(table(s, d, "blocks").filter("doc_type = 'xlsx' AND row_number > 0 AND sheet_name IS NOT NULL").select("block_id", "source_file", "sheet_name", "row_number", "block_type", "text"), "block_id")
    b = b.groupBy("source_file", "sheet_name", "row_number").agg(F.min(F.struct("block_id", "block_type", "text")).alias("b"))
    cells = F.split(F.regexp_replace(F.coalesce("b.text", F.lit("")), "\r\n?", "\n"), r" \| ")
    value = lambda c: F.when(c.contains(": "), F.substring_index(F.regexp_replace(c, r"(?s)\A.*?: ", "\x01"), "\x01", -1)).otherwise(c)
    cells = F.when(clean_type("b.block_type") == "header", cells).otherwise(F.transform(cells, value))
    file = office.part_of(F.concat(F.coalesce("source_file", F.lit("")), F.lit("/"), "sheet_name"), F.col("row_number"), PART)
    parts = b.select(file.alias("file"), F.col("sheet_name").alias("sheet"), F.col("row_number").alias("row"), cells.alias("cells"))
    got = files.xlsx_blocks(_again(parts, "xlsx", ["row"]))
    return got.select(F.col("source_path").alias("file"), "order", "block_type", "text", "row_number", "sheet_name")


def _sectioned(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = written(sections.sections(sections.prepared(table(s, d, "blocks"))), "sections")
    return found, chunker.chunk_rows(found, chunker.ChunkConfig())


def chunk_tables(s: SparkSession, d: str) -> DataFrame:
    """The chunks of tables within the budget."""
    _, rows = _sectioned(s, d)
    t = rows.filter("chunk_type = 'table'").withColumns({"title": chunker.section_title(F.col("heading"), F.col("section_path")), "block_id": F.get("block_ids", F.lit(0))})
    whole = t.groupBy("block_id").agg(F.count("*").alias("n")).filter("n = 1").select("block_id")
    small = (F.length("text") <= 2000) & (T.token_estimate("text") <= 380)
    return t.join(whole, "block_id", "left_semi").filter(small).select("block_id", "source_file", "text", F.array_join("section_path", " > ").alias("section_key"), "heading", F.col("title").alias("section_title"), "order_start", "order_end", "original_block_type")


def chunk_sections(s: SparkSession, d: str) -> DataFrame:
    """The texts of the section parts that fit one chunk without cutting a block; null for the others."""
    found, rows = _sectioned(s, d)
    place = found.filter("NOT is_heading AND NOT is_table").select("source_file", "section_id", "part", "block_id")
    body = rows.filter("chunk_type = 'section'").select("source_file", F.struct(*chunker.PLACE).alias("seq"), "text", "block_ids", F.explode("block_ids").alias("block_id")).join(place, ["source_file", "block_id"])
    segs = chunker.segments(found, chunker.ChunkConfig()).filter("seg > 0 AND NOT is_table").select("source_file", "section_id", "part").distinct().withColumn("cut", F.lit(True))
    g = body.groupBy("source_file", "section_id", "part").agg(F.countDistinct("seq").alias("n"), F.min(F.struct("seq", "text"))["text"].alias("text"), F.min(F.struct("seq", F.array_join("block_ids", ",").alias("ids")))["ids"].alias("ids"))
    fits = (F.length("text") <= 2000) & (T.token_estimate("text") <= 380)  # a single long word may not
    g = g.join(segs, ["source_file", "section_id", "part"], "left").withColumn("one", (F.col("n") == 1) & F.col("cut").isNull() & fits)
    return g.select("source_file", "section_id", "part", F.when(F.col("one"), F.col("text")).alias("text"), F.when(F.col("one"), F.col("ids")).alias("block_ids"))


def retrieval_text(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("chunk_id", encode.retrieval_text().alias("retrieval_text_built"))


def hash_encode(s: SparkSession, d: str) -> DataFrame:
    return encode.embedded(_chunks(s, d).drop("embedding", "retrieval_text")).select("chunk_id", "embedding")


def run_summary(s: SparkSession, d: str) -> DataFrame:
    return encode.run_summary(table(s, d, "chunk_records"))


def store_valid(s: SparkSession, d: str) -> DataFrame:
    v = store.valid(table(s, d, "chunk_records"))
    return v.groupBy("run_id").agg(F.count("*").alias("n_records"), F.countDistinct("chunk_id").alias("n_chunks"))


def store_upsert_latest(s: SparkSession, d: str) -> DataFrame:
    return store.latest(store.valid(table(s, d, "chunk_records")).filter("chunk_id IS NOT NULL")).select("chunk_id", "embedded_at", "run_id", "char_count")


def store_metadata(s: SparkSession, d: str) -> DataFrame:
    c = store.latest(table(s, d, "chunk_records").filter("chunk_id IS NOT NULL"))
    return store.metadata(c, table(s, d, "embedding_runs"))


def vector_topk_batch(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    got = search.top_k_batch(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), q, 10)
    return got.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def _questions(s: SparkSession, d: str) -> DataFrame:
    """query_id, query and vector of every hundredth citation. One without words has no vector, and so no result."""
    c = table(s, d, "citations").filter("citation_id % 100 = 0").select(F.col("citation_id").alias("query_id"), F.col("text").alias("query")).dropDuplicates(["query_id"])
    return written(c.withColumn("v", encode.encoder_udf(encode.hashing_encoder, role="query")("query")).filter(F.exists("v", lambda x: x != 0)), "questions")


def _candidates(s: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The k most similar chunks of each question with their columns (position, raw_score), and all chunks."""
    chunks = written(_chunks(s, d).withColumn("embedding", encode.encoder_udf(encode.hashing_encoder)("retrieval_text")).drop("retrieval_text"), "chunks")
    questions = _questions(s, d)
    got = search.top_k_batch(chunks.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v")), questions.select("query_id", "v"), k)
    found = got.withColumnRenamed("id", "chunk_id").join(chunks.drop("embedding"), "chunk_id").join(questions.select("query_id", "query"), "query_id")
    return found.withColumnsRenamed({"rank": "position", "score": "raw_score"}).withColumn("source_block_count", F.col("metadata.source_block_count")), chunks.drop("embedding")


def rerank_final(s: SparkSession, d: str) -> DataFrame:
    """The best few of each question's candidates, by their final scores."""
    found, _ = _candidates(s, d, CANDIDATES)
    got = rerank.best(rerank.rerank(found), BEST)
    return got.select("query_id", "chunk_id", F.col("seed").cast("int").alias("seed"), F.round("raw_score", 6).alias("raw_score"), F.round("rerank_delta", 6).alias("rerank_delta"), F.round("final_score", 6).alias("final_score"), F.array_join(F.transform("signals", lambda x: x["name"]), ",").alias("signal_names"))


def rerank_signals(s: SparkSession, d: str) -> DataFrame:
    """The signals of all candidates."""
    found, _ = _candidates(s, d, CANDIDATES)
    got = rerank.rerank(found)
    return got.select("query_id", "chunk_id", "position", F.round("rerank_delta", 6).alias("rerank_delta"), F.array_join(F.transform("signals", lambda x: x["name"]), ",").alias("signal_names"))


def rerank_overlap(s: SparkSession, d: str) -> DataFrame:
    found, _ = _candidates(s, d, CANDIDATES)
    q = T.tokens(F.lower(T.narrative("query")))
    return found.select("query_id", "chunk_id", F.round(rerank.overlap(q, T.tokens(T.narrative("text"))), 6).alias("text_overlap"), F.round(rerank.phrase_share(q, F.lower(T.narrative("text"))), 6).alias("phrase_share"))


def _seeds(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found, chunks = _candidates(s, d, SEED_CANDIDATES)
    return written(rerank.best(rerank.rerank(found), SEEDS), "seeds"), chunks


def group_rank(s: SparkSession, d: str) -> DataFrame:
    seeds, _ = _seeds(s, d)
    return expand.group_ranks(seeds).select("query_id", "chunk_id", F.col("seed").cast("int").alias("seed"), F.col("group_rank").cast("int").alias("group_rank"))


def associated_expand(s: SparkSession, d: str) -> DataFrame:
    seeds, chunks = _seeds(s, d)
    got = expand.expanded(seeds, chunks)
    return got.select("query_id", "place", "chunk_id", "relationship", F.col("group_rank").cast("int").alias("group_rank"), F.round("score", 6).alias("score"))


def citation_context(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "citations").dropDuplicates(["citation_id"])
    r = c.select(F.col("answer_id").alias("query_id"), F.col("citation_id").alias("place"), F.col("source").alias("file_name"), F.col("section").alias("section_title"), "text", F.lit(None).cast("string").alias("preview"), "score")
    return answer.citations(r)


def grounded_prompt(s: SparkSession, d: str) -> DataFrame:
    cited = citation_context(s, d)
    q = table(s, d, "citations").select(F.col("answer_id").alias("query_id")).distinct().withColumn("query", F.concat(F.lit(" What supports answer "), F.col("query_id").cast("string"), F.lit("? ")))
    return answer.prompts(q, cited)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        doc_scan_filter, text_clean, text_narrative, text_sentence_end, text_tokens, text_preview, text_variants, heading_prefix, joined_parts, heading_body, retrieved_text,
        block_counts, file_counts, heading_scores, heading_forward_fill, section_islands, section_summary, label_dedupe, slide_rollup, sentence_split, parse_docx, parse_pptx, parse_xlsx, chunk_full, chunk_cover, chunk_tables, chunk_sections, retrieval_text, hash_encode, run_summary,
        store_valid, store_upsert_latest, store_metadata, vector_topk_batch, rerank_overlap, rerank_signals, rerank_final, group_rank, associated_expand, citation_context, grounded_prompt,
    )
}
