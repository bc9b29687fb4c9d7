"""Scenarios of the chunker: tables, headings, budgets, overlap, and properties over the test tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leafmill.operators.chunker import ChunkConfig, chunk, cut_prose, cut_table, estimate

BLOCK = (
    "block_id string, source_file string, source_path string, doc_type string, block_type string, order int, text string, section_path array<string>, "
    "page_number int, slide_number int, shape_index int, sheet_name string, row_number int, metadata_json string, ingested_at timestamp"
)


def blocks(spark, rows, file="a.docx"):
    """rows: (id, type, text, path) in order; a row may end with an order of its own."""
    data = []
    for n, r in enumerate(rows, 1):
        order = r[4] if len(r) > 4 else n
        data.append((r[0], file, f"/x/{file}", "docx", r[1], order, r[2], r[3], None, None, None, None, None, None, dt.datetime(2024, 1, 1)))
    return spark.createDataFrame(data, BLOCK)


def run(spark, rows, **kw):
    got = chunk(blocks(spark, rows), ChunkConfig(**kw)).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == [f"a.docx::chunk_{n:04d}" for n in range(1, len(got) + 1)]
    return got


def test_table_is_alone_and_heading_repeats(spark):
    a, b = ["Plan"], ["Next"]
    rows = [("t1", "table", "Columns: A | B\nRow 1: x | y", a, 3), ("h1", "heading", "Plan", a, 1), ("p1", "paragraph", "First text.", a, 2), ("p2", "paragraph", "Second text.", a, 4), ("h2", "heading", "Next", b, 5), ("p3", "paragraph", "Third text.", b, 6)]
    got = run(spark, rows, max_chars=120)
    assert [r.chunk_type for r in got] == ["section", "table", "section", "section"]
    assert [r.block_ids for r in got] == [["h1", "p1"], ["t1"], ["h1", "p2"], ["h2", "p3"]]
    assert got[2].heading == "Plan" and got[1].heading == "Plan"
    assert got[0].text == "Plan: First text."


def test_paragraphs_become_one_line(spark):
    got = run(spark, [("h", "heading", "Aims", ["Aims"]), ("a", "paragraph", "One thing", ["Aims"]), ("b", "paragraph", "another thing", ["Aims"]), ("c", "paragraph", "a last one", ["Aims"])], max_chars=1000)
    assert [r.text for r in got] == ["Aims: One thing. another thing. a last one."]


def test_short_headings_are_attached(spark):
    rows = [("h1", "heading", "The following applies:", ["A"]), ("h2", "heading", "Part one", ["B"]), ("h3", "heading", "Details", ["C"]), ("p1", "paragraph", "Some body text.", ["C"]), ("h4", "heading", "Closing note", ["D"]), ("h5", "heading", "Last section", ["E"]), ("p2", "paragraph", "More body.", ["E"])]
    got = run(spark, rows)
    assert len(got) == 2
    assert got[0].block_ids == ["h1", "h2", "h3", "p1", "h4"] and got[0].section_title == "The following applies"
    assert got[0].metadata.merged_short_context_chunks == 3
    assert got[1].section_title == "Last section" and got[1].block_ids == ["h5", "p2"]


def test_colon_paragraph_is_a_heading(spark):
    got = run(spark, [("a", "paragraph", "Conditions:", []), ("b", "paragraph", "They hold.", [])])
    assert got[0].block_types == ["heading", "paragraph"] and got[0].section_title == "Conditions"


def test_budget_cuts_and_keeps_ids(spark):
    body = "The first sentence is here. The second sentence is here. The third sentence is here. The fourth sentence is here."
    got = run(spark, [("h", "heading", "Long", ["Long"]), ("p", "paragraph", body, ["Long"])], max_chars=100)
    assert len(got) > 1 and all(len(r.text) <= 100 and r.block_ids == ["h", "p"] for r in got)


def test_overlap_repeats_a_sentence(spark):
    body = "Alpha beta gamma delta. Epsilon zeta eta theta. Iota kappa lambda mu. Nu xi omicron pi."
    got = run(spark, [("h", "heading", "Greek", ["Greek"]), ("p", "paragraph", body, ["Greek"])], max_tokens=20, overlap_tokens=10)
    assert len(got) > 1
    assert any(s in got[0].text and s in got[1].text for s in ("Epsilon zeta", "Iota kappa"))


def test_tokenizer_counts_rendered_texts(spark):
    """A tokenizer whose tokens are words, and two marks around them."""
    count = lambda text: len(text.split()) + 2
    load = lambda: count
    words = ("alpha beta gamma", "delta eps zeta", "eta theta iota", "kappa lam mu", "nu xi om", "pi rho sig")
    body = " ".join(f"{w.capitalize()}." for w in words)
    got = run(spark, [("h", "heading", "Greek", ["Greek"]), ("p", "paragraph", body, ["Greek"])], max_tokens=12, overlap_tokens=5, tokenizer=load)
    assert len(got) > 1 and all(count(r.text) <= 12 and r.heading == "Greek" for r in got)
    assert all(a.text.split(". ")[-1].rstrip(".") in b.text for a, b in zip(got, got[1:]))
    long = "supercalifragilistic " * 30  # many estimated tokens, few words
    assert len(run(spark, [("p", "paragraph", long.strip(), [])], max_tokens=40, overlap_tokens=0, tokenizer=load)) == 1
    assert len(run(spark, [("p", "paragraph", " ".join(["It is long."] * 60), [])], max_tokens=40, overlap_tokens=0)) > 1


def test_types_are_parameters(spark):
    rows = [("a", "caption", "Lead", ["A"]), ("b", "paragraph", "Body of it.", ["A"]), ("c", "grid", "x | y", ["A"])]
    got = run(spark, rows, heading_types=("caption",), table_types=("grid",))
    assert [(r.chunk_type, r.heading) for r in got] == [("section", "Lead"), ("table", "Lead")]


def test_two_files_stay_apart_and_repeats_count_once(spark):
    one = blocks(spark, [("h", "heading", "A", ["A"]), ("p", "paragraph", "Body text.", ["A"])])
    two = blocks(spark, [("h2", "heading", "A", ["A"]), ("p2", "paragraph", "Body text.", ["A"])], "b.docx")
    got = chunk(one.union(one).union(two)).collect()
    assert sorted((r.source_file, tuple(r.block_ids)) for r in got) == [("a.docx", ("h", "p")), ("b.docx", ("h2", "p2"))]


def test_empty_null_and_blank(spark):
    assert chunk(blocks(spark, [("a", "paragraph", None, None), ("b", "heading", "  ", []), ("c", None, "", None)])).count() == 0
    assert chunk(blocks(spark, [("a", "paragraph", "x", None)]).limit(0)).count() == 0
    got = chunk(blocks(spark, [("a", None, "only text", None)]).withColumn("source_file", F.lit(None).cast("string"))).collect()
    assert [r.source_file for r in got] == [""]


def test_null_ids_are_kept(spark):
    got = run(spark, [(None, "paragraph", "First text.", ["A"]), (None, "paragraph", "Second text.", ["A"]), (" ", "paragraph", "Third.", ["A"])])
    assert len(got) == 1 and got[0].text == "First text. Second text. Third." and len(set(got[0].block_ids)) == 3


def test_config_is_checked():
    with pytest.raises(ValueError):
        ChunkConfig(max_chars=0)
    with pytest.raises(ValueError):
        ChunkConfig(max_tokens=10, overlap_tokens=10)


def test_cutting():
    assert cut_prose("a b", 100, 100) == ["a b"]
    assert cut_prose("One two. Three four.", 12, 100) == ["One two.", "Three four."]
    assert cut_prose("x" * 50, 10, 100) == ["x" * 50]
    got = cut_table("Columns: A | B\nRow 1: aaaa\nRow 2: bbbb\nRow 3: cccc", 40, 100)
    assert len(got) > 1 and all(g.startswith("Columns: A | B\n") and len(g) <= 40 for g in got)
    assert estimate("") == 0


def test_every_block_is_in_a_chunk(spark, sf):
    b = spark.read.parquet(f"{sf}/blocks.parquet")
    got = chunk(b).cache()
    texts = b.filter("text IS NOT NULL").filter(F.col("text").rlike(r"\S")).select("block_id").distinct()
    assert texts.join(got.select(F.explode("block_ids").alias("block_id")), "block_id", "left_anti").count() == 0
    assert got.select("chunk_id").distinct().count() == got.count()
    plain = got.filter("metadata.merged_short_context_chunks IS NULL AND char_count > 2000")
    assert plain.filter("NOT text rlike '[^ ]{400}'").count() == 0
    again = chunk(b.repartition(3)).select("chunk_id", "text")
    assert again.exceptAll(got.select("chunk_id", "text")).count() == 0


def test_ranges_change_nothing(spark, sf):
    """What runs along a file is the same in however small ranges it is computed."""
    from leafmill.operators import chunker, sections

    b = spark.read.parquet(f"{sf}/blocks.parquet")
    whole = {tuple(map(str, r)) for r in chunk(b).drop("metadata").collect()}
    keep = sections.SPAN, chunker.SPAN
    sections.SPAN, chunker.SPAN = 3, 2
    try:
        assert {tuple(map(str, r)) for r in chunk(b).drop("metadata").collect()} == whole
    finally:
        sections.SPAN, chunker.SPAN = keep
