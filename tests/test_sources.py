import pytest

import office
from leafmill.operators.chunker import chunk
from leafmill.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("office")
    office.docx(d / "a.docx")
    (d / "sub").mkdir()
    office.pptx(d / "sub" / "b.PPTX")
    office.xlsx(d / "c.xlsx")
    (d / "~$a.docx").write_text("lock")
    (d / "notes.txt").write_text("no")
    return d


def test_blocks(spark, folder):
    got = files.ingest(spark, str(folder)).orderBy("source_file", "order").collect()
    assert {r.source_file for r in got} == {"a.docx", "sub/b.PPTX", "c.xlsx"}
    assert set(got[0].asDict()) == set(files.BLOCK)
    doc = [(r.block_type, r.text, r.section_path, r.order) for r in got if r.doc_type == "docx"]
    assert doc[0] == ("heading", "Project Plan", ["Project Plan"], 1)
    assert doc[1][0] == "paragraph" and doc[1][2] == ["Project Plan"]
    assert doc[2][:2] == ("table", "Columns: Name, Value\nRow 1: one, 1")
    assert [d[3] for d in doc] == list(range(1, len(doc) + 1))
    deck = [(r.block_type, r.text, r.block_id) for r in got if r.doc_type == "pptx"]
    assert [d[:2] for d in deck] == [("title", "Aims"), ("callout", "Mind this"), ("text", "Lower text"), ("bullet", "  A point"), ("notes", "Say hello")]
    assert deck[-1][2] == "sub/b.PPTX::slide_1::notes" and all(r.section_path == ["Aims"] for r in got if r.doc_type == "pptx")
    book = {r.block_type: r for r in got if r.doc_type == "xlsx"}
    assert book["header"].text == "Columns: Key, Key (2), When" and book["header"].row_number == 1
    assert book["row"].text == "Key: 3 | Key (2): TRUE | When: 2024-01-01 00:00:00 | D: =A3*2" and book["row"].section_path == ["Data"]
    assert "Data Rows: 1" in book["sheet_metadata"].text and book["workbook_metadata"].text == "Sheet Count: 1\nSheet Names: Data"


def test_equal_names_in_two_folders(spark, tmp_path):
    """No file and no block is lost, and each file is parsed once."""
    for sub in ("x", "y"):
        (tmp_path / sub).mkdir()
        office.docx(tmp_path / sub / "plan.docx")
        office.pptx(tmp_path / sub / "deck.pptx")
        office.xlsx(tmp_path / sub / "t.xlsx")
    df = files.ingest(spark, str(tmp_path))
    got = df.collect()
    assert {r.source_file for r in got} == {f"{s}/{n}" for s in "xy" for n in ("plan.docx", "deck.pptx", "t.xlsx")}
    assert len({r.block_id for r in got}) == len(got)
    ids = [i for r in chunk(df).collect() for i in r.block_ids]
    assert set(ids) == {r.block_id for r in got}
    assert "MapInPandas" not in df._jdf.queryExecution().toString()
    assert {r.doc_type for r in files.ingest(spark, str(tmp_path), types=("docx",)).collect()} == {"docx"}


def test_not_recursive(spark, folder):
    assert {r.source_file for r in files.discover(spark, str(folder), recursive=False).select("source_file").collect()} == {"a.docx", "c.xlsx"}


def test_corrupt_files(spark, tmp_path):
    (tmp_path / "x.xlsx").write_text("no zip")
    office.docx(tmp_path / "a.docx")
    with pytest.raises(Exception, match="can't read x.xlsx"):
        files.ingest(spark, str(tmp_path)).collect()
    assert {r.source_file for r in files.ingest(spark, str(tmp_path), permissive=True).collect()} == {"a.docx"}
    assert [r.doc_type for r in files.failures(spark, str(tmp_path)).collect()] == ["xlsx"]


def test_column_letters(spark):
    df = spark.createDataFrame([(1,), (26,), (27,), (702,), (703,)], "n int")
    assert [r[0] for r in df.select(files.column_letter(df.n)).collect()] == ["A", "Z", "AA", "ZZ", "AAA"]
