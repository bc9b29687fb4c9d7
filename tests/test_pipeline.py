import pytest

import office
from leafmill.__main__ import main
from leafmill.operators.store import opened
from leafmill.plans import pipeline
from leafmill.sources.stages import BLOCK_SCHEMA, read_stage, write_stage


def test_build_and_ask(spark, tmp_path, capsys):
    folder, work = tmp_path / "in", str(tmp_path / "work")
    folder.mkdir()
    office.docx(folder / "a.docx")
    office.pptx(folder / "b.pptx")
    office.xlsx(folder / "c.xlsx")
    main(["build", str(folder), work])
    assert "'records_stored'" in capsys.readouterr().out
    main(["ask", work, "project plan sentence", "--top-k", "2", "--candidate-k", "4"])
    lines = capsys.readouterr().out.strip().splitlines()
    assert len(lines) == 2 and "a.docx" in lines[0]
    store = opened(spark, f"{work}/store")
    asked = pipeline.questions(spark, ["project plan", "lower text"])
    got = pipeline.evidence(store, asked, seeds=1, candidates=3)
    assert {r.query_id for r in got.collect()} == {1, 2}
    answers = {r.query_id: r.answer for r in pipeline.ask(store, asked, lambda: lambda p: p.split("Question:\n")[1].split("\n")[0], seeds=1, candidates=3).collect()}
    assert answers == {1: "project plan", 2: "lower text"}
    with pytest.raises(ValueError):
        pipeline.retrieve(store, asked, 5, 2)


def test_stages(spark, tmp_path):
    df = spark.createDataFrame([("a", "pdf", None)], "id string, doc_type string, text string")
    write_stage(df, str(tmp_path / "p"), "doc_type")
    assert read_stage(spark, str(tmp_path / "p")).select("id", "doc_type", "text").collect() == df.collect()
    write_stage(df, str(tmp_path / "j"), format="json")
    assert read_stage(spark, str(tmp_path / "j"), "json", "id string, text string").collect()[0].id == "a"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("{broken")
    with pytest.raises(Exception):
        read_stage(spark, str(tmp_path / "bad"), "json", BLOCK_SCHEMA).collect()
    with pytest.raises(ValueError):
        write_stage(df, str(tmp_path / "c"), format="csv")
