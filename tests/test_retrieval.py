"""Store, encoders, search, rerank, expansion, prompts: the reference's scenarios on small rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import answer, encode, expand, rerank, search, store
from leafmill.functions import text as T

T0 = dt.datetime(2024, 1, 1)
FOUND = "query_id int, query string, position int, raw_score double, chunk_id string, section_title string, heading string, section_key string, file_name string, source_file string, text string, block_types array<string>, source_block_count int, order_start int"


def found(spark, query, *rows):
    data = [(1, query, n, s, f"c{n}", title, None, None, "a.docx", "a.docx", text, types, count, n) for n, (s, title, text, types, count) in enumerate(rows, 1)]
    return spark.createDataFrame(data, FOUND)


def ranked(df):
    return rerank.best(rerank.rerank(df), 10).orderBy("seed").collect()


def names(row):
    return {s.name: round(s.amount, 4) for s in row.signals}


def test_top_k(spark):
    rows = spark.createDataFrame([("a", [0.95, 0.05, 0.0]), ("b", [0.25, 0.75, 0.0]), ("c", [0.6, 0.4, 0.0]), ("z", None), ("n", [float("nan"), 0.0, 0.0]), ("s", [1.0])], "id string, v array<float>")
    assert [r.id for r in search.top_k(rows, [1, 0, 0], 2, normalised=True).collect()] == ["a", "c"]
    wide = spark.createDataFrame([("a", [10.0, 0.0, 0.0]), ("b", [1.0, 1.0, 0.0]), ("c", [0.6, 0.4, 0.0]), ("o", [0.0, 0.0, 0.0])], "id string, v array<float>")
    assert [r.id for r in search.top_k(wide, [1, 0, 0], 4).collect()] == ["a", "c", "b", "o"]
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None)], "query_id int, v array<float>")
    got = search.top_k_batch(wide.repartition(3), q, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, "a"), (1, "c"), (2, "b"), (2, "c")]
    assert search.top_k_batch(wide.limit(0), q, 2).count() == 0 and search.top_k_batch(wide, q.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        search.top_k_batch(wide, q, 0)


def test_top_k_ties_and_many_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)).round(2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(5)], "id int, v array<double>")
    q = rows.filter("id % 100 = 0 AND id < 500").withColumnRenamed("id", "query_id")
    got = {}
    for r in search.top_k_batch(rows.repartition(7), q, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    full = np.vstack([x, *[x[:1]] * 5])
    ids = [*range(500), *range(1000, 1005)]
    u = full / np.linalg.norm(full, axis=1)[:, None]
    for k, v in got.items():
        s = u @ u[ids.index(k)]
        assert [i for _, i in sorted(v)] == [i for _, i in sorted(zip((-s).round(12), ids))[:4]]


def test_tiny_chunk_loses(spark):
    body = "The scope of the work covers planning and delivery. " * 3
    got = ranked(found(spark, "work plan", (0.99, "Work plan", "Work plan", ["heading"], 1), (0.95, "Work plan", body, ["paragraph"], 2)))
    assert got[0].chunk_id == "c2" and names(got[1])["tiny_chunk"] == -0.22 and "heading_body" in names(got[0])
    assert names(got[0])["adjacent_section"] == 0.04


def test_boilerplate_and_scope(spark):
    admin, scope = "This master services agreement sets terms and conditions for both sides of it. " * 2, "The project scope includes the rollout and the training of all teams on site. " * 2
    rows = ((0.99, "Agreement", admin, ["paragraph"], 2), (0.93, "Project Scope", scope, ["paragraph"], 2))
    got = ranked(found(spark, "what is the scope", *rows))
    assert got[0].chunk_id == "c2" and names(got[0])["scope_section"] == 0.46 and names(got[1])["boilerplate"] == -0.55
    got = ranked(found(spark, "who is the contact of the agreement", *rows))
    assert got[0].chunk_id == "c1" and "boilerplate" not in names(got[0])


def test_out_of_scope(spark):
    t = "Text that is long enough to have no penalty at all for being tiny, as it has many words."
    got = ranked(found(spark, "what is out of scope", (0.9, "In scope", t, [], 2), (0.9, "Out of scope", t, [], 2)))
    assert got[0].chunk_id == "c2" and names(got[0])["scope_section"] == 0.34
    got = ranked(found(spark, "scope", (0.99, "Out of scope", t, [], 2), (0.93, "Project scope", t, [], 2)))
    assert [names(r)["scope_section"] for r in got] == [0.46, 0.24]


def test_no_query_tokens_and_nulls(spark):
    got = ranked(found(spark, "???", (0.5, None, None, None, None)).union(found(spark, None, (0.5, None, None, None, None)).withColumn("query_id", F.lit(2))))
    assert all(r.rerank_delta == 0 and r.signals == [] for r in got)


def test_reasons(spark):
    df = spark.createDataFrame([([("title_overlap", 0.22), ("tiny_chunk", -0.22)],)], "s array<struct<name:string,amount:double>>")
    assert df.select(rerank.reasons("s")).first()[0] == ["boost:title_overlap(+0.22)", "penalty:tiny_chunk(-0.22)"]


def test_expansion(spark):
    chunks = spark.createDataFrame([("s", "f", "Scope", 10, "f"), ("n", "f", "Scope", 11, "f"), ("x", "f", "Other", 30, "f"), ("y", "f", "scope", 90, "f"), ("z", "g", "Scope", 10, "g"), ("w", "f", None, None, "f")], "chunk_id string, source_file string, title string, order_start int, file_name string").fillna("", "title")
    seeds = chunks.filter("chunk_id = 's'").withColumns({"query_id": F.lit(1), "seed": F.lit(0), "final_score": F.lit(0.9)})
    got = expand.expanded(seeds, chunks).orderBy("place").collect()
    assert [(r.chunk_id, r.relationship) for r in got] == [("s", "semantic_seed"), ("n", "same_section"), ("y", "same_section")]
    assert [r.score for r in got] == [0.9, 0.0, 0.0]
    assert expand.expanded(seeds, chunks, most=1).count() == 1
    with pytest.raises(ValueError):
        expand.expanded(seeds, chunks, window=-1)


def test_prompts(spark):
    r = spark.createDataFrame([(1, 1, "a.pdf", None, "Some text", "", 0.5), (1, 2, None, "S", None, "only preview", None)], "query_id int, place int, file_name string, section_title string, text string, preview string, score double")
    c = answer.citations(r).orderBy("index").collect()
    assert [(x["index"], x.source, x.section, x.text, x.score) for x in c] == [(1, "a.pdf", "Untitled section", "Some text", 0.5), (2, "Unknown source", "S", "only preview", None)]
    q = spark.createDataFrame([(1, " Why? "), (2, None)], "query_id int, query string")
    p = {x.query_id: x for x in answer.prompts(q, answer.citations(r)).collect()}
    assert p[1].prompt.index("[1] Source: a.pdf") < p[1].prompt.index("[2] Source") < p[1].prompt.index("Question:\nWhy?")
    assert answer.NO_CONTEXT in p[2].prompt and not p[2].has_context
    got = {x.query_id: x.answer for x in answer.answers(answer.prompts(q, answer.citations(r)), lambda: lambda prompt: " Because [1]. ").collect()}
    assert got == {1: "Because [1].", 2: answer.REFUSAL}


RECORD = "chunk_id string, source_file string, file_name string, text string, embedding array<float>, order_start int, embedded_at timestamp"


def test_store(spark, tmp_path):
    rows = [("a", "f", "f", "one", [1.0], 1, T0), ("b", "f", "f", "none", [], 2, T0), (None, "f", "f", "no id", [1.0], 3, T0), (" ", "f", "f", "blank", [1.0], 4, T0), ("n", "f", "f", "nan", [math.nan], 5, T0)]
    path = str(tmp_path / "store")
    assert store.upsert(spark, path, spark.createDataFrame(rows, RECORD)) == {"records_seen": 5, "records_stored": 3}
    assert {r.chunk_id for r in store.opened(spark, path).collect()} == {"a", "f::record_000000", "f::record_000001"}
    later = [("a", "f", "f", "two", [2.0], 1, T0 + dt.timedelta(1)), ("a", "f", "f", "old", [3.0], 1, T0)]
    store.upsert(spark, path, spark.createDataFrame(later, RECORD))
    assert {(r.chunk_id, r.text) for r in store.opened(spark, path).filter("chunk_id = 'a'").collect()} == {("a", "two")} and store.opened(spark, path).count() == 3
    store.upsert(spark, path, spark.createDataFrame(later, RECORD), reset=True)
    assert store.opened(spark, path).count() == 1


def test_store_of_whole_files(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(f"{f}{n}", f, f, "t", [1.0], n, T0) for f in "ab" for n in range(3)]
    store.upsert(spark, path, spark.createDataFrame(rows, RECORD))
    store.upsert(spark, path, spark.createDataFrame([("a0", "a", "a", "new", [1.0], 0, T0)], RECORD), whole_files=True)
    assert {(r.chunk_id, r.text) for r in store.opened(spark, path).collect()} == {("a0", "new"), ("b0", "t"), ("b1", "t"), ("b2", "t")}
    with pytest.raises(ValueError, match="no store"):
        store.opened(spark, str(tmp_path / "none"))


def test_json_and_documents(spark):
    df = spark.createDataFrame([(["a", 'q"é'], [1, 2], "", " text "), ([], None, "r", "t")], "s array<string>, n array<int>, retrieval_text string, text string")
    assert [tuple(r) for r in df.select(store.json_text("s"), store.json_text("n"), store.document()).collect()] == [('["a", "q\\"é"]', "[1, 2]", "text"), ("[]", None, "r")]


def test_model_name(spark):
    runs = spark.createDataFrame([(("old",), 1), (("new",), 2), ((" ",), 3), (None, 4)], "model struct<name:string>, created_at int")
    assert store.model_name(runs, "x") == "new" and store.model_name(runs.limit(0), "x") == "x"


def test_encoding(spark):
    c = spark.createDataFrame([("c", "f.docx", "f.docx", "section", ["A", "B"], None, "Head", "Body text")], "chunk_id string, file_name string, source_file string, chunk_type string, section_path array<string>, section_title string, heading string, text string")
    got = encode.embedded(c).first()
    assert got.retrieval_text == "Source File: f.docx\nChunk Type: section\nSection Path: A > B\nHeading: Head\nContent:\nBody text"
    assert len(got.embedding) == 64 and abs(sum(x * x for x in got.embedding) - 1) < 1e-5
    assert "Heading" not in encode.embedded(c.withColumn("text", F.lit("head \nmore"))).first().retrieval_text
    assert encode.embedded(c.withColumn("text", F.lit(None).cast("string"))).first().retrieval_text.endswith("Content:")


def test_encoders_of_two_roles(spark):
    def load():
        class Model:
            def encode_document(self, texts):
                return np.array([[3.0, 4.0]] * len(texts))

            def encode_query(self, texts):
                return np.array([[0.0, 2.0]] * len(texts))

        return Model()

    df = spark.createDataFrame([("x",)], "t string")
    both = df.select(encode.encoder_udf(load)("t").alias("d"), encode.encoder_udf(load, role="query")("t").alias("q"), encode.encoder_udf(load, normalise=False)("t").alias("raw")).first()
    assert [round(x, 6) for x in both.d] == [0.6, 0.8] and list(both.q) == [0.0, 1.0] and list(both.raw) == [3.0, 4.0]


def test_answer_stream():
    assert list(answer.answer_stream("p", True, lambda p: ["a", "", "b"])) == ["a", "b"]
    assert list(answer.answer_stream("p", False, lambda p: ["a"])) == [answer.REFUSAL]


def test_text_functions(spark):
    row = lambda **kw: spark.createDataFrame([tuple(kw.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in kw.items()))
    val = lambda df, c: df.select(c).first()[0]
    assert val(row(t="a \t b\r\n\n\n\nc  "), T.clean_text("t")) == "a b\n\nc"
    assert val(row(t=None), T.clean_text("t")) == ""
    assert val(row(t=" a b\x1cc\n\nd "), T.narrative("t")) == "a b c d"
    assert val(row(p=["one", " ", 'two"', "three"]), T.join_parts("p")) == 'one. two" three.'
    assert val(row(t="Scope\n\nThis\n\nproject\n\nruns\n\nlong\n\n,\n\nvery\n\nlong"), T.retrieved_text("t", F.lit("Scope"))) == "Scope: This project runs long, very long."
    assert val(row(t="x" * 300), T.preview("t")) == "x" * 257 + "..."
    assert val(row(t="été ça !"), T.token_estimate("t")) == 3
    assert val(row(t="PROJECT PLAN"), T.heading_score("t", True)) == 7


def test_stream_into_store(spark, tmp_path):
    from test_chunker import blocks
    from leafmill.streaming.ingest import blocks_per_hour, new_rows, store_blocks

    source, path = tmp_path / "in", str(tmp_path / "store")
    rows = [("h", "heading", "A", ["A"]), ("p", "paragraph", "Body text.", ["A"])]
    blocks(spark, rows).write.parquet(str(source))
    schema = blocks(spark, rows).schema
    for file in ("b.docx", None):
        q = store_blocks(new_rows(spark, str(source), schema), path, str(tmp_path / "check"))
        q.awaitTermination()
        if file:
            blocks(spark, rows, file).write.mode("append").parquet(str(source))
    assert {r.chunk_id for r in store.opened(spark, path).collect()} == {"a.docx::chunk_0001", "b.docx::chunk_0001"}
    q = blocks_per_hour(new_rows(spark, str(source), schema)).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n_blocks for r in spark.table("hours").collect()] == [2]
