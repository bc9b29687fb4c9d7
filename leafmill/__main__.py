"""Command line: python -m leafmill build FOLDER WORK | ask WORK QUESTION | counts WORK."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from leafmill.operators.chunker import ChunkConfig
from leafmill.operators.store import opened
from leafmill.plans import pipeline
from leafmill.session import ship
from leafmill.sources.stages import read_stage
from leafmill.tables import discard


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="leafmill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="ingest, chunk, embed and store the files of a folder")
    b.add_argument("folder")
    b.add_argument("work")
    b.add_argument("--max-chars", type=int, default=2000)
    b.add_argument("--max-tokens", type=int, default=380)
    b.add_argument("--overlap-tokens", type=int, default=40)
    b.add_argument("--permissive", action="store_true", help="pass over files that can't be read")
    b.add_argument("--reset", action="store_true", help="drop what the store holds")
    a = sub.add_parser("ask", help="show the best chunks for a question")
    a.add_argument("work")
    a.add_argument("question")
    a.add_argument("--store", help="the store's path, if it isn't WORK/store")
    a.add_argument("--top-k", type=int, default=5)
    a.add_argument("--candidate-k", type=int, default=25)
    a.add_argument("--mode", choices=("debug", "compact", "text"), default="debug")
    c = sub.add_parser("counts", help="count blocks and chunks by type")
    c.add_argument("work")
    o = p.parse_args(args)
    spark = SparkSession.builder.appName("leafmill").getOrCreate()
    ship(spark)
    if o.command == "build":
        print(pipeline.build(spark, o.folder, o.work, ChunkConfig(o.max_chars, o.max_tokens, o.overlap_tokens), permissive=o.permissive, reset=o.reset))
        discard(spark)
    elif o.command == "ask":
        found = pipeline.results(pipeline.retrieve(opened(spark, o.store or f"{o.work}/store"), pipeline.questions(spark, [o.question]), o.top_k, o.candidate_k)).orderBy("place")
        shown = {"debug": found, "compact": found.drop("text", "reasons", "rerank_delta", "query_id"), "text": found.select("text")}[o.mode]
        for line in shown.toJSON().toLocalIterator():
            print(line)
        discard(spark)
    else:
        read_stage(spark, f"{o.work}/blocks").groupBy("doc_type", "block_type").count().orderBy("doc_type", "block_type").show(100, False)
        read_stage(spark, f"{o.work}/chunks").groupBy("doc_type", "chunk_type").count().orderBy("doc_type", "chunk_type").show(100, False)


if __name__ == "__main__":
    main()
