"""Evidence for answers: numbered citations, prompts, and batches of generated answers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.tables import stripped

INSTRUCTIONS = "Answer from the evidence below and from nothing else. Say exactly what is missing where it does not suffice."
REQUIREMENTS = "Begin with the direct answer.\nGive the evidence it rests on.\nCite evidence by number, such as [1].\nName what was not found."
NO_CONTEXT = "No retrieved context was provided."
REFUSAL = "There is no retrieved context to answer from."


def citations(results: DataFrame) -> DataFrame:
    """query_id, index (from 1, in order of place), source, section, text, score, with defaults for what is missing."""
    w = Window.partitionBy("query_id").orderBy("place")
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    return results.select(
        "query_id", F.row_number().over(w).alias("index"), F.coalesce(full("file_name"), F.lit("Unknown source")).alias("source"),
        F.coalesce(full("section_title"), F.lit("Untitled section")).alias("section"), F.coalesce(full("text"), full("preview"), F.lit("")).alias("text"), F.col("score").try_cast("double").alias("score"),
    )


def evidence(cited: DataFrame) -> DataFrame:
    """One numbered text of all citations of each query, in order: query_id, context."""
    block = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] Source: "), "source", F.lit("\nSection: "), "section", F.lit("\nContent: "), "text")
    return cited.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def prompts(queries: DataFrame, cited: DataFrame) -> DataFrame:
    """The prompt of each query (query_id, query): instructions, evidence, question, requirements."""
    joined = queries.join(evidence(cited), "query_id", "left")
    return joined.select(
        "query_id",
        F.concat_ws("\n\n", F.lit(INSTRUCTIONS), F.concat(F.lit("Retrieved context:\n"), F.coalesce("context", F.lit(NO_CONTEXT))), F.concat(F.lit("Question:\n"), stripped(F.coalesce("query", F.lit("")))), F.lit("Answer requirements:\n" + REQUIREMENTS)).alias("prompt"),
        F.col("context").isNotNull().alias("has_context"),
    )


def answer_stream(prompt: str, has_context: bool, generate: Callable[[str], Iterable[str]]) -> Iterator[str]:
    """The parts of one answer as the text generator gives them; without context only a refusal."""
    if not has_context:
        yield REFUSAL
        return
    yield from filter(None, generate(prompt))


def answers(prompted: DataFrame, load: Callable[[], Callable[[str], str]]) -> DataFrame:
    """query_id and answer from a text generator that `load` opens once per task. Without context the answer is a refusal,
    and an empty reply is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if not r.has_context:
                    out.append(REFUSAL)
                    continue
                generate = generate or load()
                reply = (generate(r.prompt) or "").strip()
                if not reply:
                    raise ValueError("the text generator gave an empty reply")
                out.append(reply)
            yield pd.DataFrame({"query_id": b["query_id"], "answer": out})

    return prompted.mapInPandas(run, f"query_id {dict(prompted.dtypes)['query_id']}, answer string")
