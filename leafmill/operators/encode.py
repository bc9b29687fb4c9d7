"""Texts for embedding, and encoders."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from leafmill.functions.text import LINE_END, narrative
from leafmill.tables import stripped

Encoder = Callable[[list[str]], np.ndarray]


def retrieval_text(section_path: str = "section_path") -> Column:
    """The text that is embedded for a chunk: file, type, title, path and heading, then the content."""
    text = stripped(F.coalesce("text", F.lit("")))
    path = F.array_join(F.filter(section_path, lambda x: x != ""), " > ")
    lines = F.filter(F.transform(F.split(text, LINE_END), narrative), lambda x: x != "")
    repeated = F.lower(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))) == F.nullif(F.lower(narrative("heading")), F.lit(""))
    title = stripped(F.coalesce("section_title", F.lit("")))
    return stripped(F.concat_ws(
        "\n",
        F.concat(F.lit("Source File: "), F.coalesce(F.nullif("file_name", F.lit("")), "source_file", F.lit(""))),
        F.concat(F.lit("Chunk Type: "), F.coalesce("chunk_type", F.lit(""))),
        F.when(title != "", F.concat(F.lit("Section Title: "), title)),
        F.when(path != "", F.concat(F.lit("Section Path: "), path)),
        F.when((F.coalesce("heading", F.lit("")) != "") & ~F.coalesce(repeated, F.lit(False)), F.concat(F.lit("Heading: "), "heading")),
        F.lit("Content:"),
        text,
    ))


def hashing_encoder(dimension: int = 64) -> Encoder:
    """A deterministic encoder that needs no model: signed counts of ASCII words by their MD5, as unit vectors. A text
    without such a word is the zero vector."""
    word = re.compile("[a-z0-9]+")

    @lru_cache(1 << 18)
    def place(w: str) -> tuple[int, int]:
        h = hashlib.md5(w.encode()).hexdigest()
        return int(h[:8], 16) % dimension, 1 if h[8] >= "8" else -1

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for r, t in enumerate(texts):
            for w in word.findall(t.lower()):
                at, sign = place(w)
                out[r, at] += sign
        n = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)

    return encode


def encoder_udf(load: Callable[[], Encoder], batch: int = 32, role: str = "document", normalise: bool = True) -> Callable[[Column | str], Column]:
    """A Column function that embeds texts. `load` runs once for each Python worker and gives the model: a function, or an
    object with functions encode_document and encode_query where it encodes questions in another way (role "query").
    With `normalise`, vectors are given length 1 (zero vectors stay)."""
    if role not in ("document", "query"):
        raise ValueError(f"no such role: {role}")

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        encode = getattr(model, f"encode_{role}", model)
        for s in batches:
            texts = s.fillna("").tolist()
            rows = []
            for start in range(0, len(texts), batch):
                x = np.asarray(encode(texts[start : start + batch]), np.float64)
                if normalise and not np.allclose(n := np.sqrt((x * x).sum(1, keepdims=True)), 1, atol=1e-12):
                    x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
                rows += list(x.astype(np.float32))
            yield pd.Series(rows, index=s.index, dtype=object)

    return embed


def embedded(chunks: DataFrame, load: Callable[[], Encoder] = hashing_encoder, normalise: bool = True) -> DataFrame:
    """Chunks with retrieval_text and embedding. Null texts count as empty."""
    return chunks.withColumn("retrieval_text", retrieval_text()).withColumn("embedding", encoder_udf(load, normalise=normalise)("retrieval_text"))


def run_summary(records: DataFrame) -> DataFrame:
    """One row for each run: run_id, embedding_dimension (the longest), source_document_count, chunk_count."""
    return records.groupBy("run_id").agg(
        F.max(F.size("embedding")).alias("embedding_dimension"),
        F.countDistinct("source_file").alias("source_document_count"),
        F.countDistinct("chunk_id").alias("chunk_count"),
    )
