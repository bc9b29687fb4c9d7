"""Passages of evaluation items inside corpus documents.

A prefix-filtered set join over shingles of five words. The items' shingles are ordered by rarity in the whole
corpus. A shared run of `run` words shares every shingle of the run, so the rarest shingle of each run of an item
is its necessary prefix: only these tokens are joined. A hit gives the alignment of document and item; the length
bound (both have at least `run` words) and the positional bound (only the window of the item's size at that
alignment) leave little to verify, and the longest common run there is found exactly, word position by word position.

Only shingles that occur in the items leave the scan of the corpus. Up to MOST_BROADCAST item shingles they are
looked up in a sorted array that every task holds; beyond that the corpus's shingles are joined by shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.words import list_parts, shingles, word_hashes
from leafmill.tables import written

SHINGLE = 5
RUN = 12
MOST_BROADCAST = 2_000_000
_AT = "array<struct<pos:int,h:bigint>>"


def _rows(batches: Iterator[pa.RecordBatch], known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """id, at: the shingles of each row (those in `known`, a sorted array) with their positions."""
    for batch in batches:
        values, offsets = list_parts(batch.column("words"))
        h, row, pos = shingles(values, offsets, SHINGLE)
        enough = (np.diff(offsets) >= RUN)[row]
        h, row, pos = h[enough], row[enough], pos[enough]
        if known is not None and len(known):
            keep = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            h, row, pos = h[keep], row[keep], pos[keep]
        elif known is not None:
            h, row, pos = h[:0], row[:0], pos[:0]
        counts = np.bincount(row, minlength=batch.num_rows)
        at = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array(h.view(np.int64))], ["pos", "h"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), at)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(full)), lists.take(pa.array(full))], ["id", "at"])


def _shingled(df: DataFrame, key: str, known=None) -> DataFrame:  # noqa: ANN001
    rows = df.filter(F.col("text").isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), word_hashes("text").alias("words"))
    return rows.mapInArrow(lambda it: _rows(it, known.value if known is not None else None), f"id bigint, at {_AT}")


def corpus_hits(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Each document with the item shingles in it: doc_id, at (positions and hashes). `items`: item_id, at."""
    tokens = items.select(F.explode("at.h").alias("h")).distinct()
    if tokens.count() <= MOST_BROADCAST:  # by a count; the array is 8 bytes a shingle of the items
        known = np.sort(tokens.toArrow().column("h").to_numpy().view(np.uint64))
        return _shingled(documents, "doc_id", documents.sparkSession.sparkContext.broadcast(known)).withColumnRenamed("id", "doc_id")
    each = _shingled(documents, "doc_id").select(F.col("id").alias("doc_id"), F.inline("at"))
    return each.join(tokens, "h", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("pos", "h"))).alias("at"))


def prefix_tokens(items: DataFrame, hits: DataFrame, run: int = RUN) -> DataFrame:
    """The necessary tokens of each item: item_id, pos, h. One for each run of `run` words of which all shingles
    occur in the corpus: the rarest (by documents that hold it, then by hash)."""
    df = hits.select("doc_id", F.explode("at.h").alias("h")).distinct().groupBy("h").agg(F.count("*").alias("df"))
    each = items.select("item_id", F.inline("at")).join(df, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    w = Window.partitionBy("item_id").orderBy("pos").rowsBetween(0, run - SHINGLE)
    first = each.select("item_id", F.min(F.struct("df", "h", "pos")).over(w).alias("t"), F.count("*").over(w).alias("n"))
    return first.filter(f"n = {run - SHINGLE + 1} AND t.df > 0").select("item_id", "t.pos", "t.h").distinct()


def _verify(run: int):  # noqa: ANN202
    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                here = {x["pos"]: x["h"] for x in r.doc_at}
                best, start, length, last = (0, 0), 0, 0, None
                for x in sorted(r.item_at, key=lambda x: x["pos"]):
                    p = x["pos"]
                    if here.get(r.shift + p) != x["h"]:
                        length = 0
                    else:
                        start, length = (start, length + 1) if length and p == last + 1 else (p, 1)
                        best = max(best, (length, -start))
                    last = p
                if (words := best[0] + SHINGLE - 1) >= run and best[0]:
                    out.append((r.doc_id, r.item_id, r.shift - best[1] + 1, -best[1] + 1, words))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

    return windows


def leaks(documents: DataFrame, eval_items: DataFrame, run: int = RUN) -> DataFrame:
    """Every run of at least `run` consecutive words that a document and an item share, the longest of each alignment:
    doc_id, item_id, doc_word and item_word (where it begins, from 1), n_words.

    Null and empty texts, null ids and texts of fewer than `run` words are in no row. Repeated rows of a document or
    item count once. Columns beside the ids and text are ignored."""
    if run < RUN:
        raise ValueError(f"run must be at least {RUN}")
    items = written(_shingled(eval_items, "item_id").withColumnRenamed("id", "item_id").dropDuplicates(["item_id"]), "items")
    hits = written(corpus_hits(documents, items), "hits")
    prefix = prefix_tokens(items, hits, run)
    each = hits.select("doc_id", F.inline("at").alias("doc_pos", "h"))
    shifts = each.join(prefix.withColumnRenamed("pos", "item_pos"), "h").select("doc_id", "item_id", (F.col("doc_pos") - F.col("item_pos")).alias("shift")).distinct()
    windows = shifts.join(items.withColumnRenamed("at", "item_at"), "item_id").join(hits.withColumnRenamed("at", "doc_at").dropDuplicates(["doc_id"]), "doc_id")
    return windows.mapInPandas(_verify(run), "doc_id bigint, item_id bigint, doc_word int, item_word int, n_words int")
