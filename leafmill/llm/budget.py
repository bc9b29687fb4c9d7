"""How many tokens each text has under a public tokenizer, and the totals of each source, language and domain.

The texts' distinct pieces are counted over all texts. Each distinct piece is stored as an array of symbols (bytes at
first); its adjacent pairs are joined with the vocabulary's merge ranks and the lowest ranked merge is applied, again
and again until no pair merges, and what is left is counted. That is done once a piece however often it occurs. The
most frequent pieces (at most FREQUENT) are looked up by every task; only a text's rarer pieces are shuffled, to be
joined with their lengths, so a piece that all texts hold never makes a group."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.bpe import Vocabulary, default_path, distinct_pieces, split, texts_of
from leafmill.tables import written

FREQUENT = 65_536
MISSING = "(missing)"


def _lengths(vocabulary: Broadcast):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = [p.encode("utf-8", "surrogatepass") for p in batch.column("piece").to_pylist()]
            _, sizes = vocabulary.value.merge(symbols)
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array(sizes.astype(np.int32))], ["piece", "n", "n_tokens"])

    return run


def piece_lengths(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Each distinct piece of all texts, how often it occurs, and its number of tokens: piece, n, n_tokens."""
    return distinct_pieces(texts).mapInArrow(_lengths(texts.sparkSession.sparkContext.broadcast(vocabulary)), "piece string, n bigint, n_tokens int")


def _count(frequent: Broadcast):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            for part, texts in texts_of(batch, "text"):
                rows, tokens, pieces, times = [], [], [], []
                for r, text in enumerate(texts):
                    total, rare = 0, []
                    for p in split(text) if text else ():
                        n = known.get(p)
                        if n is None:
                            rare.append(p)
                        else:
                            total += n
                    rows.append(r)
                    tokens.append(total)
                    pieces.append(None)
                    times.append(0)
                    for p, n in Counter(rare).items():
                        rows.append(r)
                        tokens.append(0)
                        pieces.append(p)
                        times.append(n)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("kind").take(take), part.column("id").take(take), pa.array(tokens, pa.int64()), pa.array(pieces, pa.string()), pa.array(times, pa.int64())], ["kind", "id", "tokens", "piece", "times"])

    return run


def token_counts(texts: DataFrame, path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """kind, id, n_tokens of each text. texts: kind, id, text. Null and empty texts have 0 tokens. A repeated row
    counts once; ids are strings."""
    texts = texts.select("kind", "id", "text")
    lengths = written(piece_lengths(texts, Vocabulary(path or default_path())), "lengths")
    top = lengths.orderBy(F.desc("n"), "piece").limit(frequent).toArrow()
    known = dict(zip(top.column("piece").to_pylist(), top.column("n_tokens").to_pylist(), strict=True))
    parts = written(texts.mapInArrow(_count(texts.sparkSession.sparkContext.broadcast(known)), "kind string, id string, tokens bigint, piece string, times bigint"), "parts")
    whole = parts.filter("piece IS NULL").dropDuplicates(["kind", "id"])
    rare = parts.filter("piece IS NOT NULL").distinct().join(lengths.select("piece", "n_tokens"), "piece").select("kind", "id", (F.col("times") * F.col("n_tokens")).alias("tokens"))
    return whole.select("kind", "id", "tokens").union(rare).groupBy("kind", "id").agg(F.sum("tokens").alias("n_tokens"))


def slice_name(c: str) -> Column:
    """A slice's name in lower case; null and blank ones are one slice of their own."""
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit(MISSING))


def with_counts(blocks: DataFrame, documents: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks (block_id, doc_type, source_file) and documents (doc_id, source, lang, domain), each once, with n_tokens."""
    b = blocks.select(F.lit("block").alias("kind"), F.col("block_id").alias("id"), "text")
    d = documents.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), "text")
    counts = written(token_counts(b.union(d), path), "counts")
    own = counts.filter("kind = 'block'").select(F.col("id").alias("block_id"), "n_tokens")
    docs = counts.filter("kind = 'document'").select(F.col("id").cast("bigint").alias("doc_id"), "n_tokens")
    return (
        blocks.select("block_id", "doc_type", "source_file").dropDuplicates(["block_id"]).join(own, "block_id"),
        documents.select("doc_id", "source", "lang", "domain").dropDuplicates(["doc_id"]).join(docs, "doc_id"),
    )


def budget(blocks: DataFrame, documents: DataFrame, source_files: DataFrame, path: str | None = None) -> DataFrame:
    """The totals: kind (block or document), doc_type, source, lang, domain, n_texts, n_tokens.

    Blocks by doc_type and source_file with lang and domain of the file's latest row in source_files, documents by
    source, lang and domain. Names are lower-cased except sources; what is null or blank, or a file without a row,
    is the slice "(missing)", and a file without blocks is a slice of 0 texts. Null ids are left out."""
    b, d = with_counts(blocks, documents, path)
    files = (
        source_files.filter(F.col("source_file").isNotNull())
        .groupBy("source_file")
        .agg(F.max(F.struct("ingested_at", slice_name("lang").alias("lang"), slice_name("domain").alias("domain"), "doc_type")).alias("f"))
        .select("source_file", "f.lang", "f.domain", F.col("f.doc_type").alias("file_type"))
    )
    per_file = b.groupBy("doc_type", "source_file").agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"))
    of_blocks = per_file.join(files, "source_file", "full").select(
        F.lit("block").alias("kind"), slice_name("doc_type").alias("t"), slice_name("file_type").alias("u"), F.coalesce("source_file", F.lit(MISSING)).alias("source"),
        F.coalesce("lang", F.lit(MISSING)).alias("lang"), F.coalesce("domain", F.lit(MISSING)).alias("domain"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
    )
    of_blocks = of_blocks.withColumn("doc_type", F.when(F.col("t") == MISSING, F.col("u")).otherwise(F.col("t")))
    of_docs = d.groupBy(F.coalesce("source", F.lit(MISSING)).alias("source"), slice_name("lang").alias("lang"), slice_name("domain").alias("domain")).agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"))
    columns = ["kind", "doc_type", "source", "lang", "domain", "n_texts", "n_tokens"]
    return of_blocks.select(*columns).union(of_docs.withColumns({"kind": F.lit("document"), "doc_type": F.lit("(all)")}).select(*columns))
