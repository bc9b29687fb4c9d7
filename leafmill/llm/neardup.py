"""Records that are similar beyond a threshold, from small edits, insertions or another order.

Each record's set of word shingles has a fingerprint of 90 components (min-hashes, 16 bits each). Components agree
about as often as two sets overlap, so similar records have a small Hamming distance in components. Pigeonhole
blocks: the fingerprint is split into 30 blocks of 3 components. Two records at most 29 components apart share a
block for certain (fewer differing components than blocks). A pair of a similarity of 0.6 is 36 apart on average, and shares a
block with a probability of 0.9993; at 0.65 of 0.99995, at 0.8 of all but 10^-9. Records are
joined on blocks, the Hamming distance of the pairs is checked, and then the similarity exactly, on the shingles.

Records with one set of shingles are copies: they are one representative from the start, and only memberships put
them back. A block value shared by more than MOST_IN_BLOCK representatives isn't joined; its records are joined
on their rarest shingles instead (an exact prefix filter): only records whose rarest shingles are common meet there in numbers.

The results are pairs of representatives and memberships (`similar_sets`) or a row per record (`groups`); `similar_pairs`
lists all pairs of records, copies included, and is as long as that list."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.words import list_parts, mixed, shingles, word_hashes
from leafmill.tables import written

BLOCKS, ROWS = 30, 3
COMPONENTS = BLOCKS * ROWS
MOST_IN_BLOCK = 500
MOST_NAMED = 1_000_000  # 8 bytes each
MIN_WORDS = 20
SHINGLE = 5
SIMILARITY = 0.8
_SEEDS = mixed(np.arange(1, COMPONENTS + 1, dtype=np.uint64)) | np.uint64(1)


def most_apart(similarity: float) -> int:
    """The Hamming distance in components that a pair of this similarity exceeds with a probability below 0.0003."""
    return math.ceil(COMPONENTS * (1 - similarity) + 3.5 * math.sqrt(COMPONENTS * similarity * (1 - similarity)))


def _sets(batch: pa.RecordBatch, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each row of enough words, sorted: hashes, rows, and the rows' numbers of shingles."""
    words, offsets = list_parts(batch.column("words"))
    h, row, _ = shingles(words, offsets, k)
    enough = (np.diff(offsets) >= min_words)[row]
    h, row = h[enough], row[enough]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, row, np.bincount(row, minlength=batch.num_rows)


def _set_keys(batch: pa.RecordBatch, h: np.ndarray, starts: np.ndarray, full: np.ndarray) -> np.ndarray:
    """One 64-bit key of each non-empty row's kind and set of shingles."""
    kinds = batch.column("kind").take(pa.array(full)).dictionary_encode()
    salt = mixed(np.array([int.from_bytes(str(x).encode()[:8], "little") for x in kinds.dictionary.to_pylist()], np.uint64))[kinds.indices.to_numpy()]
    return mixed(np.add.reduceat(mixed(h), starts) + salt).view(np.int64)


def _fingerprints(k: int, min_words: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, row, counts = _sets(batch, k, min_words)
            full = np.flatnonzero(counts)
            if not len(full):
                continue
            starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
            components = np.empty((len(full), COMPONENTS), np.int16)
            for j, seed in enumerate(_SEEDS):
                components[:, j] = (mixed(np.minimum.reduceat(h * seed, starts)) >> np.uint64(48)).astype(np.uint16).view(np.int16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, components.size + 1, COMPONENTS, dtype=np.int32)), pa.array(components.ravel()))
            take = pa.array(full)
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind").take(take), batch.column("id").take(take), pa.array(_set_keys(batch, h, starts, full)), pa.array(counts[full].astype(np.int32)), lists],
                ["kind", "id", "rep", "n", "components"],
            )

    return run


def _shingle_sets(k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, row, counts = _sets(batch, k, k)
            full = np.flatnonzero(counts)
            if not len(full):
                continue
            ends = np.cumsum(counts[full])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("kind").take(pa.array(full)), pa.array(_set_keys(batch, h, np.concatenate([[0], ends[:-1]]), full)), lists], ["kind", "rep", "shingles"])

    return run


def _with_words(records: DataFrame) -> DataFrame:
    """Too short texts are left out later: a filter here would cut every text into words twice, and before any join."""
    return records.select("kind", "id", word_hashes("text").alias("words"))


def fingerprints(records: DataFrame, k: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """kind, id, rep (key of the shingle set; copies share it), n (shingles), components. Records of fewer words are left out."""
    return _with_words(records).mapInArrow(_fingerprints(k, max(min_words, k)), "kind string, id string, rep bigint, n int, components array<smallint>")


def shingle_sets(records: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """kind, rep and shingles of the records named in `ids` (kind, id), and perhaps of a few others whose hash is the same.

    Up to MOST_NAMED names, by a count, their hashes are sent to all tasks, so that only texts that are needed move;
    more are joined by shuffle."""
    key = F.xxhash64("kind", "id").alias("key")
    names = written(ids.select(key).distinct(), "names")
    few = F.broadcast(names) if names.count() <= MOST_NAMED else names
    return _with_words(records.withColumn("key", key).join(few, "key", "left_semi")).mapInArrow(_shingle_sets(k), "kind string, rep bigint, shingles array<bigint>").dropDuplicates(["rep"])


def _sized(a: str, b: str, similarity: float) -> str:
    """SQL: the sizes alone allow the similarity."""
    return f"least({a}, {b}) >= {similarity} * greatest({a}, {b}) - 1e-9"


def block_pairs(reps: DataFrame, blocks: DataFrame, similarity: float) -> DataFrame:
    """The pairs that share a block and aren't too far apart: a, b (a < b)."""
    b = blocks.select("block", F.col("rep").alias("b"), F.col("n").alias("n_b"))
    pairs = blocks.select("block", F.col("rep").alias("a"), F.col("n").alias("n_a")).join(b, "block").filter(f"a < b AND {_sized('n_a', 'n_b', similarity)}").select("a", "b").distinct()
    ca = reps.select(F.col("rep").alias("a"), F.col("components").alias("ca"))
    cb = reps.select(F.col("rep").alias("b"), F.col("components").alias("cb"))
    apart = F.size(F.filter(F.zip_with("ca", "cb", lambda x, y: x != y), lambda x: x))
    return pairs.join(ca, "a").join(cb, "b").filter(apart <= most_apart(similarity)).select("a", "b")


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of one kind that share one of their rarest shingles, as every pair of the similarity does: a, b (a < b)."""
    each = sets.select("kind", "rep", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    ranked = each.join(each.groupBy("kind", "token").agg(F.count("*").alias("df")), ["kind", "token"]).withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy("df", "token")))
    kept = ranked.filter(f"rank <= n - ceil({similarity} * n - 1e-9) + 1").select("kind", "token", "rep", "n")
    b = kept.select("kind", "token", F.col("rep").alias("b"), F.col("n").alias("n_b"))
    return kept.select("kind", "token", F.col("rep").alias("a"), F.col("n").alias("n_a")).join(b, ["kind", "token"]).filter(f"a < b AND {_sized('n_a', 'n_b', similarity)}").select("a", "b").distinct()


def similar_sets(records: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, min_words: int = MIN_WORDS, most_in_block: int = MOST_IN_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Memberships (kind, id, rep) of all compared records, and the pairs of representatives with at least the
    similarity (a, b, similarity; a < b).

    records: kind, id, text; other columns are ignored. Records with null id or text, or with fewer than
    `min_words` words, aren't compared. Repeated rows of a record count once."""
    records = records.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).select("kind", "id", "text")
    prints = written(fingerprints(records, k, min_words), "prints")
    members = prints.select("kind", "id", "rep").distinct()
    reps = written(prints.dropDuplicates(["rep"]), "reps")
    keys = [F.xxhash64(F.lit(i), "kind", *(F.col("components")[i * ROWS + j] for j in range(ROWS))) for i in range(BLOCKS)]
    blocks = reps.select("rep", "n", F.explode(F.array(*keys)).alias("block"))
    hot = written(blocks.groupBy("block").count().filter(F.col("count") > most_in_block).select("block"), "hot")
    if hot.isEmpty():
        pairs = block_pairs(reps, blocks, similarity)
    else:
        crowded = reps.join(blocks.join(hot, "block", "left_semi").select("rep").distinct(), "rep", "left_semi").select("kind", "id")
        pairs = block_pairs(reps, blocks.join(hot, "block", "left_anti"), similarity).union(prefix_pairs(written(shingle_sets(records, crowded, k), "crowded"), similarity)).distinct()
    pairs = written(pairs, "pairs")
    named = reps.join(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi").select("kind", "id")
    sets = shingle_sets(records, named, k).drop("kind")
    sa, sb = sets.withColumnsRenamed({"rep": "a", "shingles": "sa"}), sets.withColumnsRenamed({"rep": "b", "shingles": "sb"})
    shared = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(sa, "a").join(sb, "b").select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("similarity"))
    return members, both.filter(F.col("similarity") >= similarity - 1e-12)


def similar_pairs(records: DataFrame, **kw: float) -> DataFrame:
    """All pairs of different records of one kind with at least the similarity: rec_kind, id_a, id_b (first smaller), similarity."""
    members, pairs = similar_sets(records, **kw)
    members, pairs = written(members, "members"), written(pairs, "links")
    ma = members.select(F.col("kind").alias("rec_kind"), F.col("id").alias("x"), F.col("rep").alias("a"))
    mb = members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = pairs.join(ma, "a").join(mb, "b").select("rec_kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
    copies = ma.join(mb, F.col("a") == F.col("b")).filter("x < y").select("rec_kind", F.col("x").alias("id_a"), F.col("y").alias("id_b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(copies)


def components(edges: DataFrame) -> DataFrame:
    """The connected components of the edges (a, b): node, label (the smallest node of its component).

    Large and small stars alternate until nothing changes; each round is written, so lineage stays short."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    sign = None
    while True:
        sym = e.union(e.select("v", "u"))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = written(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == sign:
            break
        sign = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v"), F.col("v"))).distinct()


def short_members(records: DataFrame, below: int) -> DataFrame:
    """kind, id and rep of the records of fewer than `below` words: a key of the kind and the whole word sequence, or of the
    text as it is where there is no word. Null texts are each alone."""
    words = word_hashes("text")
    short = records.filter(F.col("id").isNotNull()).select("kind", "id", "text", words.alias("words")).filter(F.coalesce(F.size("words"), F.lit(0)) < below)
    key = F.when(F.col("text").isNull(), F.xxhash64(F.lit("null"), "kind", "id")).when(F.size("words") == 0, F.xxhash64(F.lit("text"), "kind", "text")).otherwise(F.xxhash64(F.lit("words"), "kind", "words"))
    return short.select("kind", "id", key.alias("rep")).distinct()


def groups(records: DataFrame, every: bool = False, **kw: float) -> DataFrame:
    """One row per compared record: kind, id, group_id (smallest id of the records linked with it, directly or over
    others), n_links (its similar records).

    With `every`, one row per record with an id: those of fewer words than a shingle are similar if all their words are
    equal and in the same order; null texts are similar to none."""
    if every:
        kw["min_words"] = kw.get("k", SHINGLE)
    members, pairs = similar_sets(records, **kw)
    if every:
        members = members.union(short_members(records, kw["min_words"]))
    members, pairs = written(members, "members"), written(pairs, "links")
    sizes = members.groupBy("rep").agg(F.count("*").alias("size"))
    ends = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("rep", "other")
    links = ends.join(sizes.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("size").alias("others"))
    of = members.join(components(pairs).withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    named = of.groupBy("label").agg(F.min("id").alias("group_id"))
    return (
        of.join(named, "label").join(sizes, "rep").join(links, "rep", "left")
        .select("kind", "id", "group_id", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    )
