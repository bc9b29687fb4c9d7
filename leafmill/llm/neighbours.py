"""The k most similar vectors for every vector, by an inverted multi-index.

Vectors are split into two halves, each quantised by its own codebook; a vector's cell is the pair of its nearest
centroids. Codebooks grow with the number of vectors and are fitted on at most SAMPLE vectors (chosen by hash); every vector is indexed. A query
visits centroid pairs in the order of summed distance, from a heap, until the cells visited hold `candidates`
vectors, and the entries of those cells are reranked by the exact cosine. Where a recall is asked for, `candidates` is
raised until it holds for PROBES vectors that are searched exactly.

Cells whose centroids lie close together form a list of about IN_LIST vectors; a query is sent once to each list it visits, with the
cells to rerank there, and a task reranks cell by cell with matrix products. A list's queries are cut into slices by how many
visit it (measured with the probes), and a list is copied once for each slice; as lists don't grow with the number of vectors, neither do the
copies of one. Lists that hold more than twice IN_LIST vectors (of one crowded cell, say) are cut into parts. Equal vectors are one entry;
their chunks are put back at the end, at most k + 1 for each entry, which is exact as all of them are equally similar."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.tables import written

SAMPLE = 16_384
ITERATIONS = 8
PER_CELL = 24  # vectors in a cell, on average
CENTROIDS = (4, 1024)  # of a half, least and most; the cell counts are at most as many numbers squared
IN_LIST = 65_536
MOST_QUERIES = 131_072  # of a list, in one task
PROBES = 256  # vectors searched exactly where a recall is asked for, and whose visits are counted
MANY = 16  # from this part of all vectors on, cells are taken up to a distance, in steps of BINS, instead of from a heap
BINS = 1024


def usable(c: str, dimension: int) -> F.Column:  # type: ignore[name-defined]
    """A vector of `dimension` finite numbers, not all zero."""
    return (F.size(c) == dimension) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)


def packed(vectors: DataFrame, dimension: int) -> DataFrame:
    """The usable vectors: id, vid (a hash of the vector), v (bytes of float32). vectors: id, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            x = np.ascontiguousarray(v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py() : v.offsets[-1].as_py()], np.float32)
            buffers = [None, pa.py_buffer(np.arange(0, x.nbytes + 1, dimension * 4, dtype=np.int32)), pa.py_buffer(x)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vid"), pa.Array.from_buffers(pa.binary(), len(b), buffers)], ["id", "vid", "v"])

    ok = vectors.filter(F.col("id").isNotNull() & usable("v", dimension)).select("id", F.xxhash64("v").alias("vid"), "v")
    return ok.mapInArrow(run, "id string, vid bigint, v binary")


def unit(column: pa.Array, dimension: int) -> np.ndarray:
    """Packed vectors as rows of length 1 (float64)."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dimension).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k-means centroids of the rows of x, from a bounded sample; empty ones restart at the worst fitted rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ITERATIONS):
        d = (c * c).sum(1) - 2 * x @ c.T
        near = d.argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if (free := np.flatnonzero(n == 0)).size:
            c[free] = x[np.argsort(-(d[np.arange(len(x)), near] + (x * x).sum(1)))[: free.size]]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1, keepdims=True) - 2 * x @ c.T + (c * c).sum(1), 0)


def visited(d1: np.ndarray, d2: np.ndarray, counts: list[list[int]], candidates: int) -> list[tuple[int, int]]:
    """The centroid pairs in order of d1[i] + d2[j] until their cells hold `candidates` vectors; empty cells are passed over."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    n1, n2 = len(s1), len(s2)
    heap, out, held = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and held < candidates:
        _, a, b = heapq.heappop(heap)
        i, j = o1[a], o2[b]
        if n := counts[i][j]:
            out.append((i, j))
            held += n
        if b + 1 < n2:
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
        if b == 0 and a + 1 < n1:
            heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))
    return out


def held_before(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroid pairs in order of d1[i] + d2[j], and how many vectors the cells before each hold."""
    order = np.argsort((d1[:, None] + d2).ravel(), kind="stable")
    n = counts.ravel()[order]
    return order, np.cumsum(n) - n


class Index:
    """The codebooks, how centroids are grouped, the number of vectors in each cell, and into how many parts and slices each list is cut."""

    def __init__(self, vectors: DataFrame, n: int, dimension: int) -> None:
        self.dimension, self.n = dimension, n
        k = int(min(max(np.sqrt(n / PER_CELL), CENTROIDS[0]), CENTROIDS[1]))
        few = -(1 << 63) + min((1 << 64) - 1, (2 * SAMPLE << 64) // max(n, 1))  # vid is a hash: the lowest ones are a sample
        sample = vectors.filter(F.col("vid") <= few).select("vid", "v").dropDuplicates(["vid"]).orderBy("vid").limit(SAMPLE).toArrow().column("v")
        x = unit(sample, dimension) if len(sample) else np.eye(k, dimension)
        half = dimension // 2
        self.books = fit(x[:, :half], k), fit(x[:, half:], k, 8)
        lists, most = max(1, -(-n // IN_LIST)), [max(1, len(b) // 4) for b in self.books]
        first = min(lists, most[0])
        wanted = first, min(max(1, -(-lists // first)), most[1])
        self.groups = [distances(b, fit(b, w, 9)).argmin(1) for b, w in zip(self.books, wanted, strict=True)]
        self.members = [[np.flatnonzero(g == a) for a in range(w)] for g, w in zip(self.groups, wanted, strict=True)]
        self.place = [np.array([int((g[:c] == g[c]).sum()) for c in range(len(g))]) for g in self.groups]  # of a centroid in its group
        self.counts = np.zeros((len(self.books[0]), len(self.books[1])), np.int64)
        self.parts = self.slices = np.ones(wanted[0] * wanted[1], np.int64)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.dimension // 2
        return distances(x[:, :half], self.books[0]), distances(x[:, half:], self.books[1])

    def lists(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each cell, and its number there."""
        g, h = self.groups[0][i], self.groups[1][j]
        width = np.array([len(m) for m in self.members[1]])
        return g * len(width) + h, self.place[0][i] * width[h] + self.place[1][j]

    def count(self, placed: DataFrame) -> None:
        """Fills in the counts; at most as many rows as there are cells."""
        for r in placed.groupBy("cell").count().toLocalIterator():
            self.counts[divmod(r.cell, self.counts.shape[1])] = r["count"]
        i, j = np.nonzero(self.counts)
        held = np.bincount(self.lists(i, j)[0], self.counts[i, j], len(self.parts))
        self.parts = np.maximum(1, -(-held // (2 * IN_LIST))).astype(np.int64)

    def cut(self, visits: np.ndarray, of: int) -> None:
        """Sets the slices. visits: how many of `of` queries visit each list."""
        self.slices = np.maximum(1, -(-visits * self.n // (max(of, 1) * MOST_QUERIES))).astype(np.int64)

    def visits(self, d1: np.ndarray, d2: np.ndarray, candidates: int) -> Iterator[list[tuple[int, bytes]]]:
        """Of each query the lists it visits, each with its cells there: their numbers, or bits where they are many."""
        if candidates * MANY < self.n:
            plain, width = self.counts.tolist(), [len(m) for m in self.members[1]]
            (g1, g2), (p1, p2) = (x.tolist() for x in self.groups), (x.tolist() for x in self.place)
            for a, b in zip(d1, d2, strict=True):
                at: dict[int, list[int]] = {}
                for i, j in visited(a, b, plain, candidates):
                    at.setdefault(g1[i] * len(width) + g2[j], []).append(p1[i] * width[g2[j]] + p2[j])
                yield [(g, array("H", own).tobytes()) for g, own in at.items()]
            return
        some, rows = self.counts > 0, max(1, (1 << 21) // self.counts.size)
        for start in range(0, len(d1), rows):
            sums = d1[start : start + rows, :, None] + d2[start : start + rows, None, :]
            low, high = sums.min((1, 2), keepdims=True), sums.max((1, 2), keepdims=True)
            bins = ((sums - low) * (BINS / np.maximum(high - low, 1e-12))).astype(np.int32)
            q = np.arange(len(sums))[:, None, None] * (BINS + 1)
            held = np.bincount((bins + q).ravel(), np.broadcast_to(self.counts, sums.shape).ravel(), len(sums) * (BINS + 1)).reshape(len(sums), -1).cumsum(1)
            last = (held < candidates).sum(1)
            near = (bins <= last[:, None, None]) & some
            for one in near:
                out = []
                for g, x in enumerate(self.members[0]):
                    for h, y in enumerate(self.members[1]):
                        if (bits := one[np.ix_(x, y)]).any():
                            out.append((g * len(self.members[1]) + h, np.packbits(bits.ravel()).tobytes()))
                yield out


def _place(index: Broadcast):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            d1, d2 = ix.cells(unit(b.column("v"), ix.dimension))
            cell = (d1.argmin(1) * d2.shape[1] + d2.argmin(1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("v"), pa.array(cell)], ["vid", "v", "cell"])

    return run


def _base(index: Broadcast):  # noqa: ANN202
    """The entries with their list and part, the cell's number in the list, and the list's slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            lists, number = ix.lists(*divmod(b.column("cell").to_numpy(), ix.counts.shape[1]))
            part = b.column("vid").to_numpy() % ix.parts[lists]
            columns = [pa.array(x.astype(np.int32)) for x in (lists, part, number, ix.slices[lists])]
            yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("v"), *columns], ["vid", "v", "list", "part", "number", "slices"])

    return run


def _send(index: Broadcast, candidates: int):  # noqa: ANN202
    """A row for each list (and part) that a query visits: the list, the part, the slice, and the query's cells there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                source, lists, parts, cells = [], [], [], []
                for q, at in enumerate(ix.visits(*ix.cells(unit(b.column("v"), ix.dimension)), candidates)):
                    for g, code in at:
                        for part in range(ix.parts[g]):
                            source.append(q)
                            lists.append(g)
                            parts.append(part)
                            cells.append(code)
                take = pa.array(source, pa.int64())
                slices = (b.column("vid").to_numpy()[source] >> 20) % ix.slices[lists] if source else np.empty(0)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vid").take(take), b.column("v").take(take), pa.array(lists, pa.int32()), pa.array(parts, pa.int32()), pa.array(slices.astype(np.int32)), pa.array(cells, pa.binary())],
                    ["vid", "v", "list", "part", "slice", "cells"],
                )

    return run


def _keep_best(best: tuple[np.ndarray, np.ndarray], rows: np.ndarray, p: np.ndarray, first: int) -> None:
    """Puts the similarities p (of queries `rows` with the entries from `first` on) among the best of each query."""
    scores, entries = best
    better = p.max(axis=1) > scores[rows].min(axis=1)
    if not better.any():
        return
    rows, p = rows[better], p[better]
    both = np.hstack([scores[rows], p])
    names = np.hstack([entries[rows], np.broadcast_to(np.arange(first, first + p.shape[1], dtype=np.int32), p.shape)])
    at = np.argpartition(-both, scores.shape[1] - 1, axis=1)[:, : scores.shape[1]]
    scores[rows], entries[rows] = np.take_along_axis(both, at, 1), np.take_along_axis(names, at, 1)


def _by_number(cells: list[bytes], held: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of each cell that is held, the queries that visit it. cells: of each query the numbers of those it visits."""
    cell = np.frombuffer(b"".join(cells), np.uint16).astype(np.int32)
    row = np.repeat(np.arange(len(cells)), np.fromiter(map(len, cells), np.int64, len(cells)) // 2)
    by = np.argsort(cell, kind="stable")
    cell, row = cell[by], row[by]
    for j in np.intersect1d(cell, held).tolist():
        yield j, row[slice(*np.searchsorted(cell, [j, j + 1]))]


def _by_bits(cells: list[bytes], held: np.ndarray, block: int = 16_384) -> Iterator[tuple[int, np.ndarray]]:
    """The same, where the cells are bits, for a block of queries at a time."""
    for start in range(0, len(cells), block):
        part = cells[start : start + block]
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(len(part), -1), axis=1)
        for j in held.tolist():
            if len(rows := np.flatnonzero(bits[:, j])):
                yield j, rows + start


def _rerank(k: int, least: float, dimension: int, wide: bool):  # noqa: ANN202
    def run(base: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        if not base.num_rows or not queries.num_rows:
            return empty
        js = base.column("number").to_numpy()
        order = np.argsort(js, kind="stable")
        js = js[order]
        x, ids = unit(base.column("v").combine_chunks(), dimension)[order], base.column("vid").to_numpy()[order]
        y, qs = unit(queries.column("v").combine_chunks(), dimension), queries.column("vid").to_numpy()
        x32, y32 = x.astype(np.float32), y.astype(np.float32)
        cells = queries.column("cells").to_pylist()
        held = k + 4  # itself, and some that float32 may misplace
        best = np.full((len(qs), held), max(-2.0, least - 1e-4), np.float32), np.full((len(qs), held), -1, np.int32)
        for j, all_rows in (_by_bits if wide else _by_number)(cells, np.unique(js)):
            a, b = np.searchsorted(js, [j, j + 1])
            for s in range(0, len(all_rows), 4096):
                rows = all_rows[s : s + 4096]
                for t in range(a, b, 2048):
                    _keep_best(best, rows, y32[rows] @ x32[t : min(b, t + 2048)].T, t)
        q, e = np.nonzero(best[1] >= 0)
        e = best[1][q, e]
        keep = qs[q] != ids[e]
        q, e = q[keep], e[keep]
        sim = np.empty(len(q))
        for s in range(0, len(q), 1 << 16):
            sim[s : s + (1 << 16)] = np.einsum("ij,ij->i", y[q[s : s + (1 << 16)]], x[e[s : s + (1 << 16)]])
        keep = sim >= least
        q, e, sim = q[keep], e[keep], sim[keep]
        order = np.lexsort((ids[e], -sim, q))
        q, e, sim = q[order], e[order], sim[order]
        first = np.ones(len(q), bool)
        first[1:] = q[1:] != q[:-1]
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        keep = rank < k
        return pa.table({"a": qs[q[keep]], "b": ids[e[keep]], "similarity": sim[keep]})

    return run


def _probe(probes: Broadcast, k: int, dimension: int):  # noqa: ANN202
    """Of each batch, the k entries most similar to each probe: the probe's number, similarity, cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vids, y = probes.value
        for b in batches:
            if not b.num_rows:
                continue
            p = unit(b.column("v"), dimension) @ y.T
            p[b.column("vid").to_numpy()[:, None] == vids] = -2
            at = np.argpartition(-p, min(k, len(p)) - 1, axis=0)[:k]
            row, q = at.ravel(), np.broadcast_to(np.arange(len(vids)), at.shape).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(p[row, q]), b.column("cell").take(pa.array(row))], ["probe", "similarity", "cell"])

    return run


def enough(index: Index, placed: DataFrame, k: int, least: float, candidates: int, recall: float | None) -> int:
    """The candidates with which the probes' visits find that share of their k most similar entries of at least that similarity,
    `candidates` at least. Sets the index's slices. At most PROBES * k rows reach the driver."""
    some = placed.select("vid", "v").orderBy("vid").limit(PROBES).toArrow()  # vid is a hash
    if not len(some):
        return candidates
    y = unit(some.column("v"), index.dimension)
    d1, d2 = index.cells(y)
    if recall is not None and len(some) > 1:
        known = placed.sparkSession.sparkContext.broadcast((some.column("vid").to_numpy(), y))
        near = placed.mapInArrow(_probe(known, k, index.dimension), "probe int, similarity double, cell int").filter(F.col("similarity") >= max(least, -1.5))
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("similarity"), "cell"))).filter(F.col("r") <= k)
        at: dict[int, list[int]] = {}
        for r in near.select("probe", "cell").collect():
            at.setdefault(r.probe, []).append(r.cell)
        need = []
        for q, cells in at.items():
            order, before = held_before(d1[q], d2[q], index.counts)
            of = np.empty_like(before)
            of[order] = before
            need += of[cells].tolist()
        candidates = max(candidates, int(np.quantile(need, recall, method="higher")) + 1) if need else candidates
    visits = np.zeros(len(index.parts), np.int64)
    for at_lists in index.visits(d1, d2, candidates):
        visits[[g for g, _ in at_lists]] += 1
    index.cut(visits, len(some))
    return candidates


def entry_neighbours(vectors: DataFrame, k: int, least: float, candidates: int, dimension: int, recall: float | None = None) -> DataFrame:
    """The k most similar other entries of each entry, as far as found: a, b, similarity (at least `least`); for each list apart.
    vectors: vid, v, repeated as they may be. With `recall`, `candidates` is the least number."""
    sc = vectors.sparkSession.sparkContext
    index = Index(vectors, vectors.select("vid").distinct().count(), dimension)
    placed = written(vectors.select("vid", "v").dropDuplicates(["vid"]).mapInArrow(_place(sc.broadcast(index)), "vid bigint, v binary, cell int"), "placed")
    index.count(placed)
    candidates = enough(index, placed, k, least, candidates, recall)
    known = sc.broadcast(index)
    base = placed.mapInArrow(_base(known), "vid bigint, v binary, list int, part int, number int, slices int").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    queries = placed.select("vid", "v").mapInArrow(_send(known, candidates), "vid bigint, v binary, list int, part int, slice int, cells binary")
    keys = ["list", "part", "slice"]
    return base.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_rerank(k, least, dimension, candidates * MANY >= index.n), "a bigint, b bigint, similarity double")


def most_similar(vectors: DataFrame, k: int = 10, least: float = -1.0, candidates: int = 2000, dimension: int = 64, recall: float | None = None) -> DataFrame:
    """The k most similar other ids of each id: id, other, similarity (cosine), rank.

    vectors: id, v. Ids without a usable vector (null, other length, not finite, all zero) and null ids are in no
    row. Repeated rows of an id count once. Ties go to the smaller id. With `least`, only pairs of at least this
    similarity. Where ids share one vector, each has the others first. With `recall`, as many candidates as that share of
    the neighbours needs, `candidates` at least."""
    if dimension % 2:
        raise ValueError("the dimension must be even")
    vectors = written(packed(vectors, dimension), "packed")
    members = vectors.select("id", "vid").distinct()
    near = entry_neighbours(vectors, k, least, candidates, dimension, recall)
    if least > -1:  # what one side finds counts for both; without a least similarity each has k of its own
        near = written(near, "near")
        near = near.union(near.select("b", "a", "similarity")).repartition("a").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).filter(F.col("r") <= (2 * k if least > -1 else k)).drop("r")
    heads = members.withColumn("at", F.row_number().over(Window.partitionBy("vid").orderBy("id"))).filter(F.col("at") <= k + 1)
    heads = written(heads, "heads")
    few = members.join(heads.groupBy("vid").agg(F.count("*").alias("held")).filter(F.col("held") <= k), "vid", "left_semi")  # the others have k copies
    own = members.join(heads.select("vid", F.col("id").alias("other")), "vid").filter("id <> other").select("id", "other", F.lit(1.0).alias("similarity"))
    far = few.withColumnRenamed("vid", "a").join(near, "a").join(heads.select(F.col("vid").alias("b"), F.col("id").alias("other")), "b").select("id", "other", "similarity")
    return (
        own.union(far)
        .withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other")))
        .filter(F.col("rank") <= k)
    )


def found_pairs(vectors: DataFrame, k: int = 10, least: float = 0.85, candidates: int = 500, dimension: int = 64, recall: float = 0.975) -> DataFrame:
    """Pairs of ids of which one is among the k most similar of the other, of at least the similarity: chunk_id_a,
    chunk_id_b (first smaller). `recall` is that of one side; a pair is found from both."""
    near = most_similar(vectors, k, least, candidates, dimension, recall)
    return near.select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()
