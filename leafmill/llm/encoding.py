"""The token ids of every text under a public byte-level BPE vocabulary.

The most frequent pieces of the whole corpus (at most LEXICON) are compiled with their ids into a minimal acyclic
automaton over bytes: words with equal endings share states. Each edge carries the number of words that sort before
it, so the sum along a word's path is the word's number, and the ids of the number stand in one array beside it;
that way outputs don't keep suffixes from being shared. The automaton is one file of integers, sent to all
executors by Spark and mapped into memory there. A batch's distinct pieces walk it together; those it doesn't hold
are merged exactly by the vocabulary's ranks."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.bpe import Vocabulary, default_path, distinct_pieces, split, texts_of
from leafmill.tables import handed_over, once_per_key

LEXICON = 65_536
MOST_CACHED = 400_000


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> np.ndarray:
    """The automaton of the sorted distinct words as one array: sizes, then edge keys (state << 8 | byte, sorted),
    targets, words before the edge, final states, where each word's ids begin, and the ids."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # open states of the last word: final, edges
    last = b""

    def close(down_to: int) -> None:
        while len(path) > down_to + 1:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1][-1] = (path[-1][1][-1][0], register[key])

    for w in words:
        common = next((n for n, (a, b) in enumerate(zip(w, last, strict=False)) if a != b), min(len(w), len(last)))
        close(common)
        for b in w[common:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = w
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    count = []
    for final, edges in states:  # targets come before their sources
        count.append(int(final) + sum(count[t] for _, t in edges))
    keys, targets, before = [], [], []
    for s, (final, edges) in enumerate(states):
        n = int(final)
        for b, t in edges:
            keys.append(s << 8 | b)
            targets.append(t)
            before.append(n)
            n += count[t]
    offsets = np.cumsum([0, *map(len, ids)])
    parts = [keys, targets, before, [int(f) for f, _ in states], offsets, [x for i in ids for x in i]]
    return np.concatenate([np.array([len(p) for p in parts], np.int64), *(np.array(p, np.int64) for p in parts)])


class Lexicon:
    """The compiled automaton; `data` may be mapped from a file."""

    def __init__(self, data: np.ndarray) -> None:
        sizes = data[:6]
        ends = 6 + np.cumsum(sizes)
        self.keys, self.targets, self.before, self.final, self.offsets, self.ids = (data[e - n : e] for n, e in zip(sizes, ends, strict=True))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 where the automaton doesn't hold it. All words walk together, a byte at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        out = np.full(len(words), -1, np.int64)
        at, state, number, p = np.arange(len(words)), np.full(len(words), len(self.final) - 1), np.zeros(len(words), np.int64), 0
        while len(at):
            ended = sizes[at] == p
            out[at[ended]] = np.where(self.final[state[ended]] == 1, number[ended], -1)
            at, state, number = at[~ended], state[~ended], number[~ended]
            if not len(at) or not len(self.keys):
                break
            key = state << 8 | flat[starts[at] + p]
            e = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[e] == key
            at, e, number = at[ok], e[ok], number[ok]
            number = number + self.before[e]
            state, p = self.targets[e], p + 1
        return out

    def of(self, number: int) -> np.ndarray:
        return self.ids[self.offsets[number] : self.offsets[number + 1]]


class Encoder:
    """Texts to ids in a task: pieces by the automaton or by merging, each distinct piece once."""

    def __init__(self, lexicon: Lexicon, vocabulary: Vocabulary) -> None:
        self.lexicon, self.vocabulary = lexicon, vocabulary
        self.cache: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        numbers = self.lexicon.numbers(raw)
        unseen = np.flatnonzero(numbers < 0).tolist()
        for k, n in zip(pieces, numbers.tolist(), strict=True):
            if n >= 0:
                self.cache[k] = self.lexicon.of(n).astype(np.int32).tobytes()
        if unseen:
            ids, sizes = self.vocabulary.merge([raw[k] for k in unseen])
            data, end = ids.astype(np.int32).tobytes(), 0
            for k, n in zip(unseen, sizes.tolist(), strict=True):
                self.cache[pieces[k]] = data[end : end + 4 * n]
                end += 4 * n

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > MOST_CACHED:
            self.cache.clear()
        cut = [split(t) if t else [] for t in texts]
        new = {p for c in cut for p in c if p not in self.cache}
        if new:
            self.learn(list(new))
        get = self.cache.__getitem__
        return [b"".join(map(get, c)) for c in cut]


def _encode(file: str, vocabulary: Broadcast):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Lexicon(np.load(SparkFiles.get(file), mmap_mode="r")), vocabulary.value)
        for batch in batches:
            for part, texts in texts_of(batch, "text"):
                rows = encoder(texts)
                offsets = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "ids"])

    return run


def build_lexicon(texts: DataFrame, vocabulary: Vocabulary, most: int = LEXICON) -> np.ndarray:
    """The automaton of the `most` most frequent pieces of all texts. Only these reach the driver."""
    top = distinct_pieces(texts).orderBy(F.desc("n"), "piece").limit(most).toArrow().column("piece").to_pylist()
    words = sorted(p.encode("utf-8", "surrogatepass") for p in top)
    ids, sizes = vocabulary.merge(words)
    ends = np.cumsum(sizes)
    return compile_lexicon(words, [ids[e - n : e].tolist() for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)])


def encode(documents: DataFrame, path: str | None = None, lexicon_size: int = LEXICON) -> DataFrame:
    """doc_id and ids (array<int>) of each document's text, without special tokens; their strings are ordinary text.

    Null and empty texts have the empty list. A repeated row of a document is encoded once. Null doc_ids keep a row."""
    vocabulary = Vocabulary(path or default_path())
    sc = documents.sparkSession.sparkContext
    texts = once_per_key(documents.select("doc_id", "text"), "doc_id")
    file, data = f"lexicon-{uuid.uuid4().hex}.npy", io.BytesIO()
    np.save(data, build_lexicon(texts, vocabulary, lexicon_size))
    sc.addFile(handed_over(documents.sparkSession, file, data.getvalue()))
    return texts.select(F.col("doc_id").alias("id"), "text").mapInArrow(_encode(file, sc.broadcast(vocabulary)), "id bigint, ids array<int>").withColumnRenamed("id", "doc_id")
