"""Byte-level BPE vocabularies: splitting texts into pieces, and merging many pieces at once.

Only the vocabulary file of a public tokenizer is read (its path is a parameter); nothing is trained here."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the published pattern that cuts a text into pieces, with white space written out.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?{L}+| ?{N}+| ?[^{W}{l}{n}]+|[{W}]+(?![^{W}])|[{W}]+"
_ANY = regex.compile(_PATTERN.format(L=r"\p{L}", N=r"\p{N}", W=WHITE, l=r"\p{L}", n=r"\p{N}"))
_ASCII = re.compile(_PATTERN.format(L="[A-Za-z]", N="[0-9]", W=r"\t-\r ", l="A-Za-z", n="0-9"))
BATCH = 2_000
MOST_COUNTED = 500_000


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabularies are, if nothing else is given."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def split(text: str) -> list[str]:
    """The pieces of a text; together they are the text."""
    return (_ASCII if text.isascii() else _ANY).findall(text)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, and the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Vocabulary:
    """byte_ids: the id of each byte. keys, ranks, ids: the adjacent pairs that merge (left id << 32 | right id, sorted), when, and to what."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        vocab, letters = model["vocab"], _byte_letters()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.ids = keys[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64)[order]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in one array, and the number of each piece.

        The symbols of all pieces are one array. In each round every adjacent pair is looked up among the merges,
        and each piece applies its lowest ranked one wherever it occurs; pieces without a merge are done."""
        none = np.iinfo(np.int64).max
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            key = np.full(len(symbols), -1, np.int64)
            inside = owner[:-1] == owner[1:]
            key[:-1][inside] = symbols[:-1][inside] << 32 | symbols[1:][inside]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(owner)]))
            ended = lowest == none
            done.append((owner[ended], symbols[ended]))
            hit = (rank == lowest) & ~ended
            run_start = hit & ~np.r_[False, hit[:-1]]  # of overlapping hits every other one counts, from the left
            first = np.maximum.accumulate(np.where(run_start, np.arange(len(hit)), -1))
            hit &= (np.arange(len(hit)) - first) % 2 == 0
            symbols = np.where(hit, self.ids[at], symbols)
            keep = ~np.r_[False, hit[:-1]] & ~ended
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return np.empty(0, np.int64), sizes
        owner, symbols = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(pieces))


def texts_of(batch: pa.RecordBatch, column: str, rows: int = BATCH) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for start in range(0, batch.num_rows, rows):
        part = batch.slice(start, rows)
        yield part, part.column(column).to_pylist()


def _piece_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for _, texts in texts_of(batch, "text"):
            counts.update(chain.from_iterable(map(split, filter(None, texts))))
            if len(counts) > MOST_COUNTED:
                yield pa.RecordBatch.from_pydict({"piece": list(counts.keys()), "n": pa.array(list(counts.values()), pa.int64())})
                counts.clear()
    if counts:
        yield pa.RecordBatch.from_pydict({"piece": list(counts.keys()), "n": pa.array(list(counts.values()), pa.int64())})


def distinct_pieces(texts: DataFrame) -> DataFrame:
    """The distinct pieces of all texts and how often each occurs: piece, n. Counted in each task before the shuffle."""
    return texts.select("text").mapInArrow(_piece_counts, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
