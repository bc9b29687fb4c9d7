"""Cutting texts beyond a size limit at natural boundaries, with an overlap.

Texts within their limit never leave the JVM; only those beyond it reach Python. There a hierarchy of separators
that suits the block type is tried from the top: parts between the coarsest separators are packed greedily to the limit. A
part that doesn't fit any more begins the next piece, if it fits there beside the overlap; a part too long for any
piece is cut at the next separators, down to grapheme clusters and, last, code points. A piece begins with the last
overlap_tokens tokens of the one before; only what they really take is taken off its limit. Every piece is a substring
of the text without its outer white space: cutting the first overlap_chars off each piece and joining the rest gives
that text again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.tables import clean_type, stripped

#: Places to cut, as patterns that match the end of a part.
SECTION = re.compile(r"\n[^\S\n]*\n\s*(?=[^\n]{1,80}(?<![.!?;,…])\n)|\f+")  # before a short line without a full stop, after a blank line
PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
LINE = re.compile(r"\n+")
CELL = re.compile(r"\s\|\s")
SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？]+\s*")
WORD = re.compile(r"\s+")
GRAPHEME = regex.compile(r"\X")
PROSE = (SECTION, PARAGRAPH, LINE, SENTENCE, WORD)
#: By block type; what isn't named is prose.
HIERARCHIES = {"table": (LINE, CELL, SENTENCE, WORD), "row": (LINE, CELL, SENTENCE, WORD), "header": (LINE, CELL, WORD), "bullet": (LINE, SENTENCE, WORD)}
MOST_WORD = 40  # characters of a word that is one token of an overlap; of longer runs PER_TOKEN characters are one
PER_TOKEN = 4
ROOM = 4  # a fourth of the limit at least is for new text
OUT = "block_id string, source_file string, doc_type string, block_type string, section_path array<string>, piece_no int, start int, overlap_chars int, text string"


def tail(text: str, start: int, end: int, tokens: int, most: int) -> int:
    """Where the last `tokens` tokens of text[start:end] begin, at most `most` characters from the end."""
    least, begin = max(start, end - most), end
    while tokens > 0:
        k = begin
        while k > start and text[k - 1].isspace():
            k -= 1
        word = k
        while word > start and k - word <= MOST_WORD and not text[word - 1].isspace():
            word -= 1
        if k - word > MOST_WORD:
            at = max(k - PER_TOKEN * tokens, least)
            return min(begin, next((m.start() for m in GRAPHEME.finditer(text, max(start, at - 64), end) if m.start() >= at), at))
        if word == k or word < least:
            break
        begin, tokens = word, tokens - 1
    return begin


def pieces(text: str, limit: int, overlap_tokens: int, block_type: str = "") -> list[tuple[int, int, int]]:
    """The pieces of `text` as (start, end, characters shared with the piece before)."""
    levels = HIERARCHIES.get(block_type, PROSE)
    most = limit - max(1, limit // ROOM)  # characters of an overlap
    out: list[tuple[int, int, int]] = []
    start = at = end = 0  # of the open piece: its begin, where its new text begins, its end

    def next_start() -> int:
        return tail(text, start, end, overlap_tokens, most)

    def close() -> None:
        nonlocal start, at
        out.append((start, end, at - start))
        start, at = next_start(), end

    def place(a: int, b: int, level: int) -> None:
        nonlocal end
        if b - start > limit and end > at and b - next_start() <= limit:
            close()
        if b - start <= limit:
            end = b
        elif level < len(levels):
            here = a
            for m in levels[level].finditer(text, a, b):
                if m.end() < b and m.end() > here:
                    place(here, m.end(), level + 1)
                    here = m.end()
            place(here, b, level + 1)
        else:
            for m in GRAPHEME.finditer(text, a, b):
                if m.end() - start > limit and end > at:
                    close()
                while m.end() - start > limit:  # one cluster beyond the limit
                    end = start + limit
                    close()
                end = m.end()

    place(0, len(text), 0)
    out.append((start, end, at - start))
    return out


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            for n, (a, b, shared) in enumerate(pieces(r.text, r.max_chars, r.overlap_tokens, r.block_type or ""), 1):
                rows.append((r.block_id, r.source_file, r.doc_type, r.block_type, r.section_path, n, a, shared, r.text[a:b]))
        yield pd.DataFrame(rows, columns=["block_id", "source_file", "doc_type", "block_type", "section_path", "piece_no", "start", "overlap_chars", "text"])


def split_oversized(blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of each block whose text, without outer white space, has more code points than max_chars of its doc_type.

    Columns: block_id, source_file, doc_type, block_type, section_path, piece_no (from 1), start (in the text without
    outer white space), overlap_chars, text. The overlap is overlap_tokens tokens: words, and in runs of more than
    MOST_WORD characters PER_TOKEN characters each. It has fewer words only where the piece before has no more, or where they
    would leave less than a fourth of the limit for new text; a limit that can't hold overlap_tokens of PER_TOKEN characters is an error. No piece for texts within the
    limit, null texts, and types without a positive limit. A type given twice takes its smallest limit. Repeated rows of
    a block are cut once for each; callers take the distinct ones. Blocks may have more columns."""
    wide = F.col("overlap_tokens") * PER_TOKEN >= F.col("max_chars")
    whole = F.when(wide, F.raise_error(F.concat(F.lit("the overlap of "), "doc_type", F.lit(" doesn't fit its max_chars"))).cast("int")).otherwise(F.col("overlap_tokens"))
    lim = limits.filter("max_chars > 0").groupBy("doc_type").agg(F.min("max_chars").alias("max_chars"), F.min(F.coalesce("overlap_tokens", F.lit(0))).alias("overlap_tokens")).withColumn("overlap_tokens", whole)
    b = blocks.select("block_id", "source_file", "doc_type", clean_type("block_type").alias("block_type"), "section_path", "text")
    over = b.join(lim, "doc_type").filter(F.length("text") > F.col("max_chars")).withColumn("text", stripped("text")).filter(F.length("text") > F.col("max_chars"))
    return over.mapInPandas(_cut, OUT)
