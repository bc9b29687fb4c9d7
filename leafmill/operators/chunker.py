"""Sections into chunks within a budget, with overlap.

The stages are DataFrame plans; sizes are computed by Spark as columns. Only three things are Python, each streaming
over sorted Arrow batches with a small state: cutting a block that exceeds the budget, packing the segments of one
section part by their sizes, and attaching short heading chunks. Nothing holds a whole file: a part's open chunk and
its overlap are all the state there is."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import IMAGE, SOFT_TERMINAL, TERMINAL, clean_text, heading_like, narrative, sentence_end, starts_with_heading, token_estimate, with_heading, without_colons, word_pieces
from leafmill.operators.sections import HEADING_TYPES, TABLE_TYPES, prepared, sections
from leafmill.tables import as_many, written

_PIECE = re.compile(r"\w+|[^\w\s]")
_CUTS = {"paragraph": re.compile(r"\n{2,}"), "line": re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), "sentence": re.compile(r"(?<=[.!?])\s+"), "word": re.compile(r"\s+")}
_GLUE = {"paragraph": "\n\n", "line": "\n", "sentence": " ", "word": " "}
_PROSE, _ROWS = ("paragraph", "line", "sentence", "word"), ("line", "paragraph", "sentence", "word")
# Fixed values.
_HEADER = ("columns:", "headers:", "header:", "fields:")
_INTRODUCERS = ("the following", "following ", "scope includes")


@dataclass(frozen=True)
class ChunkConfig:
    max_chars: int = 2000
    max_tokens: int = 380
    overlap_tokens: int = 40
    min_section_chars: int = 120
    heading_types: tuple[str, ...] = HEADING_TYPES
    table_types: tuple[str, ...] = TABLE_TYPES
    tokenizer: Callable[[], Callable[[str], int]] | None = None  # opened once in a task; gives a text's number of tokens

    def __post_init__(self) -> None:
        if min(self.max_chars, self.max_tokens) <= 0 or min(self.overlap_tokens, self.min_section_chars) < 0 or self.overlap_tokens >= self.max_tokens:
            raise ValueError(f"no usable budget: {self}")


def estimate(text: str) -> int:
    """token_estimate of leafmill.functions.text, for a string."""
    return max(len(_PIECE.findall(text)), math.ceil(len(text) / 4))


def counter(config: ChunkConfig) -> Callable[[str], int]:
    """What counts a text's tokens: the tokenizer, or the estimate."""
    return config.tokenizer() if config.tokenizer else estimate


def fits(text: str, chars: int, tokens: int, count: Callable[[str], int] = estimate) -> bool:
    return len(text) <= chars and count(text) <= tokens


def _finest_cut(text: str, order: tuple[str, ...]) -> tuple[str, list[str]] | None:
    """The first granularity that cuts the text in several units."""
    for name in order:
        if len(units := [u for x in _CUTS[name].split(text) if (u := x.strip())]) > 1:
            return name, units
    return None


def cut_prose(text: str, chars: int, tokens: int, count: Callable[[str], int] = estimate) -> list[str]:
    """Units within the budget, as coarse as they may be; they aren't put together again. One word is never cut."""
    if not text or fits(text, chars, tokens, count) or not (cut := _finest_cut(text, _PROSE)):
        return [text] if text else []
    return [s for u in cut[1] for s in cut_prose(u, chars, tokens, count)]


def cut_rows(text: str, chars: int, tokens: int, order: tuple[str, ...] = _ROWS, count: Callable[[str], int] = estimate) -> list[str]:
    """Lines (or finer units) put together again up to the budget."""
    if not text or fits(text, chars, tokens, count) or not (cut := _finest_cut(text, order)):
        return [text] if text else []
    glue, out, open_ = _GLUE[cut[0]], [], ""
    for u in cut[1]:
        joined = f"{open_}{glue}{u}" if open_ else u
        if fits(joined, chars, tokens, count):
            open_ = joined
            continue
        if open_:
            out.append(open_)
        open_ = u if fits(u, chars, tokens, count) else ""
        if not open_:
            out += cut_rows(u, chars, tokens, _ROWS if cut[0] == "line" else _PROSE, count)
    return [*out, open_] if open_ else out


def cut_table(text: str, chars: int, tokens: int, count: Callable[[str], int] = estimate) -> list[str]:
    """A table's pieces; a first line that names the columns leads each of them."""
    lines = [u for x in _CUTS["line"].split(text) if (u := x.strip())]
    header = lines[0] if len(lines) > 1 and lines[0].lower().startswith(_HEADER) else ""
    if not header or not text.startswith(header):
        return cut_rows(text, chars, tokens, count=count)
    rows = cut_rows(text[len(header) :].strip(), max(chars - len(header) - 1, 1), max(tokens - count(header), 1), count=count)
    return [f"{header}\n{r}" for r in rows] or [header]


def _cut(config: ChunkConfig):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(config)
        for b in batches:
            cut = [cut_table(r.clean, r.chars, r.tokens, count) if r.is_table else cut_prose(r.clean, r.chars, r.tokens, count) for r in b.itertuples(index=False)]
            yield pd.DataFrame({"source_file": b["source_file"], "block_id": b["block_id"], "segments": cut})

    return run


def tokens_of(text: Column, config: ChunkConfig) -> Column:
    """A text's number of tokens by the tokenizer, or the estimate."""
    if not config.tokenizer:
        return token_estimate(text)

    @F.pandas_udf("int")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = config.tokenizer()
        for s in batches:
            yield s.map(lambda x: count(x or "")).astype("int32")

    return counted(text)


def segments(sectioned: DataFrame, config: ChunkConfig) -> DataFrame:
    """Each body or table block's segments (seg from 0): blocks within the budget that their heading leaves stay as they
    are in the JVM; tables and blocks beyond it are cut."""
    lead = F.concat("heading.text", F.lit("\n\n"))
    left_chars, left_tokens = F.lit(config.max_chars) - F.length(lead), F.lit(config.max_tokens) - F.coalesce(tokens_of(lead, config), F.lit(0))
    own = F.col("heading").isNull() | F.col("is_table")
    df = sectioned.filter("NOT is_heading").withColumns({
        "clean": clean_text("text"),
        "chars": F.when(own | (left_chars <= 0), config.max_chars).otherwise(left_chars),
        "tokens": F.when(own | (left_tokens <= 0), config.max_tokens).otherwise(left_tokens),
    })
    whole = ~F.col("is_table") & (F.length("clean") <= F.col("chars")) & (tokens_of(F.col("clean"), config) <= F.col("tokens"))
    df = written(df.drop("text").withColumn("whole", whole), "sized")
    beyond = df.filter("NOT whole").select("source_file", "block_id", "is_table", "clean", "chars", "tokens").mapInPandas(_cut(config), "source_file string, block_id string, segments array<string>")
    one = df.filter("whole").withColumn("segments", F.array("clean"))
    both = one.unionByName(df.filter("NOT whole").join(beyond, ["source_file", "block_id"]).select(*one.columns))
    return both.select("*", F.posexplode("segments").alias("seg", "segment")).drop("segments", "clean", "chars", "tokens", "whole")


class _Item(NamedTuple):
    """A segment: what it adds to a chunk (characters, pieces, a full stop inside or at the end of it), whether it begins with the heading."""

    chars: int
    pieces: int
    soft: int
    hard: int
    leads: bool
    tokens: int
    row: tuple


def _pack(config: ChunkConfig):  # noqa: ANN202
    def within(chars: int, pieces: int, n: int, first: _Item, item: _Item, lead: tuple[int, int]) -> bool:
        """Whether a chunk of n segments of so many characters and pieces, led by `first`, and the item keeps the budget."""
        chars, pieces = chars + n + item.chars + item.hard, pieces + item.pieces + item.hard
        if not first.leads:
            chars, pieces = chars + lead[0], pieces + lead[1]
        return chars <= config.max_chars and max(pieces, math.ceil(chars / 4)) <= config.max_tokens

    def sums(group: list[_Item]) -> tuple[int, int]:
        return sum(g.chars + g.soft for g in group), sum(g.pieces + g.soft for g in group)

    def overlap(group: list[_Item], item: _Item, lead: tuple[int, int]) -> list[_Item]:
        tail, total = [], 0
        for g in reversed(group):
            total += g.tokens
            if total > config.overlap_tokens:
                break
            tail.insert(0, g)
        while tail and not within(*sums(tail), len(tail), tail[0], item, lead):
            tail.pop(0)
        return tail

    fields = ["source_file", "section_id", "part", "chars", "pieces", "soft", "hard", "leads", "tokens", "lead_chars", "lead_pieces", "order", "block_id", "seg"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, group, number, chars, pieces = None, [], 0, 0, 0
        columns = ["source_file", "section_id", "part", "group", "pos", "order", "block_id", "seg"]
        for b in batches:
            out = []
            for file, section, part, *size, lead_chars, lead_pieces, order, block, seg in zip(*(b[c].tolist() for c in fields), strict=True):
                if (here := (file, section, part)) != place:
                    place, group, number, chars, pieces = here, [], 0, 0, 0
                item, lead = _Item(*size, (order, block, seg)), (lead_chars, lead_pieces)
                if group and not within(chars, pieces, len(group), group[0], item, lead):
                    number += 1
                    group = overlap(group, item, lead)
                    chars, pieces = sums(group)
                    out += [(*here, number, k, *g.row) for k, g in enumerate(group)]
                group.append(item)
                chars, pieces = chars + item.chars + item.soft, pieces + item.pieces + item.soft
                out.append((*here, number, len(group) - 1, *item.row))
            yield pd.DataFrame(out, columns=columns)

    return run


def _ended(text: str, force: bool) -> str:
    """sentence_end of leafmill.functions.text, for a string."""
    return text if not text or text == IMAGE or text[-1] in TERMINAL or (not force and text[-1] in SOFT_TERMINAL) else text + "."


def _pack_texts(config: ChunkConfig):  # noqa: ANN202
    """As _pack, for a tokenizer: its counts don't add up, so the chunk's text is rendered and counted. The state is one open chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(config)

        def within(group: list) -> bool:
            texts = [x for g in group if (x := g.text)]
            body = " ".join(_ended(x, n == len(texts) - 1) for n, x in enumerate(texts))
            r = group[0]
            if r.whole and body and not r.leads:
                body = f"{r.short}: {body}" if r.like else f"{r.whole}\n\n{body}"
            return fits(body or r.whole or "", config.max_chars, config.max_tokens, count)

        place, group, number = None, [], 0
        columns = ["source_file", "section_id", "part", "group", "pos", "order", "block_id", "seg"]
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if (here := (r.source_file, r.section_id, r.part)) != place:
                    place, group, number = here, [], 0
                if group and not within([*group, r]):
                    number += 1
                    total, tail = 0, []
                    for g in reversed(group):
                        total += g.tokens
                        if total > config.overlap_tokens:
                            break
                        tail.insert(0, g)
                    while tail and not within([*tail, r]):
                        tail.pop(0)
                    group = tail
                    out += [(*here, number, k, g.order, g.block_id, g.seg) for k, g in enumerate(group)]
                group.append(r)
                out.append((*here, number, len(group) - 1, r.order, r.block_id, r.seg))
            yield pd.DataFrame(out, columns=columns)

    return run


def packed(segs: DataFrame, config: ChunkConfig) -> DataFrame:
    """The groups of body segments: source_file, section_id, part, group, pos, order, block_id, seg. A segment of the
    overlap is in two groups. Only sizes go through Python."""
    df = segs.filter("NOT is_table").select("source_file", "section_id", "part", "order", "block_id", "seg", "segment", narrative("segment").alias("p"), narrative("heading.text").alias("whole"))
    df = df.withColumns({"short": without_colons(F.col("whole")), "soft_end": sentence_end(F.col("p"), False), "hard_end": sentence_end(F.col("p"), True)}).withColumn("like", heading_like(F.col("short")))
    p, short, whole, like = (F.col(c) for c in ("p", "short", "whole", "like"))
    sized = df.select(
        "source_file", "section_id", "part", "order", "block_id", "seg", F.length(p).alias("chars"), word_pieces(p).alias("pieces"), (F.length("soft_end") - F.length(p)).alias("soft"), (F.length("hard_end") - F.length(p)).alias("hard"),
        tokens_of(F.col("segment"), config).alias("tokens"), *([p.alias("text"), whole.alias("whole"), short.alias("short"), like.alias("like")] if config.tokenizer else []), F.coalesce(starts_with_heading(p, short), F.lit(False)).alias("leads"),
        F.when(whole == "", 0).when(like, F.length(short) + 2).otherwise(F.length(whole) + 2).alias("lead_chars"),
        F.when(whole == "", 0).when(like, word_pieces(short) + 1).otherwise(word_pieces(whole)).alias("lead_pieces"),
    )
    keys = ["source_file", "section_id", "part"]
    sorted_ = sized.repartition(as_many(sized), *keys).sortWithinPartitions(*keys, "order", "block_id", "seg")
    return sorted_.mapInPandas((_pack_texts if config.tokenizer else _pack)(config), "source_file string, section_id bigint, part bigint, group int, pos int, order int, block_id string, seg int")


PLACE = ("section_id", "part", "kind", "group")  # a chunk's place in its file
SPAN = 1024  # sections, and runs of chunks, of a range
_SEGMENT = ("block_id", "block_type", "order", "page_number", "slide_number", "shape_index", "sheet_name", "row_number")


def _numbers(field: str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform("_s", lambda x: x[field]), lambda x: x.isNotNull())))


def section_title(heading: Column, path: Column) -> Column:
    """The heading, or the last part of the path, on one line without colons at the end; null for none."""
    h = narrative(heading)
    return F.nullif(without_colons(F.when(h != "", h).otherwise(narrative(F.try_element_at(path, F.lit(-1))))), F.lit(""))


def chunk_rows(sectioned: DataFrame, config: ChunkConfig) -> DataFrame:
    """Chunks before short headings are attached, with their place in the file: PLACE."""
    segs = written(segments(sectioned, config), "segments")
    facts = F.struct(*_SEGMENT, "segment")
    context = ["source_path", "doc_type", "path", "heading"]
    body = packed(segs, config).join(segs.filter("NOT is_table").select("source_file", "block_id", "seg", *context, facts.alias("s")), ["source_file", "block_id", "seg"])
    body = body.select("source_file", "section_id", "part", F.lit(1).alias("kind"), "group", "pos", *context, "s")
    tables = segs.filter("is_table").select("source_file", "section_id", "part", F.lit(0).alias("kind"), F.col("seg").alias("group"), F.lit(0).alias("pos"), *context, facts.alias("s"))
    grouped = body.union(tables).groupBy("source_file", "section_id", "part", "kind", "group").agg(
        *(F.first(c).alias(c) for c in context), F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("_s")
    )  # a group is at most one chunk's budget
    led = segs.filter("NOT is_table AND part = 0").select("source_file", "section_id").distinct()
    lone = sectioned.filter("is_heading").join(led, ["source_file", "section_id"], "left_anti").select(
        "source_file", "section_id", F.lit(0).cast("bigint").alias("part"), F.lit(1).alias("kind"), F.lit(0).alias("group"), *context, F.array().cast(dict(grouped.dtypes)["_s"]).alias("_s")
    )
    df = grouped.unionByName(lone)
    is_table = F.col("kind") == 0
    text = F.when(is_table, F.get("_s", F.lit(0))["segment"]).otherwise(with_heading("heading.text", F.transform("_s", lambda x: x["segment"])))
    heading_first = F.array(F.struct(*(F.col(f"heading.{c}").alias(c) for c in _SEGMENT), F.col("heading.text").alias("segment")))
    df = df.withColumn("text", text).withColumn("_s", F.when(is_table | F.col("heading").isNull(), F.col("_s")).otherwise(F.concat(heading_first, F.col("_s"))))
    distinct = lambda f: F.array_distinct(F.filter(F.transform("_s", lambda x: x[f]), lambda x: x.isNotNull()))
    return df.select(
        "source_file", "source_path", "doc_type", *PLACE, F.when(is_table, "table").otherwise("section").alias("chunk_type"), F.col("path").alias("section_path"), F.col("heading.text").alias("heading"), "text",
        distinct("block_id").alias("block_ids"), distinct("block_type").alias("block_types"), F.array_min(F.transform("_s", lambda x: x["order"])).alias("order_start"), F.array_max(F.transform("_s", lambda x: x["order"])).alias("order_end"),
        _numbers("page_number").alias("page_numbers"), _numbers("slide_number").alias("slide_numbers"), _numbers("shape_index").alias("shape_indices"), distinct("sheet_name").alias("sheet_names"), _numbers("row_number").alias("row_numbers"),
        F.when(is_table, F.get("_s", F.lit(0))["block_type"]).alias("original_block_type"),
    )


def _attach(config: ChunkConfig):  # noqa: ANN202
    """Where each chunk of a run goes: source_file, run, its place, target (number of the new chunk in the run), role (0 prefix, 1 main, 2 suffix)."""

    def moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, pending, last = None, [], None  # last: [number, chars, pieces, soft, text for a tokenizer] of the newest output
        count = counter(config) if config.tokenizer else None
        number, out = 0, []

        def fit(r) -> bool:  # noqa: ANN001
            chars = last[1] + last[3] + 1 + r.chars + r.hard
            if count:
                return chars <= config.max_chars and count(f"{_ended(last[4], False)} {_ended(r.text, True)}") <= config.max_tokens
            return chars <= config.max_chars and max(last[2] + last[3] + r.pieces + r.hard, math.ceil(chars / 4)) <= config.max_tokens

        def put(r, role: int) -> None:  # noqa: ANN001
            out.append((r.source_file, r.run, r.section_id, r.part, r.kind, r.group, number, role))

        def suffix(r) -> None:  # noqa: ANN001
            nonlocal last
            last = [number, last[1] + last[3] + 1 + r.chars + r.hard, last[2] + last[3] + r.pieces + r.hard, 0, f"{_ended(last[4], False)} {_ended(r.text, True)}" if count else ""]
            put(r, 2)

        def main(r) -> None:  # noqa: ANN001
            nonlocal last, number
            number += 1
            for p in pending:
                put(p, 0)
            put(r, 1)
            last = [number, sum(p.chars + p.soft + 1 for p in pending) + r.chars + (r.hard if pending else 0), sum(p.pieces + p.soft for p in pending) + r.pieces + (r.hard if pending else 0), 0 if pending else r.soft, " ".join([*(_ended(p.text, False) for p in pending), _ended(r.text, bool(pending))]) if count else ""]
            pending.clear()

        def close() -> None:
            left, had = list(pending), last is not None
            pending.clear()
            for p in left:
                if had and fit(p):
                    suffix(p)
                else:
                    main(p)

        columns = ["source_file", "run", *PLACE, "target", "role"]
        for b in batches:
            for r in b.itertuples(index=False):
                if (r.source_file, r.run) != run:
                    close()
                    run, last, number = (r.source_file, r.run), None, 0
                if not r.short:
                    main(r)
                elif pending or r.introduces or last is None:
                    pending.append(r)
                elif fit(r):
                    suffix(r)
                else:
                    pending.append(r)
            yield pd.DataFrame(out, columns=columns)
            out.clear()
        close()
        yield pd.DataFrame(out, columns=columns)

    return moves


def runs(sized: DataFrame) -> DataFrame:
    """Adds run: chunks of a file that can be attached to each other. One begins at each chunk that isn't short and follows
    none that is, as no short chunk waits there. Counted in ranges of sections, and over the ranges."""
    sized = sized.withColumn("_range", F.floor(F.col("section_id") / SPAN))
    keys, place = ["source_file", "_range"], F.struct(*PLACE)
    inside = Window.partitionBy(*keys).orderBy(*PLACE)
    before = Window.partitionBy("source_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = sized.groupBy(*keys).agg(F.max_by("short", place).alias("s")).select(*keys, F.last("s").over(before).alias("_short_before"))
    df = sized.join(ends, keys)
    df = df.withColumn("_begins", (~F.col("short") & ~F.coalesce(F.lag("short").over(inside), F.col("_short_before"), F.lit(False))).cast("int"))
    counts = df.groupBy(*keys).agg(F.sum("_begins").alias("n")).select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_runs"))
    return df.join(counts, keys).withColumn("run", F.sum("_begins").over(inside) + F.col("_runs")).drop("_range", "_begins", "_runs", "_short_before")


def first_numbers(places: DataFrame) -> DataFrame:
    """source_file, run and first: the number of new chunks before the run in its file, in ranges of runs and over the ranges."""
    n = places.groupBy("source_file", "run").agg(F.max("target").alias("n")).withColumn("_range", F.floor(F.col("run") / SPAN))
    inside = Window.partitionBy("source_file", "_range").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = n.groupBy("source_file", "_range").agg(F.sum("n").alias("n")).select("source_file", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return n.join(totals, ["source_file", "_range"]).select("source_file", "run", (F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("_before")).cast("int").alias("first"))


def merged(chunks: DataFrame, config: ChunkConfig) -> DataFrame:
    """Chunks with short heading chunks attached to the chunk they introduce or follow, and numbered."""
    df = chunks.select("source_file", *PLACE, "chunk_type", "block_types", narrative("text").alias("p"))
    df = df.withColumns({"low": without_colons(F.lower("p")), "soft_end": sentence_end(F.col("p"), False), "hard_end": sentence_end(F.col("p"), True)})
    heads = (F.size("block_types") > 0) & (F.size(F.array_except("block_types", F.array(*map(F.lit, config.heading_types)))) == 0)
    introduces = F.col("p").endswith(":") | reduce(lambda a, b: a | b, (F.col("low").startswith(x) for x in _INTRODUCERS))
    short = (F.col("chunk_type") == "section") & heads & (F.col("p") != "") & (F.length("p") < config.min_section_chars)
    sized = df.select("source_file", *PLACE, short.alias("short"), introduces.alias("introduces"), *([F.col("p").alias("text")] if config.tokenizer else []), F.length("p").alias("chars"), word_pieces(F.col("p")).alias("pieces"), (F.length("soft_end") - F.length("p")).alias("soft"), (F.length("hard_end") - F.length("p")).alias("hard"))
    ordered = runs(written(sized, "sizes")).repartition(as_many(chunks), "source_file", "run").sortWithinPartitions("source_file", "run", *PLACE)
    places = written(ordered.mapInPandas(_attach(config), "source_file string, run bigint, section_id bigint, part bigint, kind int, group int, target int, role int"), "places")
    chunks = chunks.join(places, ["source_file", *PLACE]).withColumn("seq", F.struct(*PLACE)).drop(*PLACE)
    df = chunks.withColumn("section_title", section_title(F.col("heading"), F.col("section_path")))
    fields = [c for c in df.columns if c not in ("source_file", "run", "target")]
    g = df.groupBy("source_file", "run", "target").agg(F.array_sort(F.collect_list(F.struct("seq", "role", *(c for c in fields if c not in ("seq", "role"))))).alias("c"))
    g = g.join(first_numbers(places), ["source_file", "run"]).withColumn("target", F.col("target") + F.col("first"))
    main, n = F.get(F.filter("c", lambda x: x["role"] == 1), F.lit(0)), F.size("c")
    led = F.get("c", F.lit(0))["role"] == 0
    every = lambda f: F.flatten(F.transform("c", lambda x: x[f]))
    path = F.array_distinct(F.flatten(F.transform(F.filter("c", lambda x: x["role"] < 2), lambda x: x["section_path"])))
    sentence = F.transform("c", lambda x: sentence_end(narrative(x["text"]), (x["role"] == 2) | ((x["role"] == 1) & led)))
    names = F.transform("c", lambda x: F.coalesce(F.when(x["role"] == 0, F.nullif(x["section_title"], F.lit(""))), F.nullif(F.trim(x["heading"]), F.lit("")), F.when((x["role"] == 1) & ~led & (n > 1), x["section_title"])))
    g = g.select("source_file", "target", "c", main.alias("m"), n.alias("n"), F.when(n == 1, main["section_path"]).otherwise(path).alias("section_path"),
                 F.when(n == 1, main["heading"]).otherwise(F.get(F.filter(names, lambda x: x.isNotNull()), F.lit(0))).alias("heading"),
                 F.when(n == 1, main["text"]).otherwise(F.array_join(sentence, " ")).alias("text"))
    ids = F.array_distinct(every("block_ids"))
    numbers = lambda f: F.array_sort(F.array_distinct(every(f)))
    return g.select(
        F.concat("source_file", F.lit("::chunk_"), F.format_string("%04d", "target")).alias("chunk_id"), F.element_at(F.split("source_file", "/"), -1).alias("file_name"), "source_file", "m.source_path", "m.doc_type", "m.chunk_type", "section_path",
        F.array_join("section_path", " > ").alias("section_key"), section_title(F.col("heading"), F.col("section_path")).alias("section_title"), "heading", "text", F.length("text").alias("char_count"), ids.alias("block_ids"), F.array_distinct(every("block_types")).alias("block_types"),
        F.array_min(F.transform("c", lambda x: x["order_start"])).alias("order_start"), F.array_max(F.transform("c", lambda x: x["order_end"])).alias("order_end"), F.get(numbers("page_numbers"), F.lit(0)).alias("page_number"),
        numbers("page_numbers").alias("page_numbers"), numbers("slide_numbers").alias("slide_numbers"), numbers("shape_indices").alias("shape_indices"), F.array_distinct(every("sheet_names")).alias("sheet_names"), numbers("row_numbers").alias("row_numbers"),
        F.struct(F.lit(config.max_chars).alias("max_chars"), F.lit(config.max_tokens).alias("max_tokens"), F.lit(config.overlap_tokens).alias("overlap_tokens"), F.size(ids).alias("source_block_count"), F.col("m.original_block_type").alias("original_block_type"), F.when(F.col("n") > 1, F.col("n") - 1).alias("merged_short_context_chunks")).alias("metadata"),
    )


def chunk(blocks: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """The chunks of all files' blocks. Empty and null texts give nothing; a null source_file is the file ""; the latest row
    of a repeated block counts; further columns are ignored."""
    c = config or ChunkConfig()
    sectioned = written(sections(prepared(blocks), c.heading_types, c.table_types), "sections")
    return merged(written(chunk_rows(sectioned, c), "chunks"), c)
