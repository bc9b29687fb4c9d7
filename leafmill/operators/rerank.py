"""Reranking of found chunks by signals from their text and metadata, as columns of one projection."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import let, narrative, retrieved_text, tokens, without_colons
from leafmill.tables import as_many


@dataclass(frozen=True)
class RerankConfig:
    """Weights and vocabularies; the defaults are fixed values."""

    title_overlap: float = 0.22
    file_overlap: float = 0.06
    text_overlap: float = 0.04
    phrase_overlap: float = 0.10
    exact_query: float = 0.12
    heading_body: float = 0.07
    adjacent_section: float = 0.04
    tiny_chunk: float = 0.22
    boilerplate: float = 0.55
    broad_boilerplate: float = 0.20
    project_scope: float = 0.46
    out_scope: float = 0.34
    in_scope: float = 0.38
    generic_scope: float = 0.24
    scope_query_terms: tuple[str, ...] = ("scope", "scoped", "inscope")
    scope_phrases: tuple[str, ...] = ("project scope", "out of scope", "in scope", "scope")
    boilerplate_phrases: tuple[str, ...] = (
        "individual project agreement", "master services agreement", "customer project contact", "vendor project contact",
        "effective upon acceptance", "terms and conditions", "capitalized terms", "exit clause", "termination",
    )
    admin_terms: tuple[str, ...] = ("agreement", "contract", "customer", "vendor", "contact", "effective", "expiration", "termination", "msa", "ipa")
    boilerplate_titles: tuple[str, ...] = ("individual project agreement", "master services agreement")
    boilerplate_title_starts: tuple[str, ...] = ("title of project", "customer", "vendor", "effective date", "expiration date")
    signals: tuple[str, ...] = field(default=("scope_section", "title_overlap", "file_overlap", "text_overlap", "phrase_overlap", "exact_query", "heading_body", "adjacent_section", "tiny_chunk", "boilerplate", "broad_boilerplate"))


def section_title_of(section_title: Column, heading: Column, section_key: Column) -> Column:
    """The first that isn't empty, on one line, without colons at the end."""
    first = F.coalesce(F.nullif(section_title, F.lit("")), F.nullif(heading, F.lit("")), F.nullif(section_key, F.lit("")), F.lit(""))
    return without_colons(narrative(first))


def overlap(query: Column, candidate: Column) -> Column:
    """The share of the query's distinct tokens among the candidate's."""
    distinct = F.array_distinct(query)
    return F.when((F.size(query) == 0) | (F.size(candidate) == 0), 0.0).otherwise(F.size(F.array_intersect(distinct, candidate)) / F.size(distinct))


def phrase_share(query: Column, text: Column) -> Column:
    """The share of the query's runs of three and two tokens (repeated ones count again) that the text's tokens contain as a string."""
    joined = F.array_join(tokens(text), " ")
    n = F.size(query)

    def runs(size: int) -> Column:
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(query, i, size), " "))).otherwise(F.array().cast("array<string>"))

    phrases = F.concat(runs(3), runs(2))
    return F.when(n < 2, 0.0).otherwise(let(joined, lambda j: F.size(F.filter(phrases, lambda p: F.contains(j, p)))) / F.size(phrases))


def _any_in(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in phrases), F.lit(False))


def scope_boost(q: Column, title: Column, c: RerankConfig) -> Column:
    t = F.lower(title)
    return (
        F.when(~F.arrays_overlap(q, F.array(*map(F.lit, c.scope_query_terms))) | ~_any_in(t, c.scope_phrases), 0.0)
        .when(t.contains("project scope"), c.project_scope)
        .when(t.contains("out of scope"), F.when(F.array_contains(q, "out"), c.out_scope).otherwise(c.generic_scope))
        .when(t.contains("in scope"), c.in_scope).otherwise(c.generic_scope)
    )


def rerank(found: DataFrame, config: RerankConfig | None = None) -> DataFrame:
    """Adds title, signals (name and amount of each that isn't 0), rerank_delta and final_score.

    found: query_id, query, position (order of the candidates of a query), raw_score, and the chunk's section_title,
    heading, section_key, file_name, source_file, text, block_types and source_block_count. Adjacency is that of the
    candidates' positions. A query without tokens changes nothing. Null texts and names count as empty. The candidates are
    few bytes and much work, so they are spread over as many tasks as shuffles have."""
    c = config or RerankConfig()
    e = lambda x: F.coalesce(F.nullif(F.col(x), F.lit("")), F.lit(""))
    df = found.repartition(as_many(found), "query_id").withColumn("title", section_title_of(F.col("section_title"), F.col("heading"), F.col("section_key")))
    w = Window.partitionBy("query_id").orderBy("position")
    low = F.lower("title")
    df = df.withColumns({
        "_adjacent": (F.col("title") != "") & (F.coalesce(F.lag(low).over(w) == low, F.lit(False)) | F.coalesce(F.lead(low).over(w) == low, F.lit(False))),
        "_qt": F.lower(narrative("query")),
        "_q": tokens(F.lower(narrative("query"))),
        "_text": F.lower(retrieved_text("text", "title")),
        "_file": F.lower(narrative(F.coalesce(F.nullif("file_name", F.lit("")), e("source_file")))),
    })
    df = df.withColumn("_all", F.array_join(F.filter(F.array(low, "_file", "_text"), lambda x: x != ""), " "))
    df = df.withColumns({"_title_tokens": tokens(low), "_text_tokens": tokens("_text")})
    q, title, text, all_, title_tokens, text_tokens = (F.col(x) for x in ("_q", "title", "_text", "_all", "_title_tokens", "_text_tokens"))
    admin = F.arrays_overlap(q, F.array(*map(F.lit, c.admin_terms)))
    types = F.transform(F.coalesce("block_types", F.array().cast("array<string>")), lambda x: F.lower(x))
    bad_title = low.isin(*c.boilerplate_titles) | reduce(lambda a, b: a | b, (low.startswith(p) for p in c.boilerplate_title_starts))
    broad = (F.length(text) > 500) & (F.size(text_tokens) > 90) & ~_any_in(low, c.scope_phrases) & ~F.coalesce(F.arrays_overlap(types, F.array(F.lit("table"), F.lit("row"))), F.lit(False)) & _any_in(text, c.boilerplate_phrases)
    amounts = {
        "scope_section": scope_boost(q, title, c),
        "title_overlap": c.title_overlap * overlap(q, title_tokens),
        "file_overlap": c.file_overlap * overlap(q, tokens("_file")),
        "text_overlap": c.text_overlap * overlap(q, text_tokens),
        "phrase_overlap": c.phrase_overlap * phrase_share(q, all_),
        "exact_query": F.when(F.contains(all_, F.col("_qt")), c.exact_query).otherwise(0.0),
        "heading_body": F.when((title != "") & (F.length(text) > F.greatest(F.lit(120), F.length(title) + 40)), c.heading_body).otherwise(0.0),
        "adjacent_section": F.when(F.col("_adjacent") & (overlap(q, title_tokens) >= 0.25), c.adjacent_section).otherwise(0.0),
        "tiny_chunk": F.when((F.length(text) < 80) & (F.coalesce("source_block_count", F.lit(1)) <= 1), -c.tiny_chunk).otherwise(0.0),
        "boilerplate": F.when(_any_in(all_, c.boilerplate_phrases) & ~admin, -c.boilerplate).otherwise(0.0),
        "broad_boilerplate": F.when((bad_title | broad) & ~admin, -c.broad_boilerplate).otherwise(0.0),
    }
    some = F.size(q) > 0
    df = df.withColumns({f"_{n}": F.when(some, amounts[n]).otherwise(0.0) for n in c.signals})
    signals = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"_{n}").alias("amount")) for n in c.signals)), lambda s: s["amount"] != 0)
    delta = reduce(lambda a, b: a + b, (F.col(f"_{n}") for n in c.signals))
    df = df.withColumns({"signals": signals, "rerank_delta": delta, "final_score": F.col("raw_score") + delta})
    return df.drop("_adjacent", "_qt", "_q", "_text", "_file", "_all", "_title_tokens", "_text_tokens", *(f"_{n}" for n in c.signals))


def reasons(signals: Column | str) -> Column:
    """The signals as text: boost or penalty, name, and amount with two decimals."""
    return F.transform(signals, lambda s: F.concat(F.when(s["amount"] > 0, "boost:").otherwise("penalty:"), s["name"], F.when(s["amount"] > 0, "(+").otherwise("(-"), F.format_number(F.bround(F.abs(s["amount"]), 2), 2), F.lit(")")))


def best(reranked: DataFrame, k: int) -> DataFrame:
    """The k best of each query by final score; ties (to twelve decimals) keep the candidates' order. Adds seed (from 0)."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("final_score", 12)), "position")
    return reranked.withColumn("seed", F.row_number().over(w) - 1).filter(F.col("seed") < k)
