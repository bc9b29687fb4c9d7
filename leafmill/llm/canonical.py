"""One form for texts that look the same.

A transducer, compiled once per worker, walks a text's grapheme clusters by longest match and writes the cluster's
consistent form. Its table is computed beforehand from the Unicode data (canonical compositions, widths, letters of
mathematical fonts, spaces, invisible characters, ligatures) and the look-alike letters below, and checked for conflicts: each
cluster has one output, and every output maps to itself. A cluster with marks that no composition holds is its base's
entry with the marks in canonical order. Plain ASCII is never touched, so only runs with other characters are walked.

There are two forms. The form to compare by (`canonical`) writes all look-alikes as Latin letters. The form to read
(`readable`) does so only in words that mix scripts, and towards the script of the word's other letters: a word all
of one script is as it should be, so texts in Russian or Greek stay as they are.

What differs visibly stays different: case, accents, dashes of other lengths, superscripts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafmill.tables import written

# Letters of other scripts, then the Latin letters they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТХҮӀԌԚԜѴаеѕіјорсухһӏԁԛԝѵ"
CYRILLIC_AS = "ABESIJKMHOPCTXYIGQWVaesijopcyxhldqwv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿϹνοϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXJCvocj"
ARMENIAN = "ԼՍՏՕզհյոսցօ"
ARMENIAN_AS = "LUSOqhjnugo"
CHEROKEE = "\u13a0\u13a1\u13a2\u13a5\u13a9\u13aa\u13ab\u13ac\u13b3\u13b7\u13bb\u13bd\u13c0\u13c2\u13c3\u13cf\u13d2\u13d4\u13d5\u13d9\u13da\u13de\u13df\u13e2\u13e6\u13e7\u13f4"
CHEROKEE_AS = "DRTiYAJEWMHYGhZbRWSVSLCPKdB"
COPTIC = "\u2c82\u2c8e\u2c94\u2c98\u2c9a\u2c9e\u2c9f\u2ca2\u2ca3\u2ca4\u2ca5\u2ca6\u2ca8\u2cac"
COPTIC_AS = "BHKMNOoPpCcTYX"
LISU = "\ua4d0\ua4d1\ua4d3\ua4d4\ua4d6\ua4d7\ua4d9\ua4da\ua4dc\ua4dd\ua4df\ua4e0\ua4e1\ua4e2\ua4e3\ua4e6\ua4e7\ua4ea\ua4eb\ua4ec\ua4ee\ua4f0\ua4f2\ua4f3\ua4f4"
LISU_AS = "BPDTGKJCZFMNLSRVHWXYAEIOU"
PHONETIC = "ɑɡ"
PHONETIC_AS = "ag"
LOOK_ALIKE = (CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS), (CHEROKEE, CHEROKEE_AS), (COPTIC, COPTIC_AS), (LISU, LISU_AS), (PHONETIC, PHONETIC_AS)
HYPHENS = "\u2010\u2011"
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200d\u200c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
JOINERS = "\u200c\u200d"
RUN = re.compile(r"\r\n?|[\x00-\x7f]?[^\x00-\x7f]+")
LAST = 0x30000
MOST_CITED = 1_000_000  # 8 bytes each


def put(table: dict[str, str], key: str, out: str) -> None:
    if table.setdefault(key, out) != out:
        raise ValueError(f"two outputs for {key!r}: {table[key]!r} and {out!r}")


def look_alikes() -> dict[str, str]:
    out: dict[str, str] = {}
    for letters, latin in LOOK_ALIKE:
        for c, d in zip(letters, latin, strict=True):
            put(out, c, d)
    return out


def single_characters(alike: dict[str, str]) -> dict[str, str]:
    """Characters that change by themselves, and their outputs. alike: the look-alikes to be replaced, each with its letter."""
    out = dict(alike)
    for c, d in (*((c, "-") for c in HYPHENS), ("\u2026", "..."), ("\u2025", ".."), ("\u00b5", "\u03bc"), *((c, "\n") for c in "\u0085\u2028\u2029")):
        put(out, c, d)
    for o in range(0x80, LAST):
        c = chr(o)
        wide = 0xFF01 <= o < 0xFFE7 or 0xFB00 <= o < 0xFB07 or o in (0x1C4, 0x1C7, 0x1CA, 0x1F1) or 0x2160 <= o < 0x2180  # widths, ligatures, digraphs, Roman numerals
        if unicodedata.category(c) == "Zs":
            put(out, c, " ")
        elif (wide or unicodedata.decomposition(c).startswith("<font>")) and (n := unicodedata.normalize("NFKC", c)) != c:
            put(out, c, "".join(alike.get(x, x) for x in n))
    return out


def cluster_form(cluster: str, single: dict[str, str]) -> str:
    """The rule behind the table: decompose, replace each character, compose."""
    return unicodedata.normalize("NFC", "".join(single.get(c, c) for c in unicodedata.normalize("NFD", cluster)))


class Transducer:
    """The compiled mapping. `steps` is a trie over characters; a node's output stands under the empty string."""

    def __init__(self, alike: dict[str, str] | None = None) -> None:
        single = single_characters(look_alikes() if alike is None else alike)
        table = {c: cluster_form(c, single) for c in single}
        for o in range(0xC0, LAST):
            c = chr(o)
            d = unicodedata.normalize("NFD", c)
            if d != c:
                for key in (c, d):
                    put(table, key, cluster_form(c, single))
        for o in range(0xFF66, 0xFF9E):  # half-width kana with a sound mark of its own
            for mark in "\uff9e\uff9f":
                if len(n := unicodedata.normalize("NFKC", chr(o) + mark)) == 1:
                    put(table, chr(o) + mark, n)
        for key, out in table.items():
            if cluster_form(out, single) != out:
                raise ValueError(f"the output of {key!r} doesn't map to itself: {out!r}")
        self.single, self.steps = single, {}
        for key, out in table.items():
            node = self.steps
            for c in key:
                node = node.setdefault(c, {})
            node[""] = out
        self.run = lru_cache(1 << 16)(self._run)

    def _run(self, run: str) -> str:
        if run[0] == "\r":
            return "\n"
        out: list[str] = []
        i, n = 0, len(run)
        while i < n:
            c = run[i]
            if c in INVISIBLE:
                if c in JOINERS and out and (unicodedata.category(out[-1][-1]) in ("So", "Sk") or out[-1][-1] == "\ufe0f" or 0x600 <= ord(out[-1][-1]) < 0x1100):
                    out.append(c)  # joins emoji, or shapes letters of a joining script
                i += 1
                continue
            node, k, end, best = self.steps, i, 0, c
            while k < n and (node := node.get(run[k])):
                k += 1
                if "" in node:
                    end, best = k, node[""]
            end = end or i + 1
            if end < n and (unicodedata.category(run[end])[0] == "M" or run[end] in INVISIBLE):
                cluster = run[i:end]
                while end < n and (unicodedata.category(run[end])[0] == "M" or run[end] in INVISIBLE and run[end] not in JOINERS or run[end] in JOINERS and end + 1 < n and unicodedata.category(run[end + 1])[0] == "M"):
                    cluster += "" if run[end] in INVISIBLE else run[end]
                    end += 1
                best = cluster_form(cluster, self.single)
            out.append(best)
            i = end
        return "".join(out)

    def __call__(self, text: str) -> str:
        return text if text.isascii() and "\r" not in text else RUN.sub(lambda m: self.run(m[0]), text)


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


_WORD = regex.compile(r"[\p{L}\p{M}]+")
_OTHERS = re.compile("[" + "".join(x[0] for x in LOOK_ALIKE) + "]")


class Reader:
    """A text's form to read: the transducer without look-alikes, and these in words of mixed script only."""

    def __init__(self) -> None:
        self.forms = Transducer({})
        self.latin = str.maketrans(look_alikes())
        self.own = [(frozenset(letters), str.maketrans({d: c for c, d in reversed([*zip(letters, latin, strict=True)])})) for letters, latin in LOOK_ALIKE]
        self.word = lru_cache(1 << 16)(self._word)

    def _word(self, word: str) -> str:
        """Letters of other scripts become Latin ones, unless a letter shows that the word is of such a script itself."""
        if not _OTHERS.search(word) or not regex.search(r"\p{Latin}", word):
            return word
        for (letters, table), name in zip(self.own, ("Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Lisu"), strict=False):
            if any(c not in letters for c in regex.findall(rf"\p{{{name}}}", word)):
                return word.translate(table)
        return word.translate(self.latin)

    def __call__(self, text: str) -> str:
        out = self.forms(text)
        return _WORD.sub(lambda m: self.word(m[0]), out) if _OTHERS.search(out) else out


@lru_cache(1)
def reader() -> Reader:
    return Reader()


@F.pandas_udf(StringType())
def _canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    t = transducer()
    for s in batches:
        yield s.map(t, na_action="ignore")


@F.pandas_udf(StringType())
def _readable(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    t = reader()
    for s in batches:
        yield s.map(t, na_action="ignore")


def _where_needed(f, c: Column | str) -> Column:  # noqa: ANN001
    """Texts of ASCII alone stay in the JVM."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(f(F.when(x.rlike(r"[^\x00-\x7f]|\r"), x)), x)


def canonical(c: Column | str) -> Column:
    """The form of a text to compare by; null stays null, and an empty text empty."""
    return _where_needed(_canonical, c)


def readable(c: Column | str) -> Column:
    """The consistent form of a text to read; null stays null, and an empty text empty."""
    return _where_needed(_readable, c)


def same_look(citations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs of a citation and a block of its source whose whole texts look the same but aren't the same string:
    citation_id, block_id.

    Compared by 128-bit digests of both forms. Texts that show nothing (null, empty, only spaces or invisible
    characters) are in no pair. Repeated rows count once. Texts never move: each task writes the digests of its rows, and
    only these are joined. Where up to MOST_CITED files are cited, by a count, blocks of other files are passed over. Equal
    texts of a file are joined once and their ids put back afterwards."""
    c = citations.filter(F.col("text").isNotNull() & F.col("source").isNotNull() & F.col("citation_id").isNotNull()).select("citation_id", F.col("source").alias("file"), "text")
    b = blocks.filter(F.col("text").isNotNull() & F.col("block_id").isNotNull()).select("block_id", F.col("source_file").alias("file"), "text")
    cited = written(c.select(F.xxhash64("file").alias("cited")).distinct(), "cited")
    if cited.count() <= MOST_CITED:
        b = b.join(F.broadcast(cited), F.xxhash64("file") == F.col("cited"), "left_semi")

    def forms(df: DataFrame, key: str) -> DataFrame:
        look = df.select(key, "file", F.md5("text").alias("raw"), canonical("text").alias("look")).filter(F.col("look").rlike(r"[^\s\p{Z}]"))
        return written(look.select(key, "file", F.md5("look").alias("look"), "raw"), "forms")

    cf, bf = forms(c, "citation_id").distinct(), forms(b, "block_id").distinct()
    kinds = cf.select("file", "look", F.col("raw").alias("raw_c")).distinct().join(bf.select("file", "look", F.col("raw").alias("raw_b")).distinct(), ["file", "look"]).filter("raw_c <> raw_b")
    return kinds.join(cf.withColumnRenamed("raw", "raw_c"), ["file", "look", "raw_c"]).join(bf.withColumnRenamed("raw", "raw_b"), ["file", "look", "raw_b"]).select("citation_id", "block_id")
