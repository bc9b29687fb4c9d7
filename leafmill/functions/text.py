"""Text normalisation as Column expressions: all of it stays in the JVM.

Python's idea of white space (Unicode, with U+001C-U+001F) is kept throughout; see SPACE. A null text is an empty one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.tables import SPACE, stripped

# Fixed values.
TERMINAL = ".!?:;)]}"
SOFT_TERMINAL = ".!?)\"']}"
IMAGE = "[image]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
MOST_HEADING_CHARS, MOST_HEADING_WORDS = 120, 12


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it stands in the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_text(c: Column | str) -> Column:
    """Line ends as LF, runs of spaces and tabs as one space, at most one blank line, no outer white space."""
    x = F.regexp_replace(F.translate(F.coalesce(_c(c), F.lit("")), "\r", "\n"), r"[ \t]+", " ")
    return stripped(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def narrative(c: Column | str) -> Column:
    """The text on one line, with single spaces."""
    return stripped(F.regexp_replace(F.coalesce(_c(c), F.lit("")), SPACE + "+", " "))


def narrative_parts(parts: Column | str) -> Column:
    """Each part on one line, empty ones dropped."""
    return F.filter(F.transform(_c(parts), narrative), lambda x: x != "")


def _ends_with(c: Column, characters: str) -> Column:
    return F.right(c, F.lit(1)).isin(list(characters))


def sentence_end(c: Column, force: Column | bool) -> Column:
    """The text with a full stop unless it ends like a sentence; without `force` a closing quote ends one too."""
    force = F.lit(force) if isinstance(force, bool) else force
    done = (c == "") | (c == IMAGE) | _ends_with(c, TERMINAL) | (~force & _ends_with(c, SOFT_TERMINAL))
    return F.when(done, c).otherwise(F.concat(c, F.lit(".")))


def join_parts(parts: Column | str, punctuate: bool = True) -> Column:
    """The parts as one line of sentences; the last one always ends."""
    if not punctuate:
        return F.array_join(narrative_parts(parts), " ")
    return let(narrative_parts(parts), lambda p: F.array_join(F.transform(p, lambda x, i: sentence_end(x, i == F.size(p) - 1)), " "))


def word_count(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.size(F.split(c, SPACE + "+")))


def heading_like(c: Column) -> Column:
    """Short enough for a heading: one line, at most 120 characters and 12 words, no full stop at its end."""
    return (c != "") & ~c.contains("\n") & (F.length(c) <= MOST_HEADING_CHARS) & ~_ends_with(c, ".!?") & (word_count(stripped(c)) <= MOST_HEADING_WORDS)


def without_colons(c: Column) -> Column:
    return F.regexp_replace(c, r":+\z", "")


def same_text(a: Column, b: Column) -> Column:
    """Equal but for case, spacing and colons at the end."""
    return without_colons(F.lower(narrative(a))) == without_colons(F.lower(narrative(b)))


def starts_with_heading(body: Column, heading: Column) -> Column:
    b, h = F.lower(narrative(body)), without_colons(F.lower(narrative(heading)))
    return (heading != "") & ((b == h) | b.startswith(F.concat(h, F.lit(":"))))


def _headed(h: Column, body: Column) -> Column:
    short = without_colons(h)
    return (
        F.when(h == "", body).when(body == "", h).when(starts_with_heading(body, short), body)
        .when(heading_like(short), F.concat(short, F.lit(": "), body)).otherwise(F.concat(h, F.lit("\n\n"), body))
    )


def with_heading(heading: Column | str, body_parts: Column | str) -> Column:
    """Heading and body as one text: "heading: body" for a short heading, else a blank line between; not repeated
    where the body begins with it."""
    return let(F.array(narrative(heading), join_parts(body_parts)), lambda x: _headed(F.get(x, F.lit(0)), F.get(x, F.lit(1))))


def word_split(parts: Column) -> Column:
    """At least four parts, three quarters of them of at most two words: text that was cut at its words."""
    return let(narrative_parts(parts), lambda p: (F.size(p) >= 4) & (F.size(F.filter(p, lambda x: word_count(x) <= 2)) >= 0.75 * F.size(p)))


def join_words(parts: Column) -> Column:
    """Word-sized parts as one sentence, with spaces around punctuation put right."""
    rules = ((SPACE + r"+([,.;:!?])", "$1"), (r"([(\[{])" + SPACE + "+", "$1"), (SPACE + r"+([)\]}])", "$1"))
    joined = reduce(lambda x, r: F.regexp_replace(x, *r), rules, F.array_join(narrative_parts(parts), " "))
    return let(narrative(joined), lambda x: sentence_end(x, True))


def retrieved_text(text: Column | str, heading: Column | str) -> Column:
    """A stored text repaired for reading: words cut apart are joined, the heading leads, parts are sentences."""

    def repaired(x: Column) -> Column:
        """x: the parts and, as the last element, the heading on one line."""
        n = F.size(x) - 1
        h, parts, rest, first = F.element_at(x, -1), F.slice(x, 1, n), F.slice(x, 2, F.greatest(n - 1, F.lit(0))), F.get(x, F.lit(0))
        led, line = (h != "") & same_text(first, h), narrative(first)
        lead = F.when(led, h).when(heading_like(line), line)
        cut = word_split(F.when(led, rest).otherwise(parts))
        body = F.when(cut, join_words(F.when(lead.isNull(), parts).otherwise(rest))).when(lead.isNull(), join_parts(parts)).otherwise(join_parts(rest))
        whole = let(F.array(lead, body, F.when(cut, "cut")), lambda v: F.when(F.get(v, F.lit(0)).isNull(), F.get(v, F.lit(1))).otherwise(
            let(F.when(F.get(v, F.lit(2)).isNull(), F.get(v, F.lit(1))).otherwise(join_parts(F.array(F.get(v, F.lit(1))))), lambda b: _headed(F.get(v, F.lit(0)), b))))
        return F.when(n == 0, "").when(n == 1, line).otherwise(whole)

    pieces = F.filter(F.transform(F.split(clean_text(text), r"\n{2,}"), stripped), lambda p: p != "")
    return let(F.concat(pieces, F.array(narrative(heading))), repaired)


def tokens(c: Column | str) -> Column:
    """The ASCII words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def word_pieces(c: Column) -> Column:
    """Words and single symbols, counted."""
    return F.size(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}]"), F.lit(0)))


def token_estimate(c: Column | str) -> Column:
    """Tokens without a tokenizer: words and symbols, or a fourth of the characters if that is more."""
    x = F.coalesce(_c(c), F.lit(""))
    return F.greatest(word_pieces(x), F.ceil(F.length(x) / 4).cast("int"))


def preview(c: Column | str, most: int = 260) -> Column:
    cut = lambda x: F.regexp_replace(F.substring(x, 1, most - 3), SPACE + r"+\z", "")
    return let(narrative(c), lambda x: F.when(F.length(x) > most, F.concat(cut(x), F.lit("..."))).otherwise(x))


def content_part(c: Column | str) -> Column:
    """What follows the first "Content:" of a stored document, or all of it."""
    x = F.coalesce(_c(c), F.lit(""))
    return stripped(F.when(x.contains("Content:"), F.substring(x, F.instr(x, "Content:") + F.lit(8), F.length(x))).otherwise(x))


def page_normal(c: Column | str) -> Column:
    """Of a PDF page: NUL as a space, then clean_text."""
    return clean_text(F.translate(F.coalesce(_c(c), F.lit("")), "\x00", " "))


def slide_normal(c: Column | str) -> Column:
    """Of a slide shape: vertical tabs as spaces, no blank lines."""
    x = F.translate(F.translate(F.coalesce(_c(c), F.lit("")), "\x0b", " "), "\r", "\n")
    return stripped(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{2,}", "\n"))


def title_case_like(c: Column) -> Column:
    """At least 70 % of the purely alphabetic words begin in upper case (and there is such a word)."""
    words = F.filter(F.split(stripped(c), SPACE + "+"), lambda w: w.rlike(r"\A\p{L}+\z"))
    upper = F.filter(words, lambda w: w.rlike(r"\A\p{Lu}"))
    return (F.size(words) > 0) & (F.size(upper) >= 0.7 * F.size(words))


def heading_score(text: Column | str, bold: Column | bool = False, style: Column | str | None = None) -> Column:
    """How much a paragraph looks like a heading (3 and more: it is one)."""
    x, bold = stripped(F.coalesce(_c(text), F.lit(""))), F.lit(bold) if isinstance(bold, bool) else bold
    s = F.lower(F.coalesce(_c(style) if style is not None else F.lit(""), F.lit("")))
    n = word_count(x)
    points = (
        (n <= 12, 2), (bold, 2), (~_ends_with(x, ".;:,"), 1), (title_case_like(x), 1), ((F.upper(x) == x) & x.rlike(r"\p{Lu}") & (F.length(x) <= 40), 1),
        (n > 20, -3), (s.contains("list") | s.contains("bullet"), -2), (s.contains("annotation"), -2), (x.rlike(r"\A[•\-*]"), -2),
    )
    return reduce(lambda a, b: a + b, (F.when(F.coalesce(c, F.lit(False)), p).otherwise(0) for c, p in points))


def try_int(c: Column | str) -> Column:
    """A whole number, or null; fractions are cut off."""
    return _c(c).try_cast("double").cast("int")


def json_list(c: Column | str) -> Column:
    """The strings of a JSON list, none for anything else."""
    return F.coalesce(F.from_json(_c(c), "array<string>"), F.array().cast("array<string>"))
