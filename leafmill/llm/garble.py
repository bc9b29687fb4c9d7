"""Texts decoded with a wrong character encoding, and their restoration.

Every step works on the distinct tokens of the whole corpus (runs without ASCII white space), which Spark counts once,
by language and by whether the record is clean: clean records are those without replacement characters, C1 controls
and well-formed UTF-8 that was read as something else.

Character trigram models with interpolated (smoothed) probabilities are trained on all clean records, one over all of
them and one for each language. Their counts stand in a table of CELLS hashed cells (two rows, the smaller count holds),
so a model has one size whatever the corpus, and no trigram is dropped. Then each distinct token with characters beyond
ASCII is scored, by the language that likes it best: as it is, and after every encode-decode chain that applies to
it; a lost character (U+FFFD, a C1 control) is a chain too, whose result has something unobserved in its place. The likeliest form
is accepted if it is likelier than the token as it stands by more than a margin. There are three margins, for chains through
UTF-8 (or a loss) and for chains between other encodings, which have less evidence, on one character or on more. Each is validated on all clean
tokens, as they are and garbled on purpose: it lies by GUARD above what all but a thousandth of the clean tokens of any
script gain, but not above what half of the garbled ones gain.

Tokens that differ in digits alone are judged as one; a verdict is a chain, which is then applied to each of them."""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.canonical import INVISIBLE, transducer
from leafmill.llm.words import mixed
from leafmill.tables import written

CELLS = 1 << 22  # of a model's table; two rows of 4 bytes each
LANGUAGES = 15  # slots of languages beside the one of all records; further languages share slots
MOST_COUNTED = 200_000  # tokens that a task holds before it passes them on
MOST_SENT = 1_000_000  # garbled tokens that all tasks are sent; more are joined
FALSE = 0.001  # of the clean tokens, as many may gain more than the margin less GUARD: clean records may hold a garbled token
GUARD = 4.0  # how much further a form must be likelier, as a natural logarithm
UNOBSERVED = -8.0  # log probability of a lost character: one of a few thousand
STEPS, MOST_STEPS = 8, 800  # of a histogram of gains, to a unit and in all
LOST = "\ufffd"
_DIGIT = re.compile("[1-9]")
PARTS = re.compile(r"([ \t\n\r]+)")
#: Tokens that keep a text from being trained on: runs of accented letters, symbols inside words, case that jumps inside a word.
UNCLEAN = re.compile(r"[À-ÖØ-öø-ÿ]{3}|[^\W\d_][¡-¶¸-¿×÷†‡ˆ‰˜ƒ][^\W\d_]|[а-яё][А-ЯЁ]|[\x80-\x84\x86-\x9f\ufffd]|[^\W\d_][\u2500-\u259f]")
#: Scripts so rare that ordinary neighbours of other scripts are likelier than they are.
RARE = re.compile(r"[\u0460-\u048f\u0530-\u058f\u0700-\u08ff]")
SPAN = 1 << 21  # of code points

#: Encodings in which UTF-8 is commonly misread, and pairs (read as, written in) of other encodings.
MISREAD_UTF8 = ("windows", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-15", "mac_cyrillic")
WEST, CYRILLIC = ("windows", "mac_roman", "cp437", "cp850"), ("cp1251", "koi8-r", "cp866", "mac_cyrillic", "iso8859-5")
SWAPS = (
    ("latin-1", "windows"),
    *((w, c) for w in WEST for c in (*CYRILLIC, "cp1250", "iso8859-2", "shift_jis", "euc_jp")),
    *((a, b) for a in WEST for b in WEST if a != b),
    *((a, b) for a in CYRILLIC for b in (*CYRILLIC, "windows") if a != b),
    ("cp1250", "windows"), ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250"), ("iso8859-2", "windows"), ("shift_jis", "windows"),
)


def _one_byte(error: UnicodeEncodeError) -> tuple[bytes, int]:
    """C1 controls are their own bytes (unused ones of cp1252, or of Latin-1); anything else is no byte of the encoding."""
    part = error.object[error.start : error.end]
    return bytes(ord(c) if "\x80" <= c < "\xa0" else 0x3F for c in part), error.end


codecs.register_error("leafmill-one-byte", _one_byte)


def as_bytes(text: str, encoding: str) -> bytes:
    """One byte for each character; ? for those that the encoding hasn't."""
    return text.encode("cp1252", "leafmill-one-byte") if encoding == "windows" else text.encode(encoding, "replace")


def to_bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that `encoding` reads as `text`, None if there are none."""
    if encoding == "windows":
        raw = as_bytes(text, encoding)
        return raw if raw.count(b"?") == text.count("?") else None
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        return None


_C1 = re.compile("[\x7f-\x9f]")
_WINDOWS = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)]


def decoded(raw: bytes, encoding: str) -> str | None:
    if encoding == "windows":
        return "".join(map(_WINDOWS.__getitem__, raw))
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return None


@lru_cache(None)
def byte_of(encoding: str) -> dict[str, int]:
    """The characters beyond ASCII that a one-byte encoding has, and their bytes."""
    out = {c: b for b in range(0x80, 0x100) if (c := decoded(bytes([b]), encoding)) and c > "\x7f"}
    return out | ({chr(b): b for b in range(0x80, 0xA0)} if encoding == "windows" else {})


@lru_cache(None)
def _misread_utf8(encoding: str) -> re.Pattern:
    """Well-formed UTF-8 of more than one byte as its characters are when it is read as `encoding`."""
    of = byte_of(encoding)
    some = lambda a, b: "[" + "".join(re.escape(c) for c, n in of.items() if a <= n <= b) + "]"
    last = some(0x80, 0xBF)
    forms = ((0xC2, 0xDF, None, 0), (0xE0, 0xE0, (0xA0, 0xBF), 1), (0xE1, 0xEF, (0x80, 0xBF), 1), (0xF0, 0xF0, (0x90, 0xBF), 2), (0xF1, 0xF4, (0x80, 0xBF), 2))
    return re.compile("|".join(some(a, b) + (some(*second) if second else "") + last * (more or 1) for a, b, second, more in forms))


def utf8_again(text: str, encoding: str) -> str:
    """`text` with the well-formed UTF-8 that was read as `encoding` read as UTF-8."""
    of = byte_of(encoding)
    return _misread_utf8(encoding).sub(lambda m: decoded(bytes(map(of.__getitem__, m[0])), "utf-8") or m[0], text)


@lru_cache(None)
def swap_table(read: str, written_in: str) -> dict[str, str]:
    """What the characters beyond ASCII of one one-byte encoding are in another."""
    return {c: d for c, b in byte_of(read).items() if (d := decoded(bytes([b]), written_in))}


_WIDE = {"shift_jis", "euc_jp"}
_WIDE_SWAPS = [x for x in SWAPS if _WIDE & set(x)]
#: Encodings in which byte A0, which may end a UTF-8 sequence, is a no-break space, so that it is easily lost.
_BLANK_A0 = [e for e in MISREAD_UTF8 if e == "windows" or b"\xa0".decode(e) == "\xa0"]


_NARROW_SWAPS = [x for x in SWAPS if not _WIDE & set(x)]


@lru_cache(1 << 16)
def _one_byte_swaps(chars: str) -> list[tuple[dict[int, str], tuple[str, ...]]]:
    """What the chains between one-byte encodings make of these characters, each different result once."""
    out: dict[str, tuple[str, ...]] = {}
    own = set(chars)
    for read, written_in in _NARROW_SWAPS:
        if own <= (table := swap_table(read, written_in)).keys() and (c := "".join(map(table.__getitem__, chars))) != chars and not _C1.search(c):
            out.setdefault(c, (read, "to " + written_in))
    return [(dict(zip(map(ord, chars), c, strict=True)), chain) for c, chain in out.items()]


def through_utf8(token: str) -> dict[str, tuple[str, ...]]:
    """What the token is when the UTF-8 in it is read as such, once or twice, also where its last byte became a blank; the first chain to reach a form counts."""
    once: dict[str, tuple[str, ...]] = {}
    for e in MISREAD_UTF8:
        if (c := utf8_again(token, e)) != token:
            once.setdefault(c, (e,))
    if token[-1] > "\x7f":
        for e in _BLANK_A0:
            if "\xa0" not in (c := utf8_again(token + "\xa0", e)):
                once.setdefault(c, (e, "with a blank"))
    out = dict(once)
    for c, chain in once.items():
        for e in MISREAD_UTF8:
            if not c.isascii() and (d := utf8_again(c, e)) != c:
                out.setdefault(d, (*chain, e))
    return out


def between_others(token: str) -> dict[str, tuple[str, ...]]:
    """What the token is when its bytes are read in another encoding than UTF-8."""
    out = {token.translate(table): chain for table, chain in reversed(_one_byte_swaps("".join(sorted({x for x in token if x > "\x7f"}))))}
    raw = {}
    for read, written_in in _WIDE_SWAPS:
        if read not in raw:
            raw[read] = to_bytes(token, read)
        if raw[read] is not None and (c := decoded(raw[read], written_in)) and c != token and not _C1.search(c):
            out.setdefault(c, (read, "to " + written_in))
    return out


_ODD = re.compile(r"[^\x00-\x7f]")
_LOSSES = re.compile("[�\x80-\x84\x86-\x9f]")


def candidates(token: str) -> tuple[dict[str, tuple[str, ...]], dict[str, tuple[str, ...]]]:
    """What the token may have been and the chain that leads there: forms through UTF-8 or with a loss, and those between other encodings."""
    utf8 = through_utf8(token)
    if _LOSSES.search(token):
        utf8.setdefault(_LOSSES.sub(LOST, token), ("lost",))
    return utf8, between_others(token)


def folded_codes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of the lower-cased tokens as numbers, two spaces before and one after each, digits and spaces as one; and each one's token."""
    low = [t.lower() for t in tokens]
    x = np.frombuffer("".join([f"  {t} " for t in low]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    x[(x >= 49) & (x <= 57)] = 48
    x[((x >= 0x2000) & (x <= 0x200A)) | np.isin(x, (0xA0, 0x1680, 0x202F, 0x205F, 0x3000))] = 32
    return x, np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)) + 3)


def trigrams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of the tokens as numbers, and each one's token."""
    x, owner = folded_codes(tokens)
    inside = owner[:-2] == owner[2:]
    return ((x[:-2] * SPAN + x[1:-1]) * SPAN + x[2:])[inside], owner[:-2][inside]


def orders(abc: np.ndarray) -> list[np.ndarray]:
    """What is counted of a trigram: itself, its first two characters, its last two, the middle one, the last one, and all."""
    return [abc, abc // SPAN, abc % (SPAN * SPAN), abc // SPAN % SPAN, abc % SPAN, np.zeros_like(abc)]


def cells_of(keys: np.ndarray, order: int, slot: int) -> np.ndarray:
    """The cells of keys in both rows of the table."""
    h = mixed(keys.view(np.uint64) ^ mixed(np.array([slot * 8 + order + 1], np.uint64)))
    return np.stack([(h & np.uint64(CELLS - 1)).astype(np.int64), (h >> np.uint64(40)).astype(np.int64) % CELLS + CELLS])


class CharModel:
    """Interpolated trigram probabilities of lower-cased characters, of all records (slot 0) and of each language."""

    WEIGHTS = (0.7, 0.2, 0.0999)

    def __init__(self, cells: np.ndarray, counts: np.ndarray, slots: list[int]) -> None:
        self.table = np.zeros(2 * CELLS, np.float32)
        self.table[cells] = counts
        self.slots = slots
        self.rest = 0.0001 / SPAN

    def _logs(self, abc: np.ndarray, slot: int) -> np.ndarray:
        of = [self.table[cells_of(k, n, slot)].min(axis=0).astype(np.float64) for n, k in enumerate(orders(abc))]
        share = lambda n, all_: np.divide(of[n], of[all_], out=np.zeros(len(abc)), where=of[all_] > 0).clip(0, 1)
        w3, w2, w1 = self.WEIGHTS
        return np.log(w3 * share(0, 1) + w2 * share(2, 3) + w1 * share(4, 5) + self.rest)

    def scores(self, forms: list[str], lost: bool = False) -> np.ndarray:
        """Natural logarithms of the forms' probabilities, each by the language in which it is likeliest. With `lost`, a lost character is unobserved."""
        abc, owner = trigrams(forms)
        distinct, at = np.unique(abc, return_inverse=True)
        best = np.full(len(forms), -math.inf)
        for slot in self.slots:
            p = self._logs(distinct, slot)
            if lost:
                p[distinct % SPAN == ord(LOST)] = UNOBSERVED
            best = np.maximum(best, np.bincount(owner, p[at], len(forms)))
        return best


@lru_cache(1 << 18)
def clean_token(token: str) -> bool:
    return not UNCLEAN.search(token) and all((c := utf8_again(token, e)) == token or RARE.search(c) for e in ("windows", "mac_roman", "cp437", "cp1251"))


def tokens_of(text: str) -> list[str]:
    return [t for t in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if t]


def slot_of(lang: str | None) -> int:
    """The slot of a language, 0 for an unknown one."""
    name = (lang or "").strip().lower()
    return zlib.crc32(name.encode()) % LANGUAGES + 1 if name not in ("", "und") else 0


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, slot of its records' language, and how often it stands in clean ones. Tokens of ASCII count in clean records only."""
    held: dict[int, defaultdict[str, int]] = defaultdict(lambda: defaultdict(int))

    def flush() -> Iterator[pa.RecordBatch]:
        for slot, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array([slot] * len(counts), pa.int32()), pa.array(counts.values(), pa.int64())], ["token", "slot", "n"])
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            tokens = tokens_of(_DIGIT.sub("0", text))
            odd = [] if text.isascii() else [t for t in set(tokens) if not t.isascii()]
            counts = held[slot_of(lang)]
            if all(map(clean_token, odd)):
                for t in tokens:
                    counts[t] += 1
            else:
                for t in odd:
                    counts[t] += 0
        if sum(map(len, held.values())) > MOST_COUNTED:
            yield from flush()
    yield from flush()


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        abc, owner = trigrams(batch.column("token").to_pylist())
        slots, n = batch.column("slot").to_numpy()[owner], batch.column("n").to_numpy()[owner]
        cells, counts = [], []
        for slot in np.unique(slots).tolist():
            here = slots == slot
            for order, keys in enumerate(orders(abc[here])):
                distinct, at = np.unique(keys, return_inverse=True)
                total = np.bincount(at, n[here])
                for s in {0, slot}:
                    cells += [*cells_of(distinct, order, s)]
                    counts += [total, total]
        distinct, at = np.unique(np.concatenate(cells), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(np.bincount(at, np.concatenate(counts)).astype(np.int64))], ["cell", "n"])


def train(tokens: DataFrame) -> CharModel:
    """The models of all clean records, from their counted tokens. Spark sums the counts; at most 2 * CELLS of them reach the driver."""
    counted = tokens.filter("n > 0")
    slots = sorted({0} | {r.slot for r in counted.select("slot").distinct().collect()})
    cells = counted.mapInArrow(_count_cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    return CharModel(cells.column("cell").to_numpy(), cells.column("n").to_numpy(), slots)


def garbled_on_purpose(token: str) -> tuple[str | None, str | None]:
    """The token as wrong decodings leave it: its UTF-8 read in another encoding, and its bytes in one other encoding read in
    another. The token's hash says which, of those that apply; None where none does."""
    raw, seed = token.encode("utf-8", "surrogatepass"), zlib.crc32(token.encode("utf-8", "surrogatepass"))
    rotated = lambda xs: (xs[(seed + n) % len(xs)] for n in range(len(xs)))
    utf8 = next((c for e in rotated(MISREAD_UTF8) if (c := decoded(raw, e)) and c != token), None)
    odd = {x for x in token if x > "\x7f"}
    tables = (table for read, written_in in rotated(_NARROW_SWAPS) if odd <= (table := swap_table(written_in, read)).keys())
    other = next((c for table in tables if (c := token.translate({ord(x): table[x] for x in odd})) != token), None)
    return utf8, other


def script(token: str) -> str:
    """The script of the first character beyond ASCII; all that aren't letters are one."""
    c = next(x for x in token if x > "\x7f")
    return unicodedata.name(c, "?").split()[0] if c.isalpha() else "SYMBOL"


def visible(form: str) -> str:
    """Without the marks and joiners that show nothing, which few clean records have."""
    return "".join(c for c in form if c not in INVISIBLE) or form


def _best(model: CharModel, tokens: list[str], own: np.ndarray, forms: list[dict[str, tuple[str, ...]]], plain: Callable[[str], str]) -> tuple[list[float], list[str | None], list[tuple[str, ...] | None]]:
    """How much likelier each token's likeliest form, after `plain`, is than the token, that form, and its chain; 0 and null where there is no form."""
    flat = [f for x in forms for f in x]
    owner = np.repeat(np.arange(len(forms)), np.fromiter(map(len, forms), np.int64, len(forms)))
    gain, best, chain = [0.0] * len(tokens), [None] * len(tokens), [None] * len(tokens)
    if flat:
        s = model.scores([plain(f) for f in flat], lost=True) - own[owner]
        order = np.lexsort((np.arange(len(s)), -s, owner))
        first = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        for k in first.tolist():
            o = int(owner[k])
            gain[o], best[o], chain[o] = float(s[k]), flat[k], forms[o][flat[k]]
    return gain, best, chain


#: u: chains through UTF-8 or with a loss, s: chains between other encodings; what the likeliest form gains, and what the clean token gains when it is garbled.
JUDGED = "token string, clean boolean, many boolean, script string, u double, u_form string, u_chain array<string>, s double, s_form string, s_chain array<string>, u_true double, s_true double"


def _judge(model: Broadcast):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, same = model.value, transducer()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                tokens = part.column("token").to_pylist()
                clean = [n > 0 and clean_token(t) for t, n in zip(tokens, part.column("n").to_pylist(), strict=True)]
                as_is = m.scores(tokens)
                own = np.maximum(as_is, m.scores([same(t) for t in tokens]))  # look-alikes and special spaces aren't garbled
                found = list(map(candidates, tokens))
                u, s = (_best(m, tokens, own, [f[k] for f in found], plain) for k, plain in enumerate((visible, str)))
                true, purpose = [], [garbled_on_purpose(t) if c else (None, None) for t, c in zip(tokens, clean, strict=True)]
                for k in (0, 1):
                    wrong = [(n, x[k]) for n, x in enumerate(purpose) if x[k]]
                    gains: list[float | None] = [None] * len(tokens)
                    if wrong:
                        for (n, _), score in zip(wrong, m.scores([w for _, w in wrong]).tolist(), strict=True):
                            gains[n] = float(as_is[n]) - score
                    true.append(pa.array(gains, pa.float64()))
                columns = [part.column("token"), pa.array(clean), pa.array([len(_ODD.findall(t)) > 1 for t in tokens]), pa.array(map(script, tokens), pa.string())]
                for gain, form, chain in (u, s):
                    columns += [pa.array(gain, pa.float64()), pa.array(form, pa.string()), pa.array(chain, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, *true], ["token", "clean", "many", "script", "u", "u_form", "u_chain", "s", "s_form", "s_chain", "u_true", "s_true"])

    return run

def judged(tokens: DataFrame, model: CharModel) -> DataFrame:
    """Each distinct token beyond ASCII with its likeliest forms (see JUDGED)."""
    spark = tokens.sparkSession
    odd = tokens.filter(F.col("token").rlike(r"[^\x00-\x7f]")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "token").groupBy("token").agg(F.sum("n").alias("n"))  # few bytes, much work: as many tasks as asked for
    return odd.mapInArrow(_judge(spark.sparkContext.broadcast(model)), JUDGED)


def margins(judgements: DataFrame) -> dict[str, float]:
    """The margins of chains through UTF-8 (u) and between other encodings, for tokens of one character beyond ASCII (s) and of more (m). Spark counts the gains of all clean tokens; a histogram for each script reaches the driver."""
    each = judgements.filter("clean").select("script", F.explode(F.array(*(F.struct(F.concat(F.when(F.col("many") & F.lit(k == "s"), "m").otherwise(k), F.lit(end)).alias("kind"), F.col(k + end).alias("gain")) for k in ("u", "s") for end in ("", "_true")))).alias("x"))
    step = F.least(F.greatest(F.ceil(F.col("x.gain") * STEPS), F.lit(0)), F.lit(MOST_STEPS)).cast("int")
    counts: dict[str, dict[str, dict[int, int]]] = defaultdict(lambda: defaultdict(dict))
    for r in each.filter("x.gain IS NOT NULL").groupBy("script", "x.kind", step.alias("step")).count().collect():
        counts[r.kind][r.script][r.step] = r["count"]

    def quantile(of: dict[int, int], above: float) -> float:
        """The gain that as large a share as `above` exceeds."""
        rest = sum(of.values()) * above
        for step in sorted(of, reverse=True):
            rest -= of[step]
            if rest < 0:
                return step / STEPS
        return 0.0

    def together(kind: str) -> dict[int, int]:
        out: dict[int, int] = defaultdict(int)
        for of in counts[kind].values():
            for step, n in of.items():
                out[step] += n
        return out

    def margin(kind: str) -> float:
        """Scripts of too few tokens for that share to be one of them count in the whole alone."""
        large = [of for of in counts[kind].values() if sum(of.values()) * FALSE >= 1]
        low = max(quantile(of, FALSE) for of in (together(kind), *large))
        half = quantile(together(f"{kind}_true"), 0.5)
        return min(low + GUARD, max(low, half)) if half else low + GUARD

    return {kind: margin(kind) for kind in ("u", "s", "m")}


def garbled_tokens(judgements: DataFrame) -> DataFrame:
    """The tokens (their digits as 0) with a form beyond the margin, and the chain to the likeliest: token, chain."""
    least = margins(judgements)
    utf8, other = F.col("u") > least["u"], F.col("s") > F.when(F.col("many"), least["m"]).otherwise(least["s"])
    chain = F.when(utf8 & ~(other & (F.col("s") > F.col("u"))), F.col("u_chain")).when(other, F.col("s_chain"))
    return judgements.select("token", chain.alias("chain")).filter("chain IS NOT NULL")


def applied(token: str, chain: list[str]) -> str:
    """The token after the chain's steps."""
    if chain[0] == "lost":
        return token
    if chain[-1].startswith("to "):
        return decoded(to_bytes(token, chain[0]) or b"", chain[-1].removeprefix("to ")) or token
    for e, then in zip(chain, [*chain[1:], ""], strict=True):
        if e != "with a blank":
            token = utf8_again(token + "\xa0" * (then == "with a blank"), e)
    return token


def restore(text: str, known: dict[str, list[str]]) -> tuple[str, int, int]:
    """The text restored, its garbled tokens, and those in which something is lost."""
    if text.isascii() or known.keys().isdisjoint(tokens_of(_DIGIT.sub("0", text))):
        return text, 0, 0
    parts, n, lossy = PARTS.split(text), 0, 0
    for k in range(0, len(parts), 2):
        if (chain := known.get(_DIGIT.sub("0", parts[k]))) is not None:
            n += 1
            parts[k] = applied(parts[k], chain)
            lossy += bool(_LOSSES.search(parts[k]))
    return "".join(parts), n, lossy


def _restore(known: Broadcast | None):  # noqa: ANN202
    """Of rows with own chains (found), or by those that all tasks have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [known.value] * batch.num_rows if known is not None else ({x["token"]: x["chain"] for x in f} for f in batch.column("found").to_pylist())
            rows = [(i, *restore(t, k)) for i, t, k in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), own, strict=True)]
            rows = [r for r in rows if r[2]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32()))], ["doc_id", "text", "n_garbled", "n_lost"])

    return run


def _odd_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and token: the tokens beyond ASCII of each row, their digits as 0."""
    for batch in batches:
        rows = [(k, o) for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True) if not t.isascii() for o in {x for x in tokens_of(_DIGIT.sub("0", t)) if not x.isascii()}]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["key", "token"])


def restored(documents: DataFrame) -> DataFrame:
    """The affected documents: doc_id, text (restored as far as it can be), n_garbled (tokens), n_lost (of these, with something lost).

    Null and empty texts are never affected. Repeated rows give equal rows; callers take the distinct ones. Documents
    without a column lang are of one unknown language. Up to MOST_SENT garbled tokens, by a count, all tasks are sent
    them; more are joined with the tokens of each text."""
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    texts = documents.filter("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", lang.alias("lang"))
    tokens = written(texts.select("text", "lang").mapInArrow(_count_tokens, "token string, slot int, n bigint").groupBy("token", "slot").agg(F.sum("n").alias("n")), "tokens")
    found = written(garbled_tokens(written(judged(tokens, train(tokens)), "judged")), "garbled")
    out = "doc_id bigint, text string, n_garbled int, n_lost int"
    if found.count() <= MOST_SENT:
        known = {r["token"]: r["chain"] for r in found.toArrow().to_pylist()}
        return texts.select("doc_id", "text").mapInArrow(_restore(documents.sparkSession.sparkContext.broadcast(known)), out)
    keyed = texts.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    of = keyed.select("key", "text").mapInArrow(_odd_tokens, "key bigint, token string").distinct().join(found, "token").groupBy("key").agg(F.collect_list(F.struct("token", "chain")).alias("found"))
    return keyed.join(of, "key").select("doc_id", "text", "found").mapInArrow(_restore(None), out)
