"""Lines, splitting, canonical forms, tokens and garbled text: against brute force, round trips and a tokenizer library."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from leafmill.llm import bpe, budget, canonical, encoding, garble, lines, splitting

BLOCK = "block_id string, source_file string, doc_type string, block_type string, section_path array<string>, page_number int, text string"
random.seed(3)


def pages(spark, rows):
    return spark.createDataFrame([(i, f, "pdf", "page_text", None, p, t) for i, f, p, t in rows], BLOCK)


def brute_lines(rows):
    on, size = {}, {}
    for _, f, p, t in rows:
        if p is not None:
            size.setdefault(f, set()).add(p)
        for line in (t or "").split("\n"):
            k = "".join(c for c in line.lower() if unicodedata.category(c)[0] == "L")
            if k and t is not None and p is not None:
                on.setdefault((f, k), set()).add(p)
    out = set()
    for i, f, _, t in rows:
        for n, line in enumerate(t.split("\n") if t is not None else [], 1):
            k = "".join(c for c in line.lower() if unicodedata.category(c)[0] == "L")
            pp = on.get((f, k), ())
            if k and len(pp) >= 5 and len(pp) * 10 >= 3 * len(size[f]):
                out.add((i, n))
    return out


def test_repeated_lines(spark):
    rows = []
    for f in ("a.pdf", "b.pdf", None):
        for p in range(200 if f == "a.pdf" else 12):
            t = [f"Page {p} of 200", "Ümlaut – Copy", *(random.choice(["alpha", "beta 1", "gamma", "", "12"]) for _ in range(3))]
            if p % 3 == 0:
                t.append("EVERY third" if p % 2 else "every  Third!")
            rows.append((f"{f}-{p}", f, p, "\n".join(t)))
    rows += [("null", "a.pdf", 3, None), ("empty", "a.pdf", 4, ""), ("nopage", "a.pdf", None, "Page 7 of\nother"), ("once", "c.pdf", 1, "line\nline")]
    df = pages(spark, rows)
    got = {(r.block_id, r.line_no) for r in lines.lines_to_delete(df.union(df)).distinct().collect()}
    assert got == brute_lines(rows) and ("nopage", 1) in got
    clean = {r.block_id: r for r in lines.without_lines(df.union(df).withColumn("of", F.lit(1))).collect()}
    assert len(clean) == len(rows) and clean["null"].text is None and clean["empty"].text == "" and clean["nopage"].text == "other"
    assert lines.lines_to_delete(df.limit(0)).count() == 0


def joined(text, parts):
    return "".join(text[a + shared : b] for a, b, shared in parts)


@pytest.mark.parametrize("kind", ["", "table", "row", "bullet"])
def test_pieces_round_trip(kind):
    alphabet = ["word ", "longerword ", "End. ", "\n", "\n\n", " | ", "字", "é", "x" * 30, "👩‍🔧", "。"]
    for n in range(300):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(1, 120))).strip()
        limit, overlap = random.choice([5, 17, 60, 200]), random.choice([0, 1, 4])
        parts = splitting.pieces(text, limit, overlap, kind)
        assert all(0 < b - a <= limit for a, b, _ in parts) or not text, (n, text, limit)
        assert joined(text, parts) == text
        assert all(shared == 0 for _, _, shared in parts) or overlap
        assert (len(parts) > 1) == (len(text) > limit)


def test_pieces_prefer_boundaries():
    text = "First sentence here. Second sentence here.\n\nNew paragraph starts. It goes on."
    cut = [text[a:b].strip() for a, b, _ in splitting.pieces(text, 50, 0)]
    assert cut == ["First sentence here. Second sentence here.", "New paragraph starts. It goes on."]
    with_overlap = [text[a:b] for a, b, _ in splitting.pieces(text, 50, 2)]
    assert with_overlap[1].startswith("sentence here.")
    two = ("word " * 20).strip() + "\n\n" + ("other " * 28).strip()
    assert [(a, b) for a, b, _ in splitting.pieces(two, 200, 2)][0] == (0, 101)  # the second paragraph fits a piece beside the overlap
    shared = [text.split() for text in (two[a : a + n] for a, _, n in splitting.pieces(two, 200, 2)[1:])]
    assert shared == [["word", "word"]]
    long = " ".join(f"word{n}" for n in range(500))
    assert all(len(long[a : a + n].split()) == 24 for a, _, n in splitting.pieces(long, 300, 24)[1:])
    assert splitting.pieces("e" + "́" * 50, 10, 0)[0][:2] == (0, 10)


@pytest.mark.parametrize("run", ["0123456789abcdef" * 40, "長い文字列" * 100, "👩‍🔧é" * 90])
def test_pieces_of_unbroken_runs_overlap(run):
    for text in (run, "Some words before. " + run):
        parts = splitting.pieces(text, 200, 24)
        assert all(b - a <= 200 for a, b, _ in parts) and joined(text, parts) == text
        inside = [(a, shared) for a, _, shared in parts[1:] if a >= len(text) - len(run)]
        assert len(inside) > 1 and all(80 <= shared <= 96 for _, shared in inside[1:])
        clusters = {m.start() for m in splitting.GRAPHEME.finditer(text)}
        assert all(a in clusters for a, _ in inside)


def test_split_oversized(spark):
    rows = [("a", "f", "docx", " Paragraph ", ["S"], None, "  " + "word " * 30 + " "), ("b", "f", "docx", "paragraph", None, None, "x" * 20 + " " * 50), ("n", "f", "docx", None, None, None, None), ("e", "f", "docx", None, None, None, ""), ("u", "f", "other", None, None, None, "y" * 999), ("long", "f", "docx", None, None, None, "z" * 100_000)]
    df, limits = spark.createDataFrame(rows, BLOCK), spark.createDataFrame([("docx", 40, 9, 2), ("docx", 40, 9, 2), ("bad", 0, 0, 0), (None, 1, 1, 1)], "doc_type string, max_chars int, max_tokens int, overlap_tokens int")
    got = splitting.split_oversized(df.withColumn("max_chars", F.lit(0)), limits).collect()
    assert {r.block_id for r in got} == {"a", "long"} and all(len(r.text) <= 40 for r in got)
    a = sorted((r for r in got if r.block_id == "a"), key=lambda r: r.piece_no)
    assert "".join(r.text[r.overlap_chars :] for r in a) == ("word " * 30).strip() and a[1].overlap_chars > 0 and a[0].section_path == ["S"]
    assert splitting.split_oversized(df.limit(0), limits).count() == 0
    with pytest.raises(Exception, match="the overlap of docx"):
        splitting.split_oversized(df, limits.withColumn("overlap_tokens", F.lit(10))).collect()


def test_canonical_forms():
    t = canonical.Transducer()
    same = {"Ｃａｆé": "Café", "Café": "Café", "no­br​ea﻿k": "nobreak", "a b c　d": "a b c d", "Тhіѕ": "This", "ﬁnal oﬀer…": "final offer...", "Key": "Key", "ｶﾞ": "ガ", "A‑B": "A-B", "u‍̈": "ü", "ӑ": "ă", "a\r\nb": "a\nb"}
    for a, b in same.items():
        assert t(a) == b and t(b) == b, a
    assert t("𝐀bc ɡ ՕՏ Ꭺ ꓮ 𝚨") == "Abc g OS A A A"
    r = canonical.Reader()
    for own in ("Москва и Россия", "ΑΘΗΝΑ και Ελλάδα", "СССР", "Հայաստան", "Café, naïve", "plain"):
        assert r(own) == own
    assert r("Тhіѕ") == "This" and r("Моcквa") == "Москва" and r("Ｃａｆé x​") == "Café x" and r("рayment СССР") == "payment СССР"
    different = ["FOR", "for", "cafe", "café", "10²", "102", "a–b", "a-b", "ł", "l"]
    assert len({t(x) for x in different}) == len(different)
    assert t("👩‍🔧") == "👩‍🔧" and t("") == ""
    for o in range(0x20, 0x3000):
        x = t(chr(o) + "x")
        assert t(x) == x, hex(o)


def test_same_look(spark):
    c = spark.createDataFrame([(1, "f", "Тhіѕ is"), (1, "f", "Тhіѕ is"), (2, "f", "This is"), (3, "f", None), (4, "f", "​"), (5, None, "This is"), (6, "g", "This is")], "citation_id bigint, source string, text string")
    b = spark.createDataFrame([("x", "f", "This is"), ("x", "f", "This is"), ("y", "f", ""), ("z", "f", None), ("w", "h", "Тhіѕ is"), ("v", "g", "This is"), ("u", "f", "this is")], "block_id string, source_file string, text string")
    got = sorted(map(tuple, canonical.same_look(c, b).collect()))
    assert got == [(1, "x"), (6, "v")]
    assert canonical.same_look(c.limit(0), b).count() == 0 and canonical.same_look(c, b.limit(0)).count() == 0


TEXTS = [None, "", " ", "Hello world, it's 2024!", "a" * 5000, "naïve café – 日本語のテキスト", "tabs\tand\n\n newlines \x85  x", "<|endoftext|> stays", "👩‍🔧🏽 emoji", "'ll 've can't", "x" + " " * 300 + "y", "²³ ½ Ⅷ", "aaaa" * 77 + " b", "\x1c\x1d odd"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    return t


def test_encoding(spark, library, sf):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    docs = docs.union(docs.limit(5)).withColumn("ids", F.lit(1))
    for size in (3, encoding.LEXICON):
        got = {r.doc_id: list(r.ids) for r in encoding.encode(docs, lexicon_size=size).collect()}
        assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    real = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in real.select("doc_id", "text").collect()}
    assert {r.doc_id: list(r.ids) for r in encoding.encode(real).collect()} == truth
    assert encoding.encode(docs.limit(0)).count() == 0


def test_lexicon_shares_endings():
    words = sorted(w.encode() for w in ["walking", "talking", "king", "kin", "walk", "é", "", "talk"])
    data = encoding.compile_lexicon(words, [[n, n * 2] for n in range(len(words))])
    lex = encoding.Lexicon(data)
    assert lex.numbers([*words, b"wal", b"kings", b"zzz"]).tolist() == [*range(len(words)), -1, -1, -1]
    assert [lex.of(n).tolist() for n in range(len(words))] == [[n, n * 2] for n in range(len(words))]
    assert len(lex.final) < sum(map(len, words)) / 1.5


def test_token_counts_and_budget(spark, library):
    texts = spark.createDataFrame([("block", str(i), t) for i, t in enumerate(TEXTS)], "kind string, id string, text string")
    for frequent in (2, budget.FREQUENT):
        got = {r.id: r.n_tokens for r in budget.token_counts(texts.union(texts), frequent=frequent).collect()}
        assert got == {str(i): len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    b = spark.createDataFrame([("1", "f", "pdf", "one two"), ("1", "f", "pdf", "one two"), ("2", "g", "pdf", "three"), ("3", None, None, None)], "block_id string, source_file string, doc_type string, text string")
    d = spark.createDataFrame([(1, "s", "EN", " ", "one"), (2, "s", "en", None, "two"), (3, None, None, "x", None)], "doc_id bigint, source string, lang string, domain string, text string")
    s = spark.createDataFrame([("f", "EN", "ops", "pdf", 1), ("f", "de", "ops", "pdf", 0), ("empty", None, None, "docx", 1)], "source_file string, lang string, domain string, doc_type string, ingested_at int")
    m = budget.MISSING
    got = {(r.kind, r.doc_type, r.source, r.lang, r.domain): (r.n_texts, r.n_tokens) for r in budget.budget(b, d, s).collect()}
    assert got == {
        ("block", "pdf", "f", "en", "ops"): (1, 2), ("block", "pdf", "g", m, m): (1, 1), ("block", m, m, m, m): (1, 0), ("block", "docx", "empty", m, m): (0, 0),
        ("document", "(all)", "s", "en", m): (2, 2), ("document", "(all)", m, m, "x"): (1, 0),
    }
    assert budget.token_counts(texts.limit(0)).count() == 0


WORDS = {"de": "für die Prüfung während der Übergabe über Größe und Störung möglich schließt häufig".split(), "fr": "après la réunion prévue à l’été le contrôle détaillé réduit déjà hypothèse façade".split(), "ru": "каждый новый отчёт перед складом меняет объём заявка после проверки график смена договор через весь насос".split(), "en": "the report – changes €12 every week “once” more and the old plan ends…".split()}


def test_restoring_held_out_texts(spark):
    """Trained on clean texts, garbled ones that weren't seen are found and restored."""
    rng = random.Random(5)
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    clean = [text(lang, 60) for lang in WORDS for _ in range(60)]
    wrong = {}
    for k, lang in enumerate(WORDS):
        for e in ("latin-1", "cp1252", "mac_roman", "cp437", "cp1251"):
            t = text(lang, 12)
            try:
                wrong[1000 + len(wrong)] = (t, t.encode("utf-8").decode(e))
            except UnicodeDecodeError:
                continue
    for _ in range(5):
        t = text("ru", 12)
        wrong[1000 + len(wrong)] = (t, t.encode("cp1251").decode("cp1252"))
    t = text("de", 12) + " für"
    wrong[1999] = (None, t.encode("cp1252").decode("utf-8", "replace"))
    docs = spark.createDataFrame([*enumerate(clean), *((i, w) for i, (_, w) in wrong.items()), (5000, None), (5001, ""), (5002, "plain")], "doc_id bigint, text string").withColumn("n", F.lit(1))
    got = {r.doc_id: r for r in garble.restored(docs).collect()}
    affected = {i for i, (t, w) in wrong.items() if t != w}
    assert set(got) == affected
    right = sum(got[i].text == wrong[i][0] for i in affected if wrong[i][0])
    assert right >= 0.9 * (len(affected) - 1) and got[1999].n_lost > 0
    assert garble.restored(docs.limit(0)).count() == 0


def test_restoring_single_odd_characters(spark):
    """One garbled character at a word's end or start is enough, in a text known to be garbled by another token."""
    rng = random.Random(6)
    words = "śluza śledzi średni dziś jesienią zmieniał zmieniała część więcej raport skład nowy plan".split()
    clean = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(200)]
    whole = "średni raport dziś śluza zmieniał plan jesienią zmieniała"
    docs = spark.createDataFrame([*enumerate(clean), (900, whole.encode("cp1250").decode("cp1252")), (901, "nowy skład – “plan” raport…")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in garble.restored(docs).collect()}
    assert got == {900: whole}


def test_restoring_when_tokens_are_joined(spark):
    """The way for more garbled tokens than tasks are sent gives the same texts."""
    rng = random.Random(7)
    clean = [" ".join(rng.choice(WORDS["de"]) for _ in range(40)) for _ in range(80)]
    wrong = [(900 + k, " ".join(rng.choice(WORDS["de"]) for _ in range(9)).encode().decode(e)) for k, e in enumerate(("latin-1", "cp1252", "cp437"))]
    docs = spark.createDataFrame([*enumerate(clean), *wrong, (950, "Gr��e und für"), (None, wrong[0][1])], "doc_id bigint, text string").withColumns({"lang": F.lit("DE"), "token": F.lit(1)})
    sent = {r.doc_id: tuple(r) for r in garble.restored(docs).collect()}
    keep, garble.MOST_SENT = garble.MOST_SENT, 0
    try:
        joined_ = {r.doc_id: tuple(r) for r in garble.restored(docs).collect()}
    finally:
        garble.MOST_SENT = keep
    assert sent == joined_ and set(sent) == {900, 901, 902, 950, None} and sent[950][3] == 1


def test_chains_are_applied_as_judged():
    for token in ("PrÃ¼fung", "Ã", "Ïðèâåò", "â€œx", "кНЯЕБН", "ÃƒÂ¼ber"):
        for found in garble.candidates(token):
            assert all(garble.applied(token, list(chain)) == form for form, chain in found.items())
