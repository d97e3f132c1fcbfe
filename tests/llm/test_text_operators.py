"""Extraction, byte pairs, personal data, token files, archives: brute force, round trips and odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomspan.llm import bpe, html_extract, pii, token_files, warc

LONG = "Of the inanin erwh " * 4000
DOCS = [(1, "Hello world, it's 3.5 o'clock."), (2, None), (3, ""), (4, "  \n\t "), (5, LONG), (5, LONG), (None, "naïve café 日本語 👍🏽"), (7, "x" * 30000), (8, "1" * 9000 + " " * 500 + "a")]


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with names used inside
    return spark.createDataFrame([(a, b, "x", 1) for a, b in DOCS], "doc_id long, text string, id string, n int")


def empty(df):
    return df.where("false")


# 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now and save.</div>
<article><h1>Title &amp; more</h1><p><b>First &eacute;t&#233;.<br><p>Second   one.</p><p class="cookie-notice">We use cookies.</p><p>Third.</p><div id="comments"><p>Nice.</p></div></article><aside>See also</aside><form><label>Mail</label></form><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Title & more\nFirst été.\nSecond one.\nThird."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p>  </p>") == ""
    assert html_extract.main_text("just text &lt; here") == "just text < here"
    assert html_extract.main_text("<article><p>cut &am") == "cut &am"
    assert html_extract.main_text("<article><p>a</p><p>" + "b" * 10 ** 6) == "a\n" + "b" * 10**6


def test_surge_and_dive_without_article():
    menu = "".join(f'<div><a href="/{i}">Item {i}</a></div>' for i in range(8))
    body = "".join(f"<div>{'Sentence of the story number ' + str(i) + ', which is rather long so that it counts.'}</div>" for i in range(4))
    text = html_extract.main_text(f"<body><div class='menu'>{menu}</div>{menu}{body}<div>End.</div>{menu}<div class='footer'>F</div></body>")
    assert text.split("\n")[0].startswith("Sentence of the story number 0") and text.endswith("End.") and "Item" not in text


def test_windows_decide_inside_a_marked_article():
    """No class or tag tells these lines apart: link lists and runs of short lines go, short paragraphs stay."""
    body = "".join(f"<p>Sentence of the story number {i}, which is rather long so that it counts for much.</p><p>Short.</p>" for i in range(3))
    links = '<p><a href="/s">Share</a> | <a href="/t">Tweet</a></p><div><a href="/1">Read this one too</a></div>'
    short = "".join(f"<div>{x}</div>" for x in ("Like", "Send", "Print", "Top", "Next", "Back"))
    text = html_extract.main_text(f"<body><article><h1>Title</h1>{links}{body}<p>End.</p>{links}{short}</article></body>").split("\n")
    assert text[:3] == ["Title", "Sentence of the story number 0, which is rather long so that it counts for much.", "Short."]
    assert text[6:] == ["Short.", "End."]
    assert html_extract.main_text("<main>" + "<p>La.</p>" * 30 + "</main>") == "\n".join(["La."] * 30)
    assert html_extract.main_text('<main><li><a href="/">Only link</a></li></main>') == "Only link"


def test_names_are_whole_and_attributes_have_any_length():
    page = "<body><article><h1>Title of the story</h1>{}<p>The story goes on for a while here.</p></article></body>"
    for kept in ('<p class="related-work">Earlier studies.</p>', '<div class="share-price">The price fell.</div>', '<section id="search-results">Found.</section>', '<p class="advertising-history">Of posters.</p>'):
        assert "\n" + re.sub("<[^>]*>", "", kept) + "\n" in html_extract.main_text(page.format(kept))
    for gone in ('<p class="cookie-notice">We.</p>', '<div class="ad-slot-3">Buy.</div>', '<div class="commentList">Nice.</div>', '<div class="big Sidebar left">See.</div>', f'<div class="sidebar" data-x="{"a>" * 9000}">See.</div>'):
        assert html_extract.main_text(page.format(gone)) == "Title of the story\nThe story goes on for a while here."
    assert html_extract.main_text(page.format(f'<p>A<img alt="{"> x" * 9000}">b.</p>')).split("\n")[1] == "Ab."


def test_open_quotes_are_linear():
    for broken in ('<a "' * 200_000, "<a '\"" * 200_000, "<" * 500_000, '<p title="x>' * 100_001, "<a b='\">" * 100_000):
        html_extract.main_text("<article><p>Start of it all." + broken)


class Naive(__import__("html.parser").parser.HTMLParser):
    """Lines of a page by the standard parser, for pages whose elements all stand by their names alone."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.held, self.depth, self.off, self.raw, self.kind, self.inside = [], "", [], 0, 0, None, 0

    def line(self, kind=None):
        if text := " ".join(self.held.split()):
            self.lines.append((text, self.kind))
        self.held, self.kind = "", kind

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.raw += 1
        elif tag == "br":
            self.held += " "
        elif tag not in ("b", "a", "i", "em", "strong", "span", "meta"):
            self.line(tag)
            if tag == "article":
                self.inside += 1
            if tag in ("nav", "footer", "aside", "form") or (tag == "header" and not self.inside) or (tag == "div" and attrs):
                self.depth.append(tag)
            elif self.depth and tag == self.depth[-1]:
                self.depth.append(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.raw -= 1
        elif tag not in ("b", "a", "i", "em", "strong", "span"):
            self.line()
            if self.depth and self.depth[-1] == tag:
                self.depth.pop()
            if tag == "article":
                self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.depth and not self.raw:
            self.held += data


def test_real_pages_against_a_naive_version(spark):
    """Every page of a table, from the contract alone: all lines of the article but its marked-off parts."""
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        naive = Naive()
        naive.feed(row["html"])
        naive.line()
        assert html_extract.main_text(row["html"]) == "\n".join(t for t, _ in naive.lines), row["url"]


def test_articles_stay_whole():
    text = lambda page: html_extract.main_text(page).split("\n")
    long = "A long paragraph that goes on for more than ninety characters, so that it is a surge all by itself, and then some."
    assert text('<article><h1><a href="/x">The title of it</a></h1><p>First paragraph.</p><ul><li><a href="/s">See also this</a></li></ul></article>') == ["The title of it", "First paragraph.", "See also this"]
    assert text(f"<article><h1>T</h1><p>One.</p><ul><li>milk</li><li>egg</li><li>rye</li></ul><p>{long}</p></article>") == ["T", "One.", "milk", "egg", "rye", long]
    cells = "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in (("Ann", 3), ("Bo", 4), ("Cy", 5)))
    assert text(f"<article><p>{long}</p><table>{cells}</table></article>") == [long, "Ann", "3", "Bo", "4", "Cy", "5"]
    assert text(f"<article><p>{long}</p><ul><li>One</li><li>Two</li></ul><pre>x = 1</pre><blockquote>Yes.</blockquote></article>") == [long, "One", "Two", "x = 1", "Yes."]
    menu = "".join(f'<li><a href="/{i}">Part {i}</a></li>' for i in range(4))
    assert text(f"<article><ul>{menu}</ul><p>Short.</p><p><a href='/y'>A linked paragraph.</a></p></article>") == ["Short.", "A linked paragraph."]


def test_menus_after_the_text_go_without_article():
    long = "A long paragraph that goes on for more than ninety characters, so that it is a surge all by itself, and then some."
    page = f"<body><div>Home</div><div>{long}</div><div>{long}</div><div>Subscribe to our list</div><div>Terms Privacy</div></body>"
    assert html_extract.main_text(page) == f"{long}\n{long}"


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 6), (2, None, None, 6), (None, "v", "", 7)], "page_id long, url string, html string, text int")
    got = html_extract.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 42), (2, 0), (2, 0)]
    assert html_extract.extract(empty(pages)).count() == 0


# 2

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_bpe_joins_anywhere():
    small, r = bpe.Bpe(PATH, PATTERN, leaf=16), random.Random(1)
    parts = ["a", "e", " ", "  ", "\n", "'", "'s", "'re", "1", "23", "é", "ß", "!", "***", "\t", "日本", "👍", "́", "\xa0", "​", "the", " and", "\x1c", "\x85", "Ⅷ"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 120)))
        ids = small.encode(text)
        assert ids == small.encoding.encode_ordinary(text) and small.decode(ids) == text.encode()
    for text in ("a" * 40000, "the" * 20000, "".join(r.choice("abcdef") for _ in range(60000)), " " * 20000 + "x", "!" * 20000, "'" * 9000, "日本語" * 9000):
        assert bpe.Bpe(PATH, PATTERN).encode(text) == small.encoding.encode_ordinary(text)


def test_bpe_long_runs_between_anything():
    """Runs beyond a block of every kind, beside what changes their ends."""
    whole, r = bpe.Bpe(PATH, PATTERN), random.Random(2)
    kinds = [" ", "\n", "\u3000", "a", "é", "7", "!", "'", "\u200b", "-="]
    beside = ["", "'", "s", "'s", "ll", "x'", " '", "\n's", " ", "\n", "  ", " a", "abc", "!'", "7", "\n're", "''", "word word, "]
    for _ in range(150):
        text = ""
        for _ in range(r.randint(1, 5)):
            kind = r.choice(kinds)
            text += "".join(r.choice(kind) for _ in range(r.choice([900, 1023, 1024, 2047, 2048, 2500, 4000]) * r.randint(0, 1))) + r.choice(beside) * r.randint(0, 3)
        assert whole.encode(text) == whole.encoding.encode_ordinary(text)


def test_bpe_endless_runs():
    """Millions of blanks or symbols: each long run is one match and needs no scan of the whole text."""
    whole = bpe.Bpe(PATH, PATTERN)
    single = whole.encoding._encode_single_piece
    for run in (" " * 5_000_000, "!" * 5_000_000, "-=" * 500_000):
        ids = whole.encode("so" + run + "x")
        piece, rest = (run[:-1], " x") if run[0] == " " else (run, "x")
        assert ids == [*single(b"so"), *single(piece.encode()), *single(rest.encode())]
        assert whole.decode(ids) == f"so{run}x".encode()


def test_bpe_rows(docs):
    encoding = bpe.load(PATH, PATTERN)
    got = bpe.with_ids(docs, PATH, PATTERN).collect()
    assert len(got) == len(DOCS)
    want = sorted(hashlib.sha256(np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest() for _, t in DOCS)
    assert sorted(r["ids_sha256"] for r in got) == want
    assert sorted(r["decoded"] for r in got) == sorted((t or "").encode() for _, t in DOCS)
    assert bpe.with_ids(empty(docs), PATH, PATTERN).count() == 0


# 3

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            luhn = sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
            if kind == "email" or (kind == "ip" and all(int(x) < 256 for x in m[0].split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and luhn) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_base_spans(spark):
    r = random.Random(5)
    parts = ["a", "b@c.de", "@", ".", "-", "_", "+1 (222) 555-1234", "+4", "9", "12", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "0255.0.0.1", " ", "é", "👍", "\n", "(", "x@y", "5.6"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(3000)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["id"]: x for x in pii.digest(pii.find(df)).collect()}
    for i, text in enumerate(texts):
        want = brute_spans(text or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), text
        assert sum(got[i][f"n_{k}"] for k in KINDS) == (want.count(":") // 2)


def brute_added(texts, generalise=0.6, remove=0.8, support=3):
    """The added spans of each text, by counting every entity with every term."""
    from math import log2

    word = __import__("regex").compile(r"[\p{L}\p{M}]+")
    spans = [[tuple(x.split(":")) for x in brute_spans(t).split(",") if x] for t in texts]
    entities = [{t[int(a) : int(b)].lower() for _, a, b in s} for t, s in zip(texts, spans, strict=True)]
    terms = [{w for w in word.findall(t.lower()) if len(w) >= 3} for t in texts]
    once = {t: i for i, t in enumerate(texts) if entities[i]}
    keep = [i for i in range(len(texts)) if not entities[i] or once[texts[i]] == i]
    total = len(keep)
    df = lambda term: sum(term in terms[i] for i in keep)
    told = {}
    for e in set().union(*entities):
        own = [i for i in keep if e in entities[i]]
        for term in set().union(*(terms[i] for i in own)):
            n, both = df(term), sum(term in terms[i] for i in own)
            share = (both + support * n / total) / (len(own) + support)
            content = log2(total / len(own))
            told[e, term] = log2(share * total / n) / content if content > 0 else 0.0
    out = []
    for t, s, own in zip(texts, spans, entities, strict=True):
        found = []
        for m in word.finditer(t):
            best = max((told.get((e, m[0].lower()), 0.0) for e in own), default=0.0)
            if best >= generalise and not any(m.start() < int(b) and int(a) < m.end() for _, a, b in s):
                found.append((m.start(), m.end(), best >= remove))
        out.append(found)
    return out


def test_pii_added_spans_against_counting(spark):
    r = random.Random(6)
    common = "the report of this week says that all is well with our plan".split()
    people = [(f"name{c}", f"{c}x@mail.org", f"city{c}") for c in "abcdef"]
    texts = []
    for _ in range(80):
        name, mail, city = r.choice(people)
        words_ = r.choices(common, k=r.randint(4, 12)) + [name] * r.randint(0, 2) + [city] * r.randint(0, 1) + [mail] * (r.random() < 0.5)
        r.shuffle(words_)
        texts.append(" ".join(words_))
    texts += [texts[0], texts[0], ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["id"]: [(a["start"], a["end"], a["kind"] == "reveal") for a in x["added"]] for x in pii.find(df).collect()}
    want = brute_added(texts)
    assert [got[i] for i in range(len(texts))] == [[tuple(x) for x in w] for w in want] and sum(map(len, want)) > 20


def test_pii_long_runs(spark):
    texts = ["a" * 100000, "1" * 100000, "1 " * 50000, "+1" + "-" * 100000, "a@b" + ".c" * 50000]
    got = {x["id"]: x["spans"] for x in pii.digest(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "", 4: "email:0:100003"}


def test_pii_revealing_terms_and_sanitising(spark):
    """A name that stands only near one address, in several different texts, gives the address away; common words don't."""
    names = ["ant", "bee", "cat", "dog", "elk", "fox"]
    rows = [(i, f"{x} please write the note to quandrix at q.x@mail.org about {x} now") for i, x in enumerate(names)]
    rows += [(100 + i, f"please write the note at {names[i % 6]} about it now then") for i in range(300)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True)
    texts = {r["id"]: r["text"] for r in pii.sanitised(found).collect()}
    assert texts[0] == "ant please write the note to  at [EMAIL] about ant now" and texts[100] == rows[6][1]
    spans = {r["id"]: r["spans"] for r in pii.digest(found).collect()}
    assert "reveal:29:37" in spans[0] and "email" in spans[0] and spans[100] == ""


def test_pii_terms_of_whole_texts(spark):
    """One text with the address, copied: its name is far from it and stands twice; a text without the address keeps the name."""
    far = "plain words of the day go on and on " * 30
    text = f"Zorvane wrote. {far}q.x@mail.org {far}And 🙂 ZORVANE again."
    rows = [(1, text), (2, text), (3, text)] + [(100 + i, f"{far}Wrote and again number {i}.") for i in range(300)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True)
    texts = {r["id"]: r["text"] for r in pii.sanitised(found).collect()}
    want = f"[TERM] wrote. {far}[EMAIL] {far}And 🙂 [TERM] again."
    assert texts[1] == texts[2] == texts[3] == want and all(texts[i] == t for i, t in rows[3:])


def test_pii_odd_rows(docs):
    got = pii.digest(pii.find(docs))
    assert got.count() == len(DOCS) and got.where("spans <> ''").count() == 0
    assert pii.find(empty(docs)).count() == 0


# 5

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        for high in (1, 2, 50000, 2**31, 2**61):
            v = rng.integers(0, high, n)
            v[::97] = high * 2 - 1
            stream = token_files.pack(v)
            assert (token_files.unpack(stream) == v).all() and (token_files.unpack(stream, 700, 2900) == v[700:2900]).all()


def test_word_encoder_is_the_library():
    from tokenizers import Tokenizer

    e, r, whole = token_files.WordEncoder(WORDS), random.Random(3), Tokenizer.from_file(WORDS)
    assert e.by_word
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "a", "É", " ", "\n", "'", "'s", "'RE", "1", "ß", "ñ", "!", "́", "\xa0", "​", "the", "\x1c", "\x85", "İ", "ẞ", "　", "ﬁ", "Σ", "ς", "²", "×"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert e(text.encode()).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_word_encoder_of_any_other_file_is_the_library(tmp_path):
    from tokenizers import Tokenizer, normalizers

    other = Tokenizer.from_file(WORDS)
    other.normalizer = normalizers.NFC()
    other.save(str(tmp_path / "other.json"))
    e = token_files.WordEncoder(str(tmp_path / "other.json"))
    text = "The  CAT\nsat <|endoftext|>"
    assert not e.by_word and e(text.encode()).tolist() == other.encode(text, add_special_tokens=False).ids


def test_token_files(docs, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 500)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    got = sorted(token_files.read_corpus(token_files.write_corpus(docs, WORDS, 2)).collect(), key=lambda r: r["start"])
    want = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0))
    at = 0
    assert [r["id"] for r in got] == [d[0] for d in want]
    for r, (_, text) in zip(got, want, strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["tokens"], r["ids_crc32"]) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_corpus(token_files.write_corpus(empty(docs), WORDS, 2)).count() == 0


# 9


def test_url_key(spark):
    urls = ["http://WWW.Example.com:80/a?b=1", "https://a.b.org/", None, "no scheme", "http://x.y/a b"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(warc.url_key(F.col("url"))).collect()] == ["com,example,www):80/a?b=1", "org,b,a)/", "", "no%20scheme", "y,x)/a%20b"]


def test_archive_and_lookup(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    big, r = "<p>" + "x" * 200, random.Random(2)
    rows = [(i, f"http://h{r.randint(0, 5)}.com/{r.randint(0, 9)}", r.choice([big, f"<p>{i} é" + "y" * 150, "short", None, ""]), "z") for i in range(60)]
    rows += [(100, None, big, "z"), (None, "http://h1.com/n", "<b>" + "n" * 120, "z"), (7, rows[7][1], rows[7][2], "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    directory = warc.archive(pages)
    keys = pages.select(warc.url_key(F.col("url")).alias("key"))
    got = warc.lookup(directory, keys.unionByName(keys)).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        if len((h or "").encode()) >= 100:
            first.setdefault(h, i)
    for g in got:
        i, url, h, _ = next(x for x in rows if x[0] == g["page_id"])
        payload = (h or "").encode()
        assert (g["payload_bytes"], g["payload_digest"], g["url"]) == (len(payload), hashlib.sha256(payload).hexdigest(), url or "")
        revisit = first.get(h, i) != i
        assert (g["record_type"], g["refers_to"]) == (("revisit", first[h]) if revisit else ("response", None))
        assert g["payload"] == (None if revisit else payload)
    one = warc.lookup(directory, spark.createDataFrame([("com,h3)/1",), ("nowhere)/",), (None,)], "key string")).collect()
    assert sorted(x["page_id"] for x in one) == sorted(i for i, u, _, _ in rows if u == "http://h3.com/1")
    assert warc.lookup(warc.archive(empty(pages)), keys).count() == 0
