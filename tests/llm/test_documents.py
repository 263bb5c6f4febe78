"""Main text, tokens, packing, token files and toxicity."""

from __future__ import annotations

import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from posttide.llm import elias_fano, packing, token_files, tokens, toxicity
from posttide.llm.html_text import extract, main_text
from posttide.llm.tokens import Encoder

BYTES, WORDS = (public_tokenizers.path(f"{x}.json") for x in ("byte_bpe_50k", "word_bpe_49k"))

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head>
<body class="has-sidebar"><header><h2>Site name</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies, as every site does, to make it better for you.</p></div>
<div class="post"><h1>Fish &amp; chips</h1>
<p>First   paragraph, which is long enough, says a few things, and ends here.<br>Next line.</p>
<div class="ad"><p>Buy now, pay later, and get one more for free, today only.</p></div>
<p>Second paragraph &#8212; also long enough, with <b>bold</b> and <a href="x">a link</a>, and more.
<p>Third, unclosed, still counts as text of the article, doesn't it, dear reader?
<ul><li>An item of the list, which belongs to it</li></ul>
<form><input><button>Send</button> your mail address, please, here</form>
<section class="comments"><p>Reader says: this is wrong, all of it, and badly written, too.</p></section>
</div><aside><p>Related, other things to read, which are long, and not the article.</p></aside>
<!-- <p>hidden, long enough, but only a comment, so it does not count</p> -->
<footer>&copy; someone, somewhere, some time, all rights reserved, and so on</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE).split("\n") == [
        "Fish & chips",
        "First paragraph, which is long enough, says a few things, and ends here. Next line.",
        "Second paragraph — also long enough, with bold and a link, and more.",
        "Third, unclosed, still counts as text of the article, doesn't it, dear reader?",
        "An item of the list, which belongs to it",
    ]


def test_sections_of_one_article_stay_together():
    part = "<section><h2>Head {0}</h2><p>Paragraph {0}, of some length, with commas, and words.</p></section>"
    page = "<body><article>" + "".join(part.format(i) for i in range(5)) + "</article><p>Short</p></body>"
    assert main_text(page).count("\n") == 9


@pytest.mark.parametrize(
    "wrapper",
    [
        '<div class="content-sidebar-wrap">{}</div>', '<div class="layout has-sidebar"><main>{}</main></div>',
        '<article class="post no-comments">{}</article>', "<form runat=server>{}</form>",
        '<x-app class="no-menu"><div>{}</div></x-app>', '<div class="header-wrap">{}</div>',
    ],
)
def test_wrappers_with_noise_names_keep_the_article(wrapper):
    parts = [f"Paragraph {i} of the article, which is long enough, with commas." for i in range(4)]
    inside = "".join(f"<p>{x}</p>" for x in parts) + '<div class="comments"><p>A comment, which is not the article.</p></div>'
    page = f"<body><nav><p>A menu, with text that is long enough to score.</p></nav>{wrapper.format(inside)}</body>"
    assert main_text(page).split("\n") == parts


def test_names_formulas_tables_and_leads_of_an_article_stay():
    page = """<article><header><h1>T</h1><p>The lead paragraph, which is long, stands here.</p><div>By Someone</div></header>
    <p>As stated, <math><mi>E</mi><mo>=</mo><mi>mc</mi><annotation>E=mc</annotation></math> it is, and so on, yes.</p>
    <p class="related-work">Related work, which is long, is here too.</p><h2 id="social">Social effects</h2>
    <section id="notice-period"><p>The notice period, of two weeks, is given.</p></section>
    <table><tr><td><a href="x">A linked name</a></td><td>12</td></tr></table><ol><li><a href="y">The reference</a></li></ol>
    <div class="share-buttons">Send it on</div><section class="comments"><p>A reader, who has a comment, says so.</p></section></article>"""
    assert main_text(page).split("\n") == [
        "T", "The lead paragraph, which is long, stands here.", "As stated, E=mc it is, and so on, yes.",
        "Related work, which is long, is here too.", "Social effects", "The notice period, of two weeks, is given.",
        "A linked name", "12", "The reference",
    ]


@pytest.mark.parametrize(
    "part", ["<a", "<div>", '<p title="x', '<a "> "', "<b><i>x", "</b>", "<li>x<ul>", "<script></script", "<!--x", "<main>y"]
)
def test_time_grows_with_the_length_of_broken_pages(part):
    def seconds(n):
        start = time.process_time()
        main_text(part * n + '"')
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 16 * seconds(10_000) + 0.5


def test_segments_equal_brute_force_and_take_linear_time():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 30, 60):
        for _ in range(40):
            scores = rng.integers(-4, 4, n).astype(float)
            assert sorted(toxicity.segments(scores)) == sorted(maximal_segments(scores.tolist()))

    def seconds(n):
        scores = np.where(np.arange(n) % 2 == 0, 1.0, -1.5)
        start = time.process_time()
        toxicity.segments(scores)
        return time.process_time() - start

    seconds(1000)
    assert seconds(160_000) < 16 * seconds(40_000) + 0.2


def maximal_segments(scores, at=0):
    """The best segment (the shortest, then the first), and those left and right of it."""
    best = max(
        ((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)),
        default=(0, 0, 0),
    )
    if best[0] <= 0:
        return []
    i, j = -best[2], -best[2] - best[1]
    return [
        *maximal_segments(scores[:i], at), (at + i, at + j, best[0]), *maximal_segments(scores[j:], at + j),
    ]


def test_linked_blocks_of_the_article_stay():
    page = """<article><h2><a href="#s">Title</a></h2><p>First paragraph, long enough, with words, and commas.</p>
    <ul><li><a href="x">Linked item</a></li><li>A longer item, which has no link in it</li></ul>
    <table><tr><td><a href="y">Cell</a></td><td>Another cell, of plain text</td></tr></table>
    <blockquote><a href="z">Linked quote</a></blockquote><div><a href="w">Linked line</a></div>
    <ul><li><a href="1">One</a></li><li><a href="2">Two</a></li></ul></article>"""
    assert main_text(page).split("\n") == [
        "Title", "First paragraph, long enough, with words, and commas.", "Linked item",
        "A longer item, which has no link in it", "Cell", "Another cell, of plain text", "Linked quote", "Linked line",
    ]


@pytest.mark.parametrize("holder", ["main", "div"])
def test_siblings_of_the_article_stay(holder):
    parts = [f"Paragraph of part {i}, of some length, with commas, and words." for i in (1, 2)]
    articles = "".join(f"<article><p>{x}</p></article>" for x in parts)
    page = f"<{holder}><h1>Title</h1><p>An introduction, before the parts.</p>{articles}<p><a href='x'>More</a></p></{holder}>"
    assert main_text(page).split("\n") == ["Title", "An introduction, before the parts.", *parts]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<a b='", "</p></div>", "<!--", "&#xD800;&#0;&bad;", "<div>" * 500])
def test_broken_pages_do_not_fail(page):
    assert isinstance(main_text(page), str)


def test_long_page_is_kept_whole():
    page = "<article>" + "".join(f"<p>Paragraph number {i}, of many, is here.</p>" for i in range(5000)) + "</article>"
    assert main_text(page).count("\n") == 4999


def test_extract_keeps_rows_and_columns(spark):
    rows = [(1, "u", PAGE, "x", 5), (1, "u", PAGE, "x", 5), (2, None, None, None, 6), (None, "v", "plain", "y", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, score int")
    got = extract(pages)
    assert got.columns == ["page_id", "url", "score", "text", "n_chars"]
    out = {r.score: r for r in got.collect()}
    assert got.count() == 4 and out[6].text == "" and out[6].n_chars == 0 and out[7].text == "plain"
    assert out[5].n_chars == len(out[5].text)
    assert extract(pages.limit(0)).count() == 0


ODD = [
    "", " ", "a", "a  b", "a   b", " x", "x ", "x  ", "\n x", "a\n \nb", "it's  ", "a\tb \t c", "a \n b", "\n\n  x",
    "<|endoftext|> a b", "A<|endoftext|>B", "ÉCOLE é é Σας", "a. B's 12 345 007 100", "x" * 5000 + " y " * 30,
    "  a  b", "a\x1c b", "日本語 テスト", "a ́b", "tail\n", "one\ntwo\n\nthree", "0 00 0",
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_gives_the_tokenizers_ids(path):
    plain, fast = Tokenizer.from_file(path), Encoder(path)
    want = [np.asarray(plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in ODD]
    assert fast.ids(ODD) == want and fast.ids(ODD[::-1]) == want[::-1]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_forgotten_and_colliding_words_keep_their_ids(path, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_KEPT", 40)
    monkeypatch.setattr(tokens, "_TOGETHER", 300)
    rng = random.Random(3)
    signs = ["a", "bc", "D", " ", " ", " ", "  ", "\n", "0", "é", "e\u0301", "'s", ".", "\t", "\u00a0", "日", "x" * 70]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(3000)]
    ours, plain = Encoder(path), Tokenizer.from_file(path)
    want = [np.asarray(plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert ours.ids(texts) == want and ours.ids(texts[::-1]) == want[::-1]
    for text in ["x ", "x\n", " ", "\n"]:
        ids = np.asarray(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert Encoder(path).ids([text]) == ours.ids([text]) == [ids]
    memory = tokens._Memory()
    data, one, two = np.frombuffer(b" ab cd", np.uint8), np.array([0]), np.array([3])
    size, same = np.array([3]), np.array([7], np.uint64)
    memory.add(same, data, one, size, np.array([5, 6], np.uint32), np.array([2]))
    assert [x.tolist() for x in memory.find(same, data, one, size)] == [[0], [0], [2]]
    assert [x.tolist() for x in memory.find(same, data, two, size)] == [[], [], []]


def _packed(rows, length):
    spans, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for found in spans.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at and n > 0
            at += n
        assert at <= length
    return spans, pieces


def test_packing_places_every_piece(docs_of):
    texts = ["a b c", None, "", "long " * 700, "x", "mid " * 60, "long " * 200] + ["w " * (i % 40) for i in range(80)]
    docs = docs_of(list(enumerate(texts)), piece="x", owner="y")
    rows = packing.pack(docs, BYTES, 64).collect()
    spans, pieces = _packed(rows, 64)
    plain, total = Tokenizer.from_file(BYTES), 0
    for i, text in enumerate(texts):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for k, (piece, start, n, crc) in enumerate(sorted(pieces[i])):
            assert (piece, start) == (k, at) and (k == 0 or n == 64)
            assert crc == zlib.crc32(np.asarray(ids[at : at + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
    assert len(spans) <= 1.1 * total / 64 + 1
    assert packing.pack(docs_of([]), BYTES, 64).count() == 0


def test_sweeps_meet_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "EVENTS_PER_TASK", 20)
    rng = np.random.default_rng(3)
    sizes = [*rng.integers(1, 65, 300).tolist(), *[7] * 200]
    items = spark.createDataFrame(list(enumerate(sizes)), "ident long, size long")
    rows = packing.place(spark, items, 64).collect()
    assert sorted(r["ident"] for r in rows) == list(range(500))
    used = defaultdict(int)
    for r in rows:
        assert r["size"] == sizes[r["ident"]]
        used[r["owner"]] += r["size"]
    assert max(used.values()) <= 64 and len(used) <= 1.05 * sum(sizes) / 64 + 1


def test_tiny_items_take_few_rounds(spark):
    items = spark.range(3000).selectExpr("id AS ident", "1L + id % 3 AS size")
    placed = packing.place(spark, items, 2048)
    assert placed.count() == 3000 and placed.agg({"round": "max"}).first()[0] <= 4


@pytest.mark.parametrize(
    "values", [[], [5], [-7, -7, -7, 9], [0] * 1000, [-(2**63), 2**63 - 1], list(range(0, 30_000, 7))]
)
def test_elias_fano_round_trip(values):
    code = elias_fano.encode(np.array(values, np.int64))
    found = elias_fano.Decoder(b"pad" + code + b"rest", 3)
    assert found.size == len(code) and found.values().tolist() == values
    assert [found.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert 8 * len(elias_fano.encode(ends)) < 100_000 * (2 + 10.5)


def test_token_files_round_trip(spark, docs_of, tmp_path):
    texts = [(5, "five words"), (1, None), (None, "no id"), (3, "twice"), (3, "twice again"), (-2, "first " * 3000), (9, "")]
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write_tokens(docs_of(texts, start="x"), folder, WORDS)
    rows = token_files.read_tokens(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, -2, 1, 3, 3, 5, 9]
    plain, at = Tokenizer.from_file(WORDS), 0
    want = {(i, zlib.crc32(np.asarray([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in texts}
    assert {(r.doc_id, r.ids_crc32) for r in rows} == want
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    for m in manifest.collect():
        shard = token_files.Shard(folder, m["name"])
        ends = shard.ends.values()
        for i in range(m["n_docs"]):
            assert shard.document(i).tolist() == shard.span(ends[i - 1] if i else 0, ends[i]).tolist()
    empty = f"file://{tmp_path}/empty"
    token_files.write_tokens(docs_of([]), empty, WORDS)
    assert token_files.read_tokens(spark, empty).count() == 0


def _best_segment(scores):
    return max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(5)
    assert toxicity.segments(np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5.0])) == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]
    for _ in range(200):
        scores = rng.normal(-0.5, 2, rng.integers(1, 25))
        found = toxicity.segments(scores)
        best = _best_segment(scores.tolist())
        assert max((s for *_, s in found), default=0) == pytest.approx(max(best, 0))
        assert all(a < b <= c for (_, b, _), (c, *_) in zip(found, found[1:], strict=False) for a in [b - 1])
        for a, b, s in found:
            assert s == pytest.approx(scores[a:b].sum()) and s > 0


def _labelled(n):
    words = ["river", "stone", "cloud", "walks", "under", "green", "seven", "tables"]
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(n):
        text = rng.choice(words, 60).tolist()
        if i % 4 == 0:
            at = rng.integers(0, 50)
            text[at : at + 4] = rng.choice(["vilefoo", "vilebar", "nastybaz"], 4).tolist()
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


def test_toxic_documents_are_found(spark, docs_of):
    rows, labels = _labelled(300)
    extra = [(1000, None), (1001, ""), (None, "vilefoo vilebar vilefoo"), (1002, "vilenew nastyone vilemore " + "river " * 20)]
    docs = docs_of(rows + extra + rows[:3], toxic="x", score="y", n="z")
    table = spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    got = toxicity.score(docs, model)
    assert got.columns == [*[c for c in docs.columns if c != "toxic"], "toxic_score", "toxic", "passages"]
    out = [(r.doc_id, r.toxic, r.toxic_score, r.passages) for r in got.collect()]
    assert len(out) == len(rows) + 7 and all(0 <= s <= 1 for *_, s, _ in out)
    wrong = [i for i, toxic, *_ in out if i is not None and i < 300 and toxic != int(i % 4 == 0)]
    assert len(wrong) <= 3
    by = {i: (toxic, passages) for i, toxic, _, passages in out}
    assert by[1000] == by[1001] == (0, []) and by[1002][0] == 1 and len(by[1002][1]) == 1
    clean = toxicity.clean_documents(docs, table)
    assert clean.columns == docs.columns and clean.filter("doc_id % 4 = 0 AND doc_id < 300").count() <= 3
    none = toxicity.score(docs, toxicity.fit(docs, table.limit(0)))
    assert none.filter("toxic_score <> 0").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_labels_of_held_out_rows_are_never_read(spark, docs_of):
    rows, labels = _labelled(200)
    docs = docs_of(rows)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = {r.doc_id for r in docs.filter(toxicity.held_out()).collect()}
    assert held == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    lied = spark.createDataFrame([(i, q, 1 - t if i in held else t) for i, q, t in labels], told.schema)
    assert toxicity.fit(docs, told) == toxicity.fit(docs, lied)
