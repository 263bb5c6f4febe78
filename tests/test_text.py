from __future__ import annotations

import html
import random
import re
import string

import unicodedata

import pytest
from pyspark.sql import functions as F

from posttide.functions import fetched, labels, text as t


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([tuple(values.values())], schema)
    return df.select(column.alias("x")).first()["x"]


def test_clean_text_example(spark):
    noisy = "Hello, @alice! Visit https://example.com #AI 😀 for MORE   updates..."
    assert one(spark, t.clean_text(F.col("c")), c=noisy) == "hello visit for more updates"


@pytest.mark.parametrize(
    ("raw", "cleaned"),
    [
        (None, ""),
        ("", ""),
        ("don't a-b c_d", "dont ab cd"),
        ("@www.foo.com x", "x"),
        ("HTTP://A.b/c?d=1 tail", "tail"),
        ("🇩🇪 ☀ ✂ end", "🇩🇪 ☀ end"),
        ("a  b\x1cc", "a b c"),
        ("#été@x", ""),
    ],
)
def test_clean_text_edges(spark, raw, cleaned):
    assert one(spark, t.clean_text(F.col("c")), c=raw) == cleaned


def test_clean_text_agrees_with_step_by_step_python(spark):
    rng = random.Random(7)
    alphabet = "ab é@#_. /:-' \n😀✂🇩w" + string.punctuation
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [f"{x}https://a.b/{x} www.{x}" for x in texts[:100]]
    emoji = re.compile(
        "[\U0001f300-\U0001f5ff\U0001f600-\U0001f64f\U0001f680-\U0001faff✀-➿]"
    )

    def expected(value):
        value = re.sub(r"https?://\S+|www\.\S+", " ", value, flags=re.IGNORECASE)
        value = re.sub(r"[@#]\w+", " ", value)
        value = "".join(c for c in emoji.sub(" ", value) if c not in string.punctuation)
        return " ".join(value.lower().split())

    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    rows = df.select("i", t.clean_text(F.col("c")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in rows} == {i: expected(c) for i, c in enumerate(texts)}


@pytest.mark.parametrize(
    ("cleaned", "tokens"),
    [
        ("hello data world", ["hello", "data", "world"]),
        (None, []),
        ("", []),
        ("i dont cant its well", ["i", "do", "nt", "ca", "nt", "its", "well"]),
        ("theyre im ill xdont dontx", ["they", "re", "i", "m", "ill", "xdont", "dontx"]),
    ],
)
def test_tokenize(spark, cleaned, tokens):
    assert one(spark, t.tokenize(F.col("c")), c=cleaned) == tokens


def test_unescape_is_exact(spark):
    values = ["&lt;b&gt;x&lt;/b&gt;", "a &ampb; &am &#8364;&#x41; &notit;", "no entity", "&nbsp;"]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    got = [r["x"] for r in df.select(t.html_unescape(F.col("c")).alias("x")).collect()]
    assert got == [html.unescape(v) for v in values]
    assert one(spark, t.clean_feed_text(F.col("c")), c=values[0]) == "x"


@pytest.mark.parametrize(
    ("text", "iso"),
    [
        ("Wed, 06 May 2026 03:49:16 GMT", "2026-05-06 03:49:16"),
        ("Wed, 06 May 2026 03:49:16 -0500", "2026-05-06 08:49:16"),
        ("06 May 2026 03:49:16", "2026-05-06 03:49:16"),
        ("6 May 2026 03:49 UT", "2026-05-06 03:49:00"),
        ("yesterday", None),
    ],
)
def test_rfc822(spark, text, iso):
    got = one(spark, t.parse_rfc822(F.col("c")).cast("string"), c=text)
    assert got == iso


def test_slug_id_and_merge(spark):
    assert one(spark, t.slug(F.col("c")), c="The Daily-News!") == "the_daily_news"
    assert one(spark, t.slug(F.col("c")), c="???") == "google_news"
    merged = t.title_and_description(F.col("a"), F.col("b"))
    assert one(spark, merged, a="Same", b="SAME") == "Same"
    assert one(spark, merged, a="Title", b="more") == "Title. more"
    ids = [one(spark, t.sha1_id(F.col("a"), F.col("b"), F.lit("t")), a="", b=b) for b in ("l", "")]
    assert ids[0] != ids[1]


def test_accents(spark):
    assert one(spark, t.strip_accents(F.col("c")), c="Éàü ñ ß é") == "Eau n ß e"


def test_accents_of_every_kind(spark):
    for text in ("ﬁn ĳ Ǆ", "한국어 é", "㍿ ½ ｱﾞ", "𝒜 豈", "plain", ""):
        plain = unicodedata.normalize("NFKD", text)
        plain = "".join(x for x in plain if not unicodedata.combining(x))
        assert one(spark, t.strip_accents(F.col("c")), c=text) == plain
    assert one(spark, t.strip_accents(F.nullif(F.col("c"), F.col("c"))), c="x") is None


def test_casefold(spark):
    for text in ("Straße ΣΊΣΥΦΟΣ", "ŉ ǰ ΐ ﬃ ẞ ſ", "İstanbul Ꭰ", "ABC déf", ""):
        assert one(spark, t.casefold(F.col("c")), c=text) == text.casefold()
    assert one(spark, t.casefold(F.upper(F.col("c"))), c="enheitß") == "enheitss"


def test_labels_and_weights(spark):
    assert one(spark, labels.canonical_label(F.col("c")), c=" Pos\n") == "positive"
    assert one(spark, labels.canonical_label(F.col("c")), c="mixed") is None

    def weight(label, confidence, score):
        column = labels.sample_weight(F.col("l"), F.col("c"), F.col("s"))
        return one(spark, column, l=label, c=confidence, s=score)

    assert weight("positive", None, "bad") == pytest.approx(0.70125)
    assert weight("neutral", "nan", None) == pytest.approx(0.541875)
    assert weight("positive", "0.8", "0.7") == pytest.approx(1.3552)
    assert weight("negative", "0.9", "-0.8") == pytest.approx(1.53065)


@pytest.mark.parametrize(
    ("compound", "label"),
    [(0.05, "positive"), (-0.05, "negative"), (0.0499, "neutral"), (0.0, "neutral")],
)
def test_compound_label_bounds(spark, compound, label):
    assert spark.range(1).select(labels.compound_label(F.lit(compound))).first()[0] == label


def test_assets_and_operation(spark):
    base = "https://abs.twimg.com/responsive-web/client-web/"
    page = "".join(f'<link href="{base}{n}.js" />' for n in ("vendor.abc123", "main.def456", "main.def456"))
    found = one(spark, fetched.distinct_matches(F.col("c")), c=page)
    assert found == [f"{base}vendor.abc123.js", f"{base}main.def456.js"]
    bundle = 'e={queryId:"xrS3h-srT2mQT-g3lKsUjA",operationName:"SearchTimeline",x:1}'
    assert one(spark, fetched.operation_id(F.col("c"), "SearchTimeline"), c=bundle) == (
        "xrS3h-srT2mQT-g3lKsUjA"
    )
    assert one(spark, fetched.operation_id(F.col("c"), "Other"), c=bundle) is None


def test_block_page_and_triage(spark):
    page = "<title>Attention Required! | Cloudflare</title>"
    assert one(spark, fetched.is_block_page(F.col("c")), c=page) is True
    assert one(spark, fetched.is_block_page(F.col("c")), c="cloudflare") is False
    body = '{"title":"CreditsDepleted","detail":"Account has no credits left."}'
    message = fetched.api_error_message(F.lit(402), F.col("c"))
    assert one(spark, message, c=body) == (
        "X API request failed with HTTP 402: CreditsDepleted - Account has no credits left."
    )
    assert one(spark, message, c="plain").endswith("402: plain")
    assert one(spark, fetched.is_final(F.lit(402)), c="x") is True
    blocked = "4 requests to .../SearchTimeline failed, giving up."
    assert one(spark, fetched.is_search_blocked(F.col("c")), c=blocked) is True
