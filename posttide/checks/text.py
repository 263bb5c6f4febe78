"""Cleaning, tokens, markup, asset URLs, block pages, fetch triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from posttide import testviews as v
from posttide.checks.shape import finish
from posttide.functions import fetched, text as t

# The same patterns as the library, as DuckDB string literals.
_WS = (
    r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
_EMOJI = (
    r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}"
    r"\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}"
    r"\x{2700}-\x{27BF}]"
)
_PUNCT = t.PUNCTUATION.replace("'", "''")


def sql_collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[{_WS}]+', ' ', 'g'))"


def sql_clean(expr: str) -> str:
    """Cleaning in the order of its definition, one replacement per step."""
    e = f"coalesce({expr}, '')"
    e = rf"regexp_replace({e}, '(?i)https?://[^{_WS}]+|www\.[^{_WS}]+', ' ', 'g')"
    e = rf"regexp_replace({e}, '@[\p{{L}}\p{{N}}_]+', ' ', 'g')"
    e = rf"regexp_replace({e}, '#[\p{{L}}\p{{N}}_]+', ' ', 'g')"
    e = f"regexp_replace({e}, '{_EMOJI}', ' ', 'g')"
    e = f"translate({e}, '{_PUNCT}', '')"
    return sql_collapse(f"lower({e})")


def sql_words(cleaned: str) -> str:
    return f"list_filter(string_split({cleaned}, ' '), lambda w: w <> '')"


def sql_fold(expr: str) -> str:
    return f"replace(replace(lower({expr}), 'ß', 'ss'), 'ς', 'σ')"


def sql_key(expr: str) -> str:
    return sql_collapse(sql_fold(expr))


def sql_unescape(expr: str) -> str:
    """The entities that occur in the pages; ``&amp`` last, with or without its ``;``."""
    e = f"replace(replace(replace({expr}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·')"
    return f"regexp_replace({e}, '&amp;?', '&', 'g')"


def sql_feed_text(expr: str) -> str:
    return sql_collapse(f"regexp_replace({sql_unescape(expr)}, '<[^>]+>', ' ', 'g')")


def _clean(table: str, column: str, keys: tuple[str, ...]):
    def query(spark, sf_dir):
        rows = v.texts(spark, sf_dir, table, *keys, column)
        return rows.select(*keys, t.clean_text(F.col(column)).alias("cleaned_text"))

    return query


def _tokens(spark, sf_dir):
    docs = v.texts(spark, sf_dir, "documents", "doc_id", "text")
    tokens = t.tokenize(t.clean_text(F.col("text")))
    return docs.select("doc_id", F.array_join(tokens, "|").alias("tokens"))


def _token_counts(spark, sf_dir):
    """Corpus-wide word counts; equal words are summed per task before the shuffle."""
    docs = v.texts(spark, sf_dir, "documents", "doc_id", "text")
    words = docs.select(
        F.explode(t.whitespace_tokens(t.clean_text(F.col("text")))).alias("token")
    )
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _keys(spark, sf_dir):
    docs = v.texts(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", t.text_key(F.col("text")).alias("text_key"))


def _markup(spark, sf_dir):
    pages = v.texts(spark, sf_dir, "pages", "page_id", "url", "html")
    return pages.select("page_id", t.clean_feed_text(F.col("html")).alias("clean"))



def _assets(spark, sf_dir):
    pages = v.texts(spark, sf_dir, "pages", "page_id", "url", "html")
    found = fetched.distinct_matches(F.col("html"), 'href="[^"]+"')
    return pages.select("page_id", F.array_join(found, "|").alias("assets"))


def _operation(spark, sf_dir):
    """Ids named in a bundle text that is built from each page's own URL."""
    pages = v.texts(spark, sf_dir, "pages", "page_id", "url", "html")
    bundle = F.concat(
        F.lit('e={queryId:"'),
        F.sha1("url"),
        F.lit('",operationName:"SearchTimeline"};'),
        F.col("html"),
    )
    return pages.select(
        "page_id",
        fetched.operation_id(bundle, "SearchTimeline").alias("search_id"),
        fetched.operation_id(bundle, "OtherTimeline").alias("other_id"),
    )


def _blocked(spark, sf_dir):
    pages = v.texts(spark, sf_dir, "pages", "page_id", "url", "html")
    blocked = fetched.is_block_page(F.col("html"), "<ARTICLE>", ("Thereou", "the ", "queaux"))
    real = fetched.is_block_page(F.col("html"))
    return pages.select("page_id", blocked.alias("blocked"), real.alias("really_blocked"))


def _responses(events):
    status = (
        F.when(F.col("event_type") == "purchase", 402)
        .when(F.col("event_type") == "error", 404)
        .when(F.col("event_type") == "signup", 429)
        .when(F.col("event_type") == "view", 500)
        .otherwise(400)
    )
    user = F.col("user_id").cast("string")
    body = (
        F.when(
            F.col("event_type") == "purchase",
            F.concat(F.lit('{"title":"CreditsDepleted","detail":"user '), user, F.lit('"}')),
        )
        .when(
            F.col("event_type") == "error",
            F.concat(
                F.lit('{"errors":[{"detail":"d'), user,
                F.lit('"},{"message":"m"}],"title":"unused"}'),
            ),
        )
        .when(F.col("event_type") == "signup", F.lit('{"title":"","detail":"slow down"}'))
        .when(F.col("event_type") == "view", F.concat(F.lit("oops "), user))
        .otherwise(F.col("props"))
    )
    return events.select("event_id", status.alias("status"), body.alias("body"))


def _triage(spark, sf_dir):
    log = _responses(v.table(spark, sf_dir, "events"))
    return log.select(
        "event_id",
        fetched.api_error_message(F.col("status"), F.col("body")).alias("message"),
        fetched.is_final(F.col("status")).alias("api_final"),
        fetched.is_final(F.col("status"), fetched.FEED_FINAL_STATUSES).alias("feed_final"),
        fetched.is_search_blocked(F.concat(F.lit("SearchTimeline blocked (404) "), "body")).alias(
            "blocked"
        ),
    )


def _news_ids(spark, sf_dir):
    """Slug, id and merged text from page titles and URLs."""
    pages = v.texts(spark, sf_dir, "pages", "page_id", "url", "html")
    title = t.clean_feed_text(F.regexp_extract("html", "<title>(.*?)</title>", 1))
    host = F.regexp_extract("url", "https?://([^/]+)", 1)
    parts = pages.select("page_id", "url", title.alias("title"), host.alias("host"))
    return parts.select(
        "page_id",
        t.sha1_id(F.lit(""), F.col("url"), F.col("title")).alias("url_id"),
        t.sha1_id(F.lit(None).cast("string"), F.lit(""), F.col("title")).alias("title_id"),
        t.slug(F.col("host")).alias("username"),
        t.title_and_description(F.col("title"), F.upper("title")).alias("same"),
        t.title_and_description(F.col("title"), F.col("host")).alias("merged"),
    )


_CONTRACTIONS = t.contraction_pieces()


def _sql_split_word() -> str:
    cases = " ".join(
        f"WHEN w = '{word}' THEN ['{head}', '{tail}']"
        for word, (head, tail) in sorted(_CONTRACTIONS.items())
    )
    return f"CASE {cases} ELSE [w] END"


_RARE = (("fi", "ﬁ"), ("ss", "ß"), ("s", "ſ"), ("k", "\u212a"))


def _folded_letters(spark, sf_dir):
    """Keys of documents whose letters were replaced by ones that only full folding brings back."""
    docs = v.texts(spark, sf_dir, "documents", "doc_id", "text")
    odd = F.lower("text")
    for plain, rare in _RARE:
        odd = F.replace(odd, F.lit(plain), F.lit(rare))
    return docs.select("doc_id", t.text_key(odd).alias("key"))


def _tagged(spark, sf_dir):
    """Documents in which tags, mentions, emoji and links stand between and inside of words."""
    docs = v.texts(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    marked = F.concat(
        F.lit("#"), "source", F.lit(" "), F.regexp_replace("text", " ([aeiou])", " @$1 \U0001f600"),
        F.lit(" www.example.com/x #"), "lang", F.lit(", #é1 @"), "lang",
    )
    return docs.select("doc_id", t.clean_text(marked).alias("cleaned_text"))


QUERIES = {
    "folded_letters": _folded_letters,
    "clean_tagged": _tagged,
    "clean_text": _clean("documents", "text", ("doc_id",)),
    "clean_text_conversations": _clean("conversations", "text", ("conv_id", "turn")),
    "clean_text_pages": _clean("pages", "html", ("page_id",)),
    "tokenize": _tokens,
    "token_counts": _token_counts,
    "text_key": _keys,
    "news_clean": _markup,
    "news_ids": _news_ids,
    "page_assets": _assets,
    "operation_ids": _operation,
    "block_pages": _blocked,
    "response_triage": _triage,
}

_TITLE = sql_feed_text("regexp_extract(html, '<title>(.*?)</title>', 1)")

_TAGGED = (
    "'#' || source || ' ' || regexp_replace(text, ' ([aeiou])', ' @\\1 \U0001f600', 'g') "
    "|| ' www.example.com/x #' || lang || ', #é1 @' || lang"
)

SQL = {
    "folded_letters": f"SELECT doc_id, {sql_key('text')} AS key FROM documents",
    "clean_tagged": f"SELECT doc_id, {sql_clean(_TAGGED)} AS cleaned_text FROM documents",
    "clean_text": f"SELECT doc_id, {sql_clean('text')} AS cleaned_text FROM documents",
    "clean_text_conversations": f"""SELECT conv_id, turn, {sql_clean('text')} AS cleaned_text
      FROM conversations""",
    "clean_text_pages": f"SELECT page_id, {sql_clean('html')} AS cleaned_text FROM pages",
    "tokenize": f"""SELECT doc_id, array_to_string(flatten(list_transform(
      {sql_words(sql_clean('text'))}, lambda w: {_sql_split_word()})), '|') AS tokens FROM documents""",
    "token_counts": f"""SELECT token, count(*) AS n FROM (
      SELECT unnest({sql_words(sql_clean('text'))}) AS token FROM documents) GROUP BY token""",
    "text_key": f"SELECT doc_id, {sql_key('text')} AS text_key FROM documents",
    "news_clean": f"SELECT page_id, {sql_feed_text('html')} AS clean FROM pages",
    "news_ids": f"""WITH p AS (
        SELECT page_id, url, {_TITLE} AS title,
               regexp_extract(url, 'https?://([^/]+)', 1) AS host FROM pages)
      SELECT page_id, sha1(url) AS url_id, sha1(title) AS title_id,
             coalesce(nullif(trim(regexp_replace({sql_fold('host')}, '[^a-z0-9_]+', '_', 'g'), '_'),
                      ''), 'google_news') AS username,
             CASE WHEN upper(title) <> '' AND {sql_fold('upper(title)')} <> {sql_fold('title')}
                  THEN title || '. ' || upper(title) ELSE title END AS same,
             CASE WHEN host <> '' AND {sql_fold('host')} <> {sql_fold('title')}
                  THEN title || '. ' || host ELSE title END AS merged
      FROM p""",
    "page_assets": """SELECT page_id, array_to_string(list_transform(list_filter(
        list_transform(m, lambda x, i: {'x': x, 'first': list_position(m, x) = i}),
        lambda s: s.first), lambda s: s.x), '|') AS assets
      FROM (SELECT page_id, regexp_extract_all(html, 'href="[^"]+"') AS m FROM pages)""",
    "operation_ids": """SELECT page_id, sha1(url) AS search_id,
      CAST(NULL AS VARCHAR) AS other_id FROM pages""",
    "block_pages": """SELECT page_id,
        contains(lower(html), '<article>') AND (contains(lower(html), 'thereou')
          OR contains(lower(html), 'the ') OR contains(lower(html), 'queaux')) AS blocked,
        contains(lower(html), 'cloudflare') AND (contains(lower(html), 'attention required!')
          OR contains(lower(html), 'sorry, you have been blocked')
          OR contains(lower(html), 'please enable cookies')) AS really_blocked
      FROM pages""",
    "response_triage": """SELECT event_id,
        'X API request failed with HTTP ' || CASE event_type
          WHEN 'purchase' THEN '402: CreditsDepleted - user ' || user_id
          WHEN 'error' THEN '404: d' || user_id || '; m'
          WHEN 'signup' THEN '429: slow down'
          WHEN 'view' THEN '500: oops ' || user_id
          ELSE '400: ' || props END AS message,
        event_type IN ('purchase', 'error', 'click') AS api_final,
        event_type IN ('error', 'click') AS feed_final,
        true AS blocked
      FROM events""",
}
