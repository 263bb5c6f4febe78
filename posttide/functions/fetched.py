"""Expressions over fetched documents: block pages, asset URLs, response triage."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker and phrases of a block page, the asset URL pattern,
# and the statuses after which a fetch is not repeated.
BLOCK_MARKER = "cloudflare"
BLOCK_PHRASES = (
    "attention required!",
    "sorry, you have been blocked",
    "please enable cookies",
)
ASSET_URL = r"https://abs\.twimg\.com/responsive-web/client-web/[^\"']+\.js"
API_FINAL_STATUSES = (400, 401, 402, 403, 404)
FEED_FINAL_STATUSES = (400, 401, 403, 404)


def is_block_page(
    body: Column, marker: str = BLOCK_MARKER, phrases: tuple[str, ...] = BLOCK_PHRASES
) -> Column:
    """True when the page names ``marker`` and holds one of ``phrases``, in any case."""
    text = F.lower(body)
    any_phrase = F.lit(False)
    for phrase in phrases:
        any_phrase = any_phrase | F.contains(text, F.lit(phrase.lower()))
    return F.contains(text, F.lit(marker.lower())) & any_phrase


def distinct_matches(body: Column, pattern: str = ASSET_URL) -> Column:
    """All matches of ``pattern``, each once, in the order first seen."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))


def operation_id(bundle: Column, operation: str) -> Column:
    """Query id that a script bundle gives for ``operation``; null when absent."""
    pattern = f'queryId:"([^"]+)",operationName:"{re.escape(operation)}"'
    return F.nullif(F.regexp_extract(bundle, pattern, 1), F.lit(""))


def response_detail(body: Column) -> Column:
    """What an error body says: its errors, else title and detail, else the body."""
    parsed = F.from_json(
        body,
        "title string, detail string, errors array<string>",
    )
    error = F.transform(
        parsed["errors"],
        lambda e: F.coalesce(
            F.nullif(F.get_json_object(e, "$.detail"), F.lit("")),
            F.nullif(F.get_json_object(e, "$.message"), F.lit("")),
            e,
        ),
    )
    headline = F.concat_ws(
        " - ",
        F.nullif(parsed["title"], F.lit("")),
        F.nullif(parsed["detail"], F.lit("")),
    )
    return F.when(F.size(error) > 0, F.array_join(error, "; ")).otherwise(
        F.coalesce(F.nullif(headline, F.lit("")), body)
    )


def api_error_message(status: Column, body: Column) -> Column:
    prefix = F.concat(F.lit("X API request failed with HTTP "), status.cast("string"))
    return F.concat(prefix, F.lit(": "), response_detail(body))


def is_final(status: Column, statuses: tuple[int, ...] = API_FINAL_STATUSES) -> Column:
    """True when a fetch with this status must not be repeated."""
    return status.isin(*statuses)


def is_search_blocked(error: Column) -> Column:
    """True for the error an unauthenticated search gets when it is blocked."""
    return F.contains(error, F.lit("SearchTimeline")) & (
        F.contains(error, F.lit("blocked (404)"))
        | F.contains(error, F.lit("failed, giving up"))
    )
