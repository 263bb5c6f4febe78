"""Text expressions. Only texts that built-in functions cannot treat right are handed to Python."""

from __future__ import annotations

import html
import re
import string
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white-space code points of Python's ``\s``, the punctuation
# and emoji ranges that cleaning removes.
WS_CHARS = (
    r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
EMOJI_CHARS = (
    r"\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}"
    r"\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}"
    r"\x{2700}-\x{27BF}"
)
PUNCTUATION = string.punctuation

# The leading range of an intersection turns most characters away in one or two
# comparisons, and that of a union takes most; they do not change the set.
WS = rf"[\x{{9}}-\x{{20}}\x{{85}}-\x{{3000}}&&[{WS_CHARS}]]"
NOT_WS = rf"[\x{{21}}-\x{{7E}}[^{WS_CHARS}]]"
WORD = r"[\p{L}\p{N}_]"
EMOJI = rf"[\x{{2700}}-\x{{1FAFF}}&&[{EMOJI_CHARS}]]"
URL = rf"(?i)https?://{NOT_WS}+|www\.{NOT_WS}+"
HANDLE = f"[@#]{WORD}+"
_PUNCTUATION_CLASS = "[" + "".join("\\" + char for char in PUNCTUATION) + "]+"


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one space; both ends are stripped."""
    return F.btrim(F.regexp_replace(c, f"{WS}+", " "))


_WS_LIST = "".join(
    char for char in map(chr, range(0x3001)) if re.fullmatch(r"\s", char)
)


def strip_ws(c: Column) -> Column:
    """Strip white space at both ends, keeping inner runs; only the ends are read."""
    return F.btrim(c, F.lit(_WS_LIST))


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, " ")


def strip_tags_and_emoji(c: Column) -> Column:
    """Mentions, hashtags and emoji in one pass: their matches cannot overlap."""
    return F.regexp_replace(c, f"{HANDLE}|{EMOJI}", " ")


def drop_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, _PUNCTUATION_CLASS, "")


def clean_text(c: Column) -> Column:
    """Cleaned text of a post; null becomes the empty string.

    URLs go first and on their own, because one may start inside a mention.
    """
    text = strip_tags_and_emoji(strip_urls(F.coalesce(c, F.lit(""))))
    return collapse_ws(F.lower(drop_punctuation(text)))


# English contractions as they look once apostrophes are gone.
_NT_STEMS = (
    "ca", "could", "do", "does", "did", "had", "may", "might", "must", "need", "ought",
    "sha", "should", "wo", "would", "is", "are", "was", "were", "have", "has", "dare",
)
_PRONOUN_TAILS = {
    "i": ("m", "ll", "d", "ve"),
    "you": ("ll", "d", "ve", "re"),
    "he": ("ll", "d", "s"),
    "she": ("ll", "d", "s"),
    "it": ("ll", "d", "s"),
    "we": ("ll", "d", "ve", "re"),
    "they": ("ll", "d", "ve", "re"),
}
_KEPT_WHOLE = ("ill", "its", "hell", "shell", "shed", "were", "well")
_OTHER_SPLITS = {"cannot": ("can", "not"), "gonna": ("gon", "na"), "gotta": ("got", "ta")}


def contraction_pieces() -> dict[str, tuple[str, str]]:
    """Word -> two pieces, for contractions written without an apostrophe."""
    pieces = {stem + "nt": (stem, "nt") for stem in _NT_STEMS}
    for pronoun, tails in _PRONOUN_TAILS.items():
        pieces.update({pronoun + tail: (pronoun, tail) for tail in tails})
    pieces.update(_OTHER_SPLITS)
    return {word: parts for word, parts in pieces.items() if word not in _KEPT_WHOLE}


def whitespace_tokens(cleaned: Column) -> Column:
    """Tokens of cleaned text: its space-separated words; ``''`` and null give ``[]``."""
    words = F.regexp_extract_all(cleaned, F.lit("[^ ]+"), F.lit(0))
    return F.coalesce(words, F.array().cast("array<string>"))


def _contraction_head() -> str:
    """Pattern of the first piece of a known contraction, where a word starts."""
    tails: dict[str, list[str]] = {}
    for head, tail in contraction_pieces().values():
        tails.setdefault(head, []).append(tail)
    heads: dict[tuple[str, ...], list[str]] = {}
    for head, ends in tails.items():
        heads.setdefault(tuple(sorted(ends)), []).append(head)
    forms = "|".join(
        f"(?:{'|'.join(sorted(group))})(?=(?:{'|'.join(ends)})(?: |$))"
        for ends, group in sorted(heads.items())
    )
    return f"(^| )(?!(?:{'|'.join(_KEPT_WHOLE)})(?: |$))({forms})"


_CONTRACTION_HEAD = _contraction_head()


def tokenize(cleaned: Column, split_contractions: bool = True) -> Column:
    """Words of cleaned text, with known contractions cut in two."""
    if split_contractions:
        cleaned = F.regexp_replace(cleaned, _CONTRACTION_HEAD, "$1$2 ")
    return whitespace_tokens(cleaned)


def _code_points(chosen) -> str:
    """A character class of the code points for which ``chosen`` holds."""
    ranges: list[list[int]] = []
    for code in range(0x80, 0x110000):
        if not 0xD800 <= code < 0xE000 and chosen(chr(code)):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    listed = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)
    return rf"[\x{{80}}-\x{{10FFFF}}&&[{listed}]]"


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


@cache
def _single_folds() -> tuple[str, str]:
    """Lower-cased letters that fold to another letter, and those letters."""
    pairs = {}
    for code in range(0x80, 0x110000):
        if not 0xD800 <= code < 0xE000:
            lower, folded = chr(code).lower(), chr(code).casefold()
            if lower != folded and len(lower) == len(folded) == 1:
                pairs[lower] = folded
    return "".join(pairs), "".join(pairs.values())


@cache
def _folds_to_more() -> str:
    """Letters that fold to several, but for sharp s."""
    return _code_points(lambda x: x not in "ßẞ" and x.casefold() != x.lower() and len(x.casefold()) > 1)


def casefold(c: Column) -> Column:
    """Full case folding.

    Text of ASCII letters alone is lower-cased. In other texts sharp s and the letters that fold to
    one other letter are replaced; only texts with ligatures and the like leave the JVM.
    """
    lower = F.lower(c)
    single = F.translate(F.replace(lower, F.lit("ß"), F.lit("ss")), *_single_folds())
    # Of the lower-cased text, as the optimizer takes ``lower(upper(x))`` for ``lower(x)``.
    ascii_only = F.octet_length(lower) == F.length(lower)
    other = ~ascii_only & c.rlike(_folds_to_more())
    return F.coalesce(_folded(F.when(other, c)), F.when(ascii_only, lower).otherwise(single))


def text_key(c: Column) -> Column:
    """Key under which copies of a labeled text are merged."""
    return collapse_ws(casefold(c))


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_unescape(c: Column) -> Column:
    """Resolve HTML entities; only rows holding ``&`` carry text to Python."""
    return F.coalesce(_unescape(F.when(F.contains(c, F.lit("&")), c)), c)


def strip_markup(c: Column) -> Column:
    """Drop ``<...>`` tags and collapse white space."""
    return collapse_ws(F.regexp_replace(c, "<[^>]+>", " "))


def clean_feed_text(c: Column) -> Column:
    """Feed text: entities first, then tags, then white space; null gives ``''``."""
    return strip_markup(html_unescape(F.coalesce(c, F.lit(""))))


def or_default(c: Column, default: Column | str) -> Column:
    """``c`` unless it is null or empty."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(c, F.lit("")), fallback)


def slug(c: Column, default: str = "google_news") -> Column:
    """Lower-case handle made of ``a-z0-9_``."""
    made = F.regexp_replace(casefold(c), "[^a-z0-9_]+", "_")
    return or_default(F.btrim(made, F.lit("_")), default)


def title_and_description(title: Column, description: Column) -> Column:
    """Title, followed by the description when that says something else."""
    differs = (description != "") & (casefold(description) != casefold(title))
    return F.when(differs, F.concat(title, F.lit(". "), description)).otherwise(title)


def sha1_id(guid: Column, link: Column, title: Column) -> Column:
    """Id of a feed item: SHA-1 of the first non-empty of guid, link and title."""
    return F.sha1(or_default(guid, or_default(link, title)))


def parse_rfc822(c: Column) -> Column:
    """Feed dates to timestamps; a date without a zone is UTC, a bad one is null."""
    text = F.regexp_replace(F.btrim(c), r"^[A-Za-z]{3},\s*", "")
    text = F.regexp_replace(text, r"\s+(?:UT|Z)$", " GMT")
    # A field the data lacks is tried next, from the fullest form to the barest.
    formats = (
        "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss",
        "d MMM yyyy HH:mm z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm",
    )
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def utc_text(c: Column) -> Column:
    """A timestamp as text, to the second; the session's time zone is UTC."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _plain(text: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x))


def _accent_tables() -> tuple[str, str]:
    """``translate`` arguments for letters whose plain form is one letter, and for marks."""
    plain_from, plain_to, dropped = [], [], []
    for code in range(0x80, 0x3000):
        char = chr(code)
        base = _plain(char)
        if not base and unicodedata.combining(char):
            dropped.append(char)
        elif len(base) == 1 and base != char:
            plain_from.append(char)
            plain_to.append(base)
    return "".join(plain_from + dropped), "".join(plain_to)


_ACCENTS_FROM, _ACCENTS_TO = _accent_tables()
_TRANSLATED = frozenset(_ACCENTS_FROM)


@cache
def _plain_otherwise() -> str:
    return _code_points(lambda x: x not in _TRANSLATED and _plain(x) != x)


@F.pandas_udf(T.StringType())
def _without_accents(texts: pd.Series) -> pd.Series:
    return texts.map(_plain, na_action="ignore")


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without its marks; only texts with letters that decompose into
    several, or that lie beyond U+3000, leave the JVM."""
    otherwise = _without_accents(F.when(c.rlike(_plain_otherwise()), c))
    ascii_only = F.octet_length(c) == F.length(c)
    return F.coalesce(otherwise, F.when(ascii_only, c).otherwise(F.translate(c, _ACCENTS_FROM, _ACCENTS_TO)))
