"""Oracle SQL of the text functions, built from the same fixed values."""

from __future__ import annotations

from starlens import lexicon
from starlens.catalog.base import part, quote
from starlens.functions.text import DEFAULT_TOKEN_PATTERN

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def normalize(e: str) -> str:
    return f"trim(regexp_replace(coalesce({e}, ''), '{SPACE}', ' ', 'g'))"


def replace_all(e: str, pairs) -> str:
    for old, new in pairs:
        e = f"replace({e}, {quote(old)}, {quote(new)})"
    return e


def worded(e: str) -> str:
    return replace_all(normalize(e), lexicon.EMOJI_WORDS + lexicon.SLANG_WORDS)


def strip_emojis(e: str, new: str = " ") -> str:
    return f"regexp_replace({e}, '{lexicon.EMOJI_CLASS}', '{new}', 'g')"


def zero_digits(e: str) -> str:
    return rf"regexp_replace({e}, '\p{{Nd}}+', '0', 'g')"


def finish(e: str) -> str:
    return f"lower({normalize(e)})"


def extended(e: str) -> str:
    return finish(zero_digits(strip_emojis(worded(e))))


def collapse(list_column: str) -> str:
    """Drop every character equal to the two before it; works on a list column."""
    c = list_column
    return f"array_to_string(list_filter({c}, lambda x, i: i < 3 OR x <> {c}[i - 1] OR x <> {c}[i - 2]), '')"


def tokens(e: str) -> str:
    return f"regexp_extract_all({e}, {quote(DEFAULT_TOKEN_PATTERN)}, 0)"


def count_phrases(e: str) -> str:
    total = []
    for phrase in lexicon.NEGATION_PHRASES:
        total.append(f"(length({e}) - length(replace({e}, {quote(phrase)}, ''))) // {len(phrase)}")
        e = f"replace({e}, {quote(phrase)}, ' ')"
    return "CAST(" + " + ".join(total) + " AS INTEGER)"


part("standard", f"SELECT review_id, {extended('review_body')} AS text, stars AS user_rating, place_name, n_chars FROM reviews")
part(
    "clean",
    """
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY text ORDER BY review_id) AS rn
        FROM standard WHERE length(text) >= 5) WHERE rn = 1
    """,
)

# All strategies side by side; the character lists are columns of their own.
part("strategy_words", f"SELECT review_id, {normalize('review_body')} AS plain, {worded('review_body')} AS words FROM reviews")
part(
    "strategy_lists",
    f"""
    SELECT review_id, plain, words, string_split(plain, '') AS plain_chars,
           string_split({strip_emojis(f"regexp_replace(words, '{lexicon.URL_PATTERN}', ' ', 'g')")}, '') AS aggressive_chars,
           string_split({strip_emojis('plain', ' [EMO] ')}, '') AS tag_chars
    FROM strategy_words
    """,
)
part(
    "strategy_squeezed",
    f"""
    SELECT review_id, plain, words, {collapse('plain_chars')} AS squeezed,
           {collapse('aggressive_chars')} AS aggressive_squeezed, {collapse('tag_chars')} AS tag_squeezed
    FROM strategy_lists
    """,
)
_JOINED = rf"""regexp_replace(regexp_replace(aggressive_squeezed, '([!?])[!?]+', '\1', 'g'),
    '({"|".join(lexicon.NEGATION_JOIN_WORDS)})\s*([ก-ฮ]+)', '\1_\2', 'g')"""
part(
    "strategy_texts",
    f"""
    SELECT review_id,
           {finish(zero_digits(strip_emojis('words')))} AS extended,
           {finish(zero_digits('squeezed'))} AS "default",
           lower(plain) AS minimal,
           {finish(zero_digits(_JOINED))} AS aggressive,
           {finish('squeezed')} AS keep_digits,
           {finish(zero_digits('tag_squeezed'))} AS emoji_tag,
           {finish(f"array_to_string({tokens(zero_digits('squeezed'))}, ' ')")} AS segment
    FROM strategy_squeezed
    """,
)
