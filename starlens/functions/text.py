"""Text normalisation, tokenisation and text features as Column expressions.

Everything here stays inside the JVM (no Python workers), so a whole strategy
is one projection over the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from starlens import lexicon

# Unicode white space plus the four separators U+001C..U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"
DIGITS = r"\p{Nd}+"


def normalize(text: Column) -> Column:
    """Null becomes empty, white space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def replace_words(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other in the order given.

    Characters below the lowest one of all words to be replaced are in none of
    them, whatever was replaced there before.  So texts are cut into stretches
    with and without such characters, and only the latter are searched.
    """
    listed = list(pairs)
    lowest = min((ord(c) for old, _ in listed for c in old), default=0)

    def replaced(piece: Column) -> Column:
        for old, new in listed:
            piece = F.replace(piece, F.lit(old), F.lit(new))
        return piece

    if lowest < 0x80:
        return replaced(text)
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x{{0}}-\x{{{lowest - 1:X}}}]+|[\x{{{lowest:X}}}-\x{{10FFFF}}]+"), F.lit(0))
    worded = F.transform(pieces, lambda piece: F.when(F.ascii(piece) < lowest, piece).otherwise(replaced(piece)))
    return F.array_join(worded, "")


def translate_emojis(text: Column) -> Column:
    return replace_words(text, lexicon.EMOJI_WORDS)


def translate_slang(text: Column) -> Column:
    return replace_words(text, lexicon.SLANG_WORDS)


def translate_both(text: Column) -> Column:
    """Emoji first, then slang, in the runs of both."""
    return replace_words(text, lexicon.EMOJI_WORDS + lexicon.SLANG_WORDS)


def strip_emojis(text: Column, replacement: str = " ") -> Column:
    return F.regexp_replace(text, lexicon.EMOJI_CLASS, replacement)


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, lexicon.URL_PATTERN, " ")


def collapse_repeats(text: Column) -> Column:
    """A run of three or more equal characters keeps two of them."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1$1")


def zero_digits(text: Column) -> Column:
    return F.regexp_replace(text, DIGITS, "0")


def first_punctuation(text: Column) -> Column:
    """A run of ``!`` and ``?`` keeps its first character."""
    return F.regexp_replace(text, r"([!?])[!?]+", "$1")


def join_negations(text: Column) -> Column:
    """A negation word is glued to the Thai consonants that follow it."""
    words = "|".join(lexicon.NEGATION_JOIN_WORDS)
    return F.regexp_replace(text, rf"({words})\s*([ก-ฮ]+)", "$1_$2")


def _finish(text: Column) -> Column:
    """Lower case for a text that was normalised before, in which blanks are the only white space."""
    return F.lower(F.trim(F.regexp_replace(text, " {2,}", " ")))


def extended(text: Column) -> Column:
    worded = translate_both(normalize(text))
    return _finish(zero_digits(strip_emojis(worded)))


def default(text: Column) -> Column:
    return _finish(zero_digits(collapse_repeats(normalize(text))))


def minimal(text: Column) -> Column:
    return F.lower(normalize(text))


def aggressive(text: Column) -> Column:
    worded = translate_both(normalize(text))
    plain = collapse_repeats(strip_emojis(strip_urls(worded)))
    return _finish(zero_digits(join_negations(first_punctuation(plain))))


def keep_digits(text: Column) -> Column:
    return _finish(collapse_repeats(normalize(text)))


def emoji_tag(text: Column) -> Column:
    tagged = strip_emojis(normalize(text), " [EMO] ")
    return _finish(zero_digits(collapse_repeats(tagged)))


def segment(text: Column, tokenizer: Callable[[Column], Column] | None = None) -> Column:
    squeezed = zero_digits(collapse_repeats(normalize(text)))
    return F.lower(normalize(F.array_join((tokenizer or tokens)(squeezed), " ")))


# Strategy name -> Column function.  ``extended`` is what the baseline family uses.
STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "extended": extended,
    "default": default,
    "minimal": minimal,
    "aggressive": aggressive,
    "keep_digits": keep_digits,
    "emoji_tag": emoji_tag,
    "segment": segment,
}


def register_strategy(name: str, function: Callable[[Column], Column]) -> None:
    """Plug in a user normaliser; wrap a Python function with ``pandas_udf`` first."""
    STRATEGIES[name] = function


def strategy(name: str | None) -> Callable[[Column], Column]:
    """An unknown name falls back to ``default``."""
    return STRATEGIES.get(name or "default", default)


def strategy_for_model(model: str, meta: dict | None = None, configured: str = "keep_digits") -> str:
    """The strategy stored at training time wins; otherwise it depends on the family."""
    stored = (meta or {}).get("preprocess_strategy")
    if stored:
        return stored
    return configured if model in ("embedding", "transformer") else "extended"


# --- tokens ------------------------------------------------------------------


def _default_words() -> tuple[str, ...]:
    words = {w for group in lexicon.ASPECT_KEYWORDS.values() for w in group}
    words.update(lexicon.NEGATION_PHRASES, lexicon.NEGATION_JOIN_WORDS)
    for _, new in lexicon.EMOJI_WORDS + lexicon.SLANG_WORDS:
        words.update(new.split())
    return tuple(words)


def token_pattern(words: Iterable[str] | None = None) -> str:
    """Longest lexicon word first, then word runs, numbers, Thai clusters, blanks, rest.

    Lexicon words are grouped by their first letter, so a position is tried
    against the few words that can start there.
    """
    ordered = sorted(words if words is not None else _default_words(), key=lambda w: (-len(w), w))
    groups: dict[str, list[str]] = {}
    for word in ordered:
        groups.setdefault(word[0], []).append(re.escape(word[1:]))
    by_letter = {first: f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in groups.items()}
    thai = [p for first, p in sorted(by_letter.items()) if "\u0e00" <= first <= "\u0e7f"]
    other = [p for first, p in sorted(by_letter.items()) if not "\u0e00" <= first <= "\u0e7f"]
    parts = [
        *other,
        r"[a-zA-Z\x{00C0}-\x{024F}]+",
        r"\p{Nd}+",
        r"\s+",
        *thai,
        r"[เ-ไ]?[ก-ฮ][ะ-ฺ็-๎]*",
        r"[^\s]",
    ]
    return "|".join(parts)


DEFAULT_TOKEN_PATTERN = token_pattern()


def tokens(text: Column, pattern: str = DEFAULT_TOKEN_PATTERN) -> Column:
    """All tokens in order, blanks included, so that joining them gives the text back."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def word_ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """All word n-grams, terms joined by one blank."""

    def of_length(n: int) -> Column:
        if n == 1:
            return words
        # A list shorter than n has no start.
        starts = F.slice(words, 1, F.greatest(F.size(words) - F.lit(n - 1), F.lit(0)))
        joined = F.transform(starts, lambda word, i: F.concat_ws(" ", word, *[F.get(words, i + k) for k in range(1, n)]))
        return F.coalesce(joined, F.array().cast("array<string>"))

    return F.concat(*[of_length(n) for n in range(low, high + 1)])


def char_ngrams(word: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of one word padded with a blank on both sides.

    A padded word no longer than n gives itself once and no longer grams.
    """

    def of(padded: Column) -> Column:
        size = F.length(padded)

        def of_length(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(size - F.lit(n - 1), F.lit(1)))
            grams = F.transform(starts, lambda i: F.substring(padded, i, n))
            return grams if n == low else F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))

        return F.concat(*[of_length(n) for n in range(low, high + 1)])

    # A lambda's variable is computed once, however often it is read.
    return F.transform(F.array(F.concat(F.lit(" "), word, F.lit(" "))), of)[0]


def blank_split(text: Column) -> Column:
    """Pieces between white space, empty ones dropped (the sentence rule)."""
    return F.filter(F.split(text, SPACE), lambda s: s != "")


# --- text features -----------------------------------------------------------


def count_phrases(text: Column, phrases: Iterable[str] = lexicon.NEGATION_PHRASES) -> Column:
    """Phrases are counted in order; each is blanked before the next is counted."""
    remaining = F.coalesce(text, F.lit(""))
    total = F.lit(0)
    for phrase in phrases:
        if not phrase:
            continue
        gone = F.length(remaining) - F.length(F.replace(remaining, F.lit(phrase), F.lit("")))
        total = total + (gone / F.lit(len(phrase))).cast("int")
        remaining = F.replace(remaining, F.lit(phrase), F.lit(" "))
    return total


def extra_features(text: Column, tokenizer: Callable[[Column], Column] = tokens) -> Column:
    """[characters, tokens, negations] as doubles."""
    return F.array(
        F.length(text).cast("double"),
        F.size(tokenizer(text)).cast("double"),
        count_phrases(text).cast("double"),
    )


def head_tail(words: Column, max_length: int) -> Column:
    """Keep the first and last tokens of a long list, two places being reserved."""
    room = max_length - 2
    head = room // 2
    tail = room - head
    cut = F.concat(F.slice(words, 1, head), F.slice(words, -tail, tail))
    return F.when(F.size(words) <= room, words).otherwise(cut)


def truncate(text: Column, max_chars: int | None) -> Column:
    """First characters of the text; zero or less means no cut."""
    if not max_chars or max_chars <= 0:
        return text
    return F.substring(text, 1, max_chars)


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))
