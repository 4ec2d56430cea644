"""Queries on text: strategies, tokens, n-grams, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens import lexicon
from starlens.catalog import sqltext as Q
from starlens.catalog.base import part, query, reviews, table
from starlens.functions import text as T
from starlens.operators import clean
from starlens.operators.once import compute_once


def standard(spark, folder):
    """Extended-normalised reviews."""
    texts = compute_once(reviews(spark, folder), "text", T.extended(F.col("review_body")))
    return texts.select("review_id", "text", F.col("stars").alias("user_rating"), "place_name", "n_chars")


def cleaned(spark, folder):
    return clean.clean_reviews(standard(spark, folder))


@query("f01_normalize", f"SELECT review_id, {Q.normalize('review_body')} AS text FROM reviews")
def f01(spark, folder):
    return reviews(spark, folder).select("review_id", T.normalize(F.col("review_body")).alias("text"))


@query(
    "f02_f03_translate",
    f"""SELECT review_id, {Q.replace_all('review_body', lexicon.EMOJI_WORDS)} AS emoji_text,
               {Q.replace_all('review_body', lexicon.SLANG_WORDS)} AS slang_text FROM reviews""",
)
def f02(spark, folder):
    body = F.col("review_body")
    return reviews(spark, folder).select(
        "review_id", T.translate_emojis(body).alias("emoji_text"), T.translate_slang(body).alias("slang_text")
    )


@query("f04_extended", f"SELECT review_id, {Q.extended('review_body')} AS text FROM reviews")
def f04(spark, folder):
    return standard(spark, folder).select("review_id", "text")


@query(
    "f05_f09_strategies",
    """SELECT review_id, "default" AS default_text, minimal AS minimal_text, aggressive AS aggressive_text,
              keep_digits AS keep_digits_text, emoji_tag AS emoji_tag_text FROM strategy_texts""",
)
def f05(spark, folder):
    body = F.col("review_body")
    names = ("default", "minimal", "aggressive", "keep_digits", "emoji_tag")
    return reviews(spark, folder).select("review_id", *[T.strategy(n)(body).alias(f"{n}_text") for n in names])


@query("f10_segment", "SELECT review_id, segment AS text FROM strategy_texts")
def f10(spark, folder):
    return reviews(spark, folder).select("review_id", T.segment(F.col("review_body")).alias("text"))


@query(
    "f11_strategy_of_model",
    """
    SELECT r.review_id, m.model, m.strategy,
           CASE m.strategy WHEN 'extended' THEN s.extended WHEN 'keep_digits' THEN s.keep_digits
                           WHEN 'default' THEN s."default" ELSE s.minimal END AS text
    FROM reviews r JOIN strategy_texts s USING (review_id)
    CROSS JOIN (VALUES ('baseline', 'extended'), ('embedding', 'keep_digits'),
                       ('transformer', 'minimal'), ('other', 'extended')) AS m(model, strategy)
    """,
)
def f11(spark, folder):
    metas = {"baseline": {}, "embedding": {}, "transformer": {"preprocess_strategy": "minimal"}, "other": {}}
    body = F.col("review_body")
    rows = []
    for model, meta in metas.items():
        name = T.strategy_for_model(model, meta)
        rows.append(
            F.struct(F.lit(model).alias("model"), F.lit(name).alias("strategy"), T.strategy(name)(body).alias("text"))
        )
    return reviews(spark, folder).select("review_id", F.explode(F.array(*rows)).alias("r")).select("review_id", "r.*")


part("review_tokens", f"SELECT review_id, user_rating, text, {Q.tokens('text')} AS words FROM standard")


@query("f12_tokens", "SELECT review_id, len(words) AS n_tokens, array_to_string(words, '|') AS tokens FROM review_tokens")
def f12(spark, folder):
    words = compute_once(standard(spark, folder), "words", T.tokens(F.col("text")))
    return words.select(
        "review_id", F.size("words").cast("long").alias("n_tokens"), F.array_join("words", "|").alias("tokens")
    )


@query(
    "f13_word_ngrams",
    """SELECT review_id, array_to_string(list_concat(words,
              list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])), '|') AS grams
       FROM review_tokens""",
)
def f13(spark, folder):
    words = compute_once(standard(spark, folder), "words", T.tokens(F.col("text")))
    return words.select("review_id", F.array_join(T.word_ngrams(F.col("words"), 1, 2), "|").alias("grams"))


part(
    "char_grams",
    """
    SELECT review_id, word, substring(word, i, n) AS term FROM (
        SELECT review_id, word, n, unnest(range(1, length(word) - n + 2)) AS i FROM (
            SELECT review_id, word, unnest(range(3, least(5, length(word)) + 1)) AS n FROM (
                SELECT review_id, ' ' || w || ' ' AS word FROM (
                    SELECT review_id, unnest(string_split(text, ' ')) AS w FROM standard) WHERE w <> '')))
    """,
)


@query(
    "f14_char_ngrams",
    "SELECT review_id, count(*) AS grams, count(DISTINCT term) AS distinct_grams, max(term) AS last_gram FROM char_grams GROUP BY review_id",
)
def f14(spark, folder):
    from starlens.operators import vectorise as V

    counts = V.term_counts(V.char_terms(V.by_document(standard(spark, folder)), nested=True))
    return counts.select(
        "review_id", F.aggregate("_terms.tf", F.lit(0).cast("long"), lambda total, n: total + n).alias("grams"),
        F.size("_terms").cast("long").alias("distinct_grams"), F.array_max("_terms.term").alias("last_gram"),
    )


@query(
    "f15_sentences",
    "SELECT review_id, len(list_filter(string_split(text, ' '), lambda s: s <> '')) AS sentences FROM standard",
)
def f15(spark, folder):
    return standard(spark, folder).select(
        "review_id", F.size(T.blank_split(F.col("text"))).cast("long").alias("sentences")
    )


@query(
    "f16_f17_extra_features",
    f"""SELECT review_id, length(text) AS char_len, len(words) AS word_count,
               {Q.count_phrases('text')} AS negation_count FROM review_tokens""",
)
def f16(spark, folder):
    text = F.col("text")
    return standard(spark, folder).select(
        "review_id",
        F.length(text).cast("long").alias("char_len"),
        F.size(T.tokens(text)).cast("long").alias("word_count"),
        T.count_phrases(text).alias("negation_count"),
    )


@query(
    "f18_head_tail",
    """SELECT review_id, array_to_string(CASE WHEN len(words) <= 126 THEN words
              ELSE list_concat(words[1:63], words[-63:]) END, '') AS text FROM review_tokens""",
)
def f18(spark, folder):
    words = compute_once(standard(spark, folder), "words", T.tokens(F.col("text")))
    return words.select("review_id", F.array_join(T.head_tail(F.col("words"), 128), "").alias("text"))


@query("p06_truncate", "SELECT review_id, substring(text, 1, 500) AS text FROM standard")
def p06(spark, folder):
    return standard(spark, folder).select("review_id", T.truncate(F.col("text"), 500).alias("text"))


part("page_texts", "SELECT page_id, html FROM pages")


@query(
    "f07_strip_urls",
    f"SELECT page_id, regexp_replace({Q.normalize('html')}, '{lexicon.URL_PATTERN}', ' ', 'g') AS text FROM page_texts",
)
def f07_urls(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.strip_urls(T.normalize(F.col("html"))).alias("text"))
