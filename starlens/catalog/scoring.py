"""Queries on features, scoring, aspects and venues."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens import lexicon
from starlens.catalog import sqltext as Q
from starlens.catalog.base import part, query, quote, rated, reviews, table
from starlens.catalog.text import cleaned, standard
from starlens.functions.hashing import hash_int
from starlens.operators import aspects, cache, linear, ranking, vectorise, venues
from starlens.params import Params
from starlens.plans.score import LinearModel, flag, score_reviews
from starlens.plans.venue_cache import venue_cache, venue_reviews
from starlens.session import stage

DEFAULTS = Params()
MAX_WORDS, MAX_GRAMS = DEFAULTS.word_max_features, DEFAULTS.char_max_features
INTERCEPTS = (-0.2, -0.1, 0.0, 0.1, 0.2)


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


part(
    "word_terms",
    f"""SELECT review_id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS term
        FROM (SELECT review_id, {Q.tokens(Q.extended('text'))} AS words FROM standard)""",
)
part("word_tf", "SELECT review_id, term, count(*) AS tf FROM word_terms GROUP BY ALL")
part("word_totals", "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM word_tf GROUP BY term")
part(
    "word_vocab",
    f"""SELECT term, df, ctf, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT *, (SELECT count(*) FROM standard) AS n FROM word_totals)
        WHERE df >= 2 AND df <= 0.9e0 * n ORDER BY ctf DESC, encode(term) LIMIT {MAX_WORDS}""",
)
part("char_tf", "SELECT review_id, term, count(*) AS tf FROM char_grams GROUP BY ALL")
part("char_totals", "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM char_tf GROUP BY term")
part(
    "char_vocab",
    f"""SELECT term, df, ctf, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT *, (SELECT count(*) FROM standard) AS n FROM char_totals)
        WHERE df >= 2 AND df <= 0.9e0 * n ORDER BY ctf DESC, encode(term) LIMIT {MAX_GRAMS}""",
)


def _weigh_sql(counts: str, vocab: str, keys: str = "review_id") -> str:
    return f"""SELECT {keys}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {keys})) AS weight FROM (
                 SELECT c.*, c.tf * v.idf AS raw FROM {counts} c JOIN {vocab} v USING (term))"""


part("word_weights", _weigh_sql("word_tf", "word_vocab"))
part("char_weights", _weigh_sql("char_tf", "char_vocab"))


def docs(spark, folder):
    return vectorise.by_document(standard(spark, folder))


def word_vocab(spark, folder, totals=None):
    totals = vectorise.word_totals(docs(spark, folder)) if totals is None else totals
    return vectorise.vocabulary_of(totals, ranking.count_of(reviews(spark, folder)), MAX_WORDS)


@query("a25_term_totals", "SELECT * FROM word_totals WHERE df >= 2 AND df <= 0.9e0 * (SELECT count(*) FROM standard)")
def a25(spark, folder):
    return vectorise.prune(vectorise.word_totals(docs(spark, folder)), ranking.count_of(reviews(spark, folder)))


@query("w06_vocabulary", "SELECT term, df, ctf, round(idf, 6) AS idf FROM word_vocab")
def w06(spark, folder):
    return r6(word_vocab(spark, folder), "idf")


@query("m01_j05_word_tfidf", "SELECT review_id, term, round(weight, 6) AS weight FROM word_weights")
def m01(spark, folder):
    # Tokenised once; the vocabulary and the weights read the stored lists.
    lists = vectorise.by_document(stage(vectorise.word_lists(standard(spark, folder))))
    vocab = word_vocab(spark, folder, vectorise.totals_of_lists(lists))
    return r6(vectorise.weigh(vectorise.terms_of_lists(lists), vocab), "weight")


@query("m02_char_tfidf", "SELECT review_id, term, round(weight, 6) AS weight FROM char_weights")
def m02(spark, folder):
    texts = vectorise.by_document(stage(standard(spark, folder).select("review_id", "text")))
    terms = vectorise.char_terms(texts, nested=True)
    vocab = vectorise.vocabulary_of(vectorise.char_totals(texts), ranking.count_of(reviews(spark, folder)), MAX_GRAMS)
    return r6(vectorise.weigh(terms, vocab), "weight")


# --- a stored linear model: coefficients in hundredths, drawn from the term ----


def coefficients(vocab):
    draws = [((hash_int(f"coef{k}", F.col("term")) % 401 - 200) / F.lit(100.0)) for k in lexicon.STARS]
    return vocab.select("term", F.array(*draws).alias("coef"))


def model(spark, folder, totals=None):
    # Fitted once; the scoring passes read the stored artefact (at most MAX_WORDS rows).
    vocab = stage(word_vocab(spark, folder, totals).coalesce(1))
    return LinearModel(vocab, coefficients(vocab), INTERCEPTS)


part(
    "coefs",
    "SELECT term, "
    + ", ".join(
        f"(CAST('0x' || substr(md5('coef{k}:' || term), 1, 15) AS BIGINT) % 401 - 200) / 100e0 AS k{k}" for k in lexicon.STARS
    )
    + " FROM word_vocab",
)


def _logit_parts(name: str, weights: str, docs_from: str, keys: str) -> None:
    """Parts <name>_rated (keys, expected) from a weight part and all documents."""
    sums = ", ".join(f"sum(w.weight * c.k{k}) AS s{k}" for k in lexicon.STARS)
    part(f"{name}_sums", f"SELECT {keys}, {sums} FROM {weights} w JOIN coefs c USING (term) GROUP BY {keys}")
    values = ", ".join(f"coalesce(s{k}, 0) + ({b}e0) AS z{k}" for k, b in zip(lexicon.STARS, INTERCEPTS, strict=True))
    part(f"{name}_logits", f"SELECT d.*, {values} FROM {docs_from} d LEFT JOIN {name}_sums USING ({keys})")
    exps = ", ".join(f"exp(z{k} - greatest(z1, z2, z3, z4, z5)) AS e{k}" for k in lexicon.STARS)
    part(f"{name}_exps", f"SELECT *, {exps} FROM {name}_logits")
    top = " + ".join(f"{k} * e{k}" for k in lexicon.STARS)
    part(
        f"{name}_rated",
        f"SELECT * EXCLUDE (z1, z2, z3, z4, z5), ({top}) / (e1 + e2 + e3 + e4 + e5) AS expected FROM {name}_exps",
    )


_logit_parts("doc", "word_weights", "standard", "review_id")


@query(
    "m14_linear_scorer",
    "SELECT review_id, round(expected, 6) AS ai_expected_rating, round(e5 / (e1 + e2 + e3 + e4 + e5), 6) AS p5 FROM doc_rated",
)
def m14(spark, folder):
    # Normalised once; the vocabulary and the weights read the stored texts.
    texts = vectorise.by_document(stage(standard(spark, folder).select("review_id", "text")))
    m = model(spark, folder, vectorise.word_totals(texts))
    weighted = vectorise.weigh(vectorise.word_terms(texts, nested=True), m.vocabulary)
    out = linear.predict(texts, weighted, m.coefficients, m.intercepts)
    return r6(out.select("review_id", "ai_expected_rating", F.col("probs")[4].alias("p5")), "ai_expected_rating", "p5")


# --- aspects -------------------------------------------------------------------

_HITS = " UNION ALL ".join(
    "SELECT '{a}' AS aspect, unnest([{ws}]) AS word".format(a=a, ws=", ".join(quote(w) for w in words))
    for a, words in lexicon.ASPECT_KEYWORDS.items()
)
part("aspect_words", _HITS)
part(
    "sentences",
    """SELECT review_id, CAST(place - 1 AS INTEGER) AS place, sentence FROM (
         SELECT review_id, unnest(l) AS sentence, unnest(range(1, len(l) + 1)) AS place FROM (
           SELECT review_id, list_filter(string_split(text, ' '), lambda s: s <> '') AS l FROM {source}))""".replace(
        "{source}", "clean"
    ),
)
part(
    "aspect_hits",
    "SELECT DISTINCT review_id, place, sentence, aspect FROM sentences JOIN aspect_words ON contains(sentence, word)",
)


@query("f15_j03_aspect_sentences", "SELECT * FROM aspect_hits")
def j03(spark, folder):
    return aspects.aspect_sentences(cleaned(spark, folder))


part(
    "sent_terms",
    f"""SELECT review_id, place, aspect, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS term
        FROM (SELECT review_id, place, aspect, {Q.tokens(Q.extended('sentence'))} AS words FROM aspect_hits)""",
)
part("sent_tf", "SELECT review_id, place, aspect, term, count(*) AS tf FROM sent_terms GROUP BY ALL")
part("sent_weights", _weigh_sql("sent_tf", "word_vocab", "review_id, place, aspect"))
_logit_parts("sent", "sent_weights", "aspect_hits", "review_id, place, aspect")
_MEANS = ", ".join(f"avg(expected) FILTER (aspect = '{a}') AS a_{a}" for a in lexicon.ASPECTS)
part("aspect_means", f"SELECT review_id, {_MEANS} FROM sent_rated GROUP BY review_id")
part(
    "scored",
    f"""SELECT d.review_id, d.text, d.user_rating, d.place_name, expected,
               {", ".join(f"coalesce(a_{a}, expected) AS aspect_{a}" for a in lexicon.ASPECTS)},
               abs(d.user_rating - expected) AS delta
        FROM doc_rated d JOIN clean c USING (review_id) LEFT JOIN aspect_means m USING (review_id)""",
)
_COLOR = (
    "CASE greatest(1, least(5, CAST(round_even({e}, 0) AS INTEGER))) "
    + " ".join(f"WHEN {s} THEN '{c}'" for s, c in lexicon.STAR_COLORS.items())
    + " END"
)


def _scored(spark, folder):
    return score_reviews(cleaned(spark, folder).drop("n_chars"), model(spark, folder))


@query(
    "q06_score_reviews",
    f"""SELECT review_id, text, user_rating, place_name, round(expected, 6) AS ai_expected_rating,
               {", ".join(f"round(aspect_{a}, 6) AS aspect_{a}" for a in lexicon.ASPECTS)},
               {_COLOR.format(e='expected')} AS ai_hex_color, round(delta, 6) AS delta, delta >= 2e0 AS is_anomaly FROM scored""",
)
def q06(spark, folder):
    names = ["ai_expected_rating", *[f"aspect_{a}" for a in lexicon.ASPECTS], "delta"]
    return r6(_scored(spark, folder).drop("probs"), *names)


@query(
    "a19_j02_aspect_ratings",
    f"SELECT review_id, {', '.join(f'round(a_{a}, 6) AS aspect_{a}' for a in lexicon.ASPECTS)} FROM aspect_means",
)
def a19(spark, folder):
    from starlens.plans.score import rate_texts

    sentences = aspects.aspect_sentences(vectorise.by_document(cleaned(spark, folder).select("review_id", "text")))
    rated_sentences = rate_texts(sentences, model(spark, folder), ("review_id", "place", "aspect"), "sentence")
    return r6(aspects.aspect_averages(rated_sentences), *[f"aspect_{a}" for a in lexicon.ASPECTS])


# --- venues --------------------------------------------------------------------

part("flagged", "SELECT *, abs(user_rating - ai_expected_rating) AS delta, abs(user_rating - ai_expected_rating) >= 2e0 AS is_anomaly FROM rated")
_UP = "CASE greatest(1, least(5, CAST(floor(a + 0.5e0) AS INTEGER))) " + " ".join(
    f"WHEN {s} THEN '{c}'" for s, c in lexicon.STAR_COLORS.items()
) + " END"
part(
    "venues",
    f"""SELECT place_name, round(u, 2) AS avg_user_rating, round(a, 2) AS avg_ai_rating, review_count, anomaly_count,
               anomaly_count > 0 AS has_anomaly, {_UP} AS ai_hex_color, mean_delta, max_delta FROM (
          SELECT place_name, avg(user_rating) AS u, avg(ai_expected_rating) AS a, count(*) AS review_count,
                 count(*) FILTER (is_anomaly) AS anomaly_count, avg(delta) AS mean_delta, max(delta) AS max_delta
          FROM flagged WHERE place_name IS NOT NULL GROUP BY place_name)""",
)


def flagged(spark, folder):
    return flag(rated(spark, folder))


@query(
    "a20_venue_rollup",
    """SELECT place_name, avg_user_rating, avg_ai_rating, review_count, anomaly_count, has_anomaly, ai_hex_color,
              round(mean_delta, 6) AS mean_delta, round(max_delta, 6) AS max_delta FROM venues""",
)
def a20(spark, folder):
    return r6(venues.rollup(flagged(spark, folder)), "mean_delta", "max_delta")


@query(
    "a21_city_counters",
    """SELECT count(*) AS tracked_venues, count(*) FILTER (has_anomaly) AS venues_with_anomaly, CAST(sum(review_count) AS BIGINT) AS reviews,
              round(sum(mean_delta * review_count) / sum(review_count), 6) AS mean_delta, round(max(max_delta), 6) AS max_delta FROM venues""",
)
def a21(spark, folder):
    return r6(venues.city_counters(venues.rollup(flagged(spark, folder))), "mean_delta", "max_delta")


@query(
    "w02_j04_first_per_venue",
    """SELECT review_id, place_name FROM (SELECT *, row_number() OVER (PARTITION BY place_name ORDER BY review_id) AS rn FROM rated
       WHERE place_name IS NOT NULL) WHERE rn <= 5""",
)
def w02(spark, folder):
    first = venues.first_per_venue(rated(spark, folder)).select("review_id", "place_name")
    return venues.surviving_venues(first, first.select("place_name").distinct()).select("review_id", "place_name")


part("venue_ids", "SELECT place_name, row_number() OVER (ORDER BY min(review_id)) AS restaurant_id FROM rated WHERE place_name IS NOT NULL GROUP BY place_name")


@query("w18_venue_ids", "SELECT * FROM venue_ids")
def w18(spark, folder):
    return venues.venue_ids(rated(spark, folder))


@query("j10_attach_venues", "SELECT review_id, place_name, restaurant_id FROM rated JOIN venue_ids USING (place_name)")
def j10(spark, folder):
    df = rated(spark, folder).select("review_id", "place_name")
    return venues.attach_venue_ids(df, venues.venue_ids(df))


@query(
    "w19_assign_venues",
    """SELECT review_id, 'ร้านที่ ' || CAST((row_number() OVER (ORDER BY review_id) - 1) % least(8, greatest(1, count(*) OVER () // 5)) + 1 AS VARCHAR) AS place_name
       FROM rated""",
)
def w19(spark, folder):
    return venues.assign_venues(rated(spark, folder).select("review_id"))


@query(
    "p16_p17_venue_search",
    """SELECT restaurant_id, place_name, review_count FROM venues JOIN venue_ids USING (place_name)
       WHERE contains(lower(place_name), 'src1') AND restaurant_id <> 3""",
)
def p16(spark, folder):
    ids = venues.venue_ids(rated(spark, folder))
    listed = venues.list_view(venues.attach_venue_ids(venues.rollup(flagged(spark, folder)), ids))
    found = venues.search(listed, "SRC1", ("place_name",))
    third = venues.by_id(listed, 3).select("restaurant_id")
    return found.join(third, "restaurant_id", "left_anti").select("restaurant_id", "place_name", "review_count")


part(
    "venue_firsts",
    """SELECT *, abs(user_rating - expected) AS delta, abs(user_rating - expected) >= 2e0 AS is_anomaly FROM (
         SELECT r.*, row_number() OVER (PARTITION BY r.place_name ORDER BY r.review_id) AS rn FROM doc_rated r JOIN clean USING (review_id)
         WHERE r.place_name IS NOT NULL) WHERE rn <= 5""",
)
part(
    "venue_sums",
    f"""SELECT place_name, first_id, round(u, 2) AS avg_user_rating, round(a, 2) AS avg_ai_rating, review_count, anomaly_count,
               {_UP} AS ai_hex_color, review_ids FROM (
          SELECT place_name, min(review_id) AS first_id, avg(user_rating) AS u, avg(expected) AS a, count(*) AS review_count,
                 count(*) FILTER (is_anomaly) AS anomaly_count, string_agg(CAST(review_id AS VARCHAR), ',' ORDER BY review_id) AS review_ids
          FROM venue_firsts GROUP BY place_name)""",
)


@query("q08_venue_cache", "SELECT * EXCLUDE (first_id), row_number() OVER (ORDER BY first_id) AS restaurant_id FROM venue_sums")
def q08(spark, folder):
    # The scored first reviews are read by the rollup, the numbering and the nesting.
    scored = stage(venue_reviews(cleaned(spark, folder).drop("n_chars"), model(spark, folder)))
    out = venue_cache(scored)
    ids = F.array_join(F.transform("reviews", lambda r: r["review_id"].cast("string")), ",")
    return out.select(
        "place_name", "restaurant_id", "avg_user_rating", "avg_ai_rating", "review_count", "anomaly_count", "ai_hex_color",
        ids.alias("review_ids"),
    )


# --- cache and fingerprint -------------------------------------------------------

part("level0", "SELECT review_id // 1024 AS i, sha256(string_agg(sha256(text), chr(10) ORDER BY review_id)) AS h FROM standard GROUP BY 1")
part("level1", "SELECT i // 1024 AS i, sha256(string_agg(h, chr(10) ORDER BY i)) AS h FROM level0 GROUP BY 1")
part("level2", "SELECT i // 1024 AS i, sha256(string_agg(h, chr(10) ORDER BY i)) AS h FROM level1 GROUP BY 1")
part("level3", "SELECT i // 1024 AS i, sha256(string_agg(h, chr(10) ORDER BY i)) AS h FROM level2 GROUP BY 1")


@query(
    "a30_corpus_fingerprint",
    """SELECT substr(h, 1, 16) AS fingerprint, substr(sha256('encoder|extended|' || (SELECT count(*) FROM standard) || '|0|' || substr(h, 1, 16)), 1, 16) AS cache_key
       FROM level3""",
)
def a30(spark, folder):
    texts = standard(spark, folder)
    print_of = cache.corpus_fingerprint(texts)
    key = cache.composite_key("encoder", "extended", ranking.count_of(texts), F.lit(0), F.col("fingerprint"))
    return print_of.withColumn("cache_key", key)


@query(
    "j09_cache_hits",
    """SELECT 'hit' AS kind, count(*) AS texts FROM embeddings JOIN plain_texts ON vec_id = review_id
       UNION ALL SELECT 'miss', count(DISTINCT text) FROM plain_texts WHERE text NOT IN (SELECT text FROM plain_texts JOIN embeddings ON vec_id = review_id)""",
)
def j09(spark, folder):
    from starlens.catalog.ratings import plain_texts

    texts = plain_texts(spark, folder)
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("review_id"), "embedding")
    key = cache.text_key("encoder", "minimal", F.col("text"))
    stored = texts.join(vectors, "review_id").select("review_id", key.alias("cache_key"), "embedding")
    hits, misses = cache.split_hits(texts, stored, "encoder", "minimal")
    # One stored vector per text and row: rows that share a text count once.
    own = hits.join(stored.select("review_id", "cache_key"), ["review_id", "cache_key"], "left_semi").select("review_id").distinct()
    return own.agg(F.count(F.lit(1)).alias("texts")).select(F.lit("hit").alias("kind"), "texts").unionByName(
        misses.agg(F.count(F.lit(1)).alias("texts")).select(F.lit("miss").alias("kind"), "texts")
    )
