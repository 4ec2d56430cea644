"""The registered queries of the training-data operators and their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.llm import (
    exact_dedup,
    fingerprints,
    langid,
    license_scan,
    line_dedup,
    merkle_manifest,
    mixing,
    oracles,
    packing,
    piece_codec,
    pii,
    sharding,
    simhash_dedup,
    vector_codes,
)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(documents(spark, folder))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.remove_spread_lines(documents(spark, folder))
    return out.select("doc_id", "text", "line_dedup.n_lines", "line_dedup.n_removed")


def op3_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_duplicates(documents(spark, folder))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(documents(spark, folder))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), tokenizer_path())


def op6_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return pii.replace_entities(documents(spark, folder), "surrogates").select(
        "doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities"
    )


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, folder))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, folder))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predictions(documents(spark, folder))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(documents(spark, folder))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest.verify(documents(spark, folder), merkle_manifest.tampered_text())


def op12_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.digests(documents(spark, folder), piece_model_path())


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{folder}/embeddings.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_line_dedup, op3_simhash_near_dedup, op4_mixing, op5_packing, op6_pii_surrogates,
        op7_exact_dedup, op8_fingerprints, op9_language_id, op10_sharding, op11_merkle_manifest, op12_sentencepiece,
        op13_vector_codes,
    )
}

# Lines by their text instead of a hash, sites counted exactly.
_BARE = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

ORACLES = {
    "op11_merkle_manifest": oracles.MERKLE,
    "op13_vector_codes": oracles.VECTOR_CODES,
    "op2_line_dedup": f"""
        WITH split AS (
            SELECT doc_id, source, i, line, {_BARE} AS bare
            FROM (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS i,
                         unnest(string_split(text, chr(10))) AS line FROM documents)
        ),
        spread AS (
            SELECT bare, min(doc_id) AS first_doc FROM split WHERE bare <> ''
            GROUP BY bare HAVING count(DISTINCT coalesce('s' || source, '')) >= {line_dedup.MIN_SITES}
        ),
        told AS (
            SELECT s.doc_id, s.i, s.line, coalesce(s.doc_id <> p.first_doc, false) AS gone
            FROM split s LEFT JOIN spread p ON s.bare = p.bare
        )
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
               count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
        FROM told GROUP BY doc_id
    """,
    "op7_exact_dedup": """
        WITH plain AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM plain WINDOW w AS (PARTITION BY t)
    """,
}
