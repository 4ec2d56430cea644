"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starlens.llm import langid, line_dedup, mixing, packing, shingle_dedup, simhash_dedup
from starlens.llm.catalog import documents, tokenizer_path
from starlens.session import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn languages from the rows that are not held out; drop the documents that the model rejects."""
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    return langid.keep_identified(docs, model)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines that stand on many sites out of all documents but the first; no document is dropped.

    Rows whose ids are null or repeat are told apart by their texts.
    """
    return line_dedup.remove_spread_lines(docs, identity=line_dedup.each_row()).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near duplicates.

    Documents link when their SimHash fingerprints do (``simhash_dedup``), or
    at a similarity of 0.8 or more on five-word shingles.
    """
    return shingle_dedup.one_per_group(docs, simhash_dedup.near_duplicates)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents until every source has its target of words."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents' token ids into sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("lines", remove_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Fitted centroids, fingerprint components and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
    return docs
