"""Feature vectors for Spark ML: word and character TF-IDF, extra features, LSA."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    HashingTF,
    Normalizer,
    PCAModel,
    VectorAssembler,
    Word2Vec,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.functions import text as T
from starlens.operators import counting, ranking, vectorise
from starlens.operators.once import compute_once
from starlens.params import Params
from starlens.session import stage


@dataclass(frozen=True)
class FeatureModel:
    """Fitted vectorisers plus the parameters that decide which columns they read.

    Known character n-grams are counted in Arrow workers, so that the other
    ones, most of a text's, never become strings.
    """

    stages: PipelineModel
    params: Params

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        stages = self.stages.stages
        known = [s for s in stages if isinstance(s, CountVectorizerModel) and s.getInputCol() == "char_grams"]
        made = analyse(df, self.params, text, *[s.vocabulary for s in known])
        rest = PipelineModel([s for s in stages if s not in known])
        return rest.transform(made).drop(
            "word_grams", "char_grams", "extra", "word_tf", "char_tf", "word_idf", "char_idf", "word_vec", "char_vec",
            "terms", "reduced",
        )


def analyse(df: DataFrame, params: Params, text: str = "text", known: Sequence[str] | None = None) -> DataFrame:
    """Add the term lists (and extra features) that the vectorisers read.

    With the ``known`` character n-grams of a fitted vocabulary, their counts
    (``char_tf``) stand for the lists of all of them.
    """
    words = compute_once(df, "_words", T.tokens(T.extended(F.col(text))))
    out = words.withColumn("word_grams", T.word_ngrams(F.col("_words"), *params.word_ngrams)).drop("_words")
    if params.use_char_features:
        pieces = T.blank_split(F.lower(F.col(text)))
        low, high = params.char_ngrams
        if known is None:
            out = out.withColumn("char_grams", F.flatten(F.transform(pieces, lambda w: T.char_ngrams(w, low, high))))
        else:
            out = out.withColumn("char_tf", _known_counts(known, low, high)(pieces))
    if params.use_extra_features:
        out = out.withColumn("extra", array_to_vector(T.extra_features(F.col(text))))
    return out


def _known_counts(known: Sequence[str], low: int, high: int):
    run = counting.known_grams(list(known), low, high)

    @F.arrow_udf(VectorUDT())
    def counts(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(lists)

    return counts


def _tfidf_stages(vocabulary: DataFrame, kind: str) -> list:
    """Term counts, the smoothed idf with its + 1, unit length.

    The vocabulary is collected: it has at most max_features rows.
    """
    rows = vocabulary.orderBy(F.col("ctf").desc(), "term").select("term", "idf").collect()
    terms = [r["term"] for r in rows]
    idf = Vectors.dense([r["idf"] for r in rows])
    return [
        CountVectorizerModel.from_vocabulary(terms, inputCol=f"{kind}_grams", outputCol=f"{kind}_tf"),
        ElementwiseProduct(scalingVec=idf, inputCol=f"{kind}_tf", outputCol=f"{kind}_idf"),
        Normalizer(p=2.0, inputCol=f"{kind}_idf", outputCol=f"{kind}_vec"),
    ]


def fit_features(train: DataFrame, params: Params = Params(), text: str = "text") -> FeatureModel:
    """Fit on training rows only."""
    docs, documents = vectorise.by_document(train), ranking.count_of(train)
    limits = {"min_df": params.word_min_df, "max_df": params.word_max_df}
    words = vectorise.word_totals(docs, text=text, ngrams=params.word_ngrams)
    stages = _tfidf_stages(vectorise.vocabulary_of(words, documents, params.word_max_features, **limits), "word")
    parts = ["word_vec"]
    if params.use_char_features:
        grams = vectorise.char_totals(docs, text=text, ngrams=params.char_ngrams)
        stages += _tfidf_stages(vectorise.vocabulary_of(grams, documents, params.char_max_features, **limits), "char")
        parts.append("char_vec")
    if params.use_lsa:
        # The terms alone are reduced; raw character counts would drown them.
        stages.append(VectorAssembler(inputCols=parts, outputCol="terms"))
        terms = PipelineModel(stages).transform(analyse(train, params, text)).select(F.col("terms").alias("features"))
        reduction = fit_reduction(stage(terms), params.lsa_components)
        stages.append(reduction.model.setInputCol("terms").setOutputCol("reduced"))
        parts = ["reduced"]
    if params.use_extra_features:
        parts.append("extra")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return FeatureModel(PipelineModel(stages), params)


def encode_offline(df: DataFrame, kind: str, size: int = 256, text: str = "text", seed: int = 42) -> DataFrame:
    """Add ``features``: unit-length text vectors from an encoder that needs no download.

    ``hashing`` counts hashed words; ``word2vec`` averages word vectors that it
    learns from the given texts.  The words are stored, since learning reads
    them twice and encoding once more.
    """
    words = stage(compute_once(df, "_words", T.tokens(T.extended(F.col(text)))))
    if kind == "hashing":
        made = HashingTF(numFeatures=size, inputCol="_words", outputCol="_raw").transform(words)
    elif kind == "word2vec":
        learner = Word2Vec(vectorSize=size, minCount=2, seed=seed, inputCol="_words", outputCol="_raw")
        made = learner.fit(words).transform(words)
    else:
        raise ValueError(f"unknown encoder: {kind}")
    return Normalizer(p=2.0, inputCol="_raw", outputCol="features").transform(made).drop("_words", "_raw")


def embedding_features(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column)))


@dataclass(frozen=True)
class Reduction:
    """The projection on the right singular vectors as a transformer, and the explained variance share."""

    model: PCAModel
    explained: float


def reduce_features(df: DataFrame, reduction: Reduction) -> DataFrame:
    """Replace ``features`` by their projection on the components."""
    projection = reduction.model.setInputCol("features").setOutputCol("_reduced")
    return projection.transform(df).drop("features").withColumnRenamed("_reduced", "features")


def fit_reduction(df: DataFrame, components: int = 400) -> Reduction:
    """Truncated singular value decomposition of ``features`` without centring; at most as many components as features."""
    spark = df.sparkSession
    width = df.select(vector_size("features").alias("n")).first()["n"]
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(df.select("features"), "features")).computeSVD(min(components, width))
    matrix = DenseMatrix(svd.V.numRows, svd.V.numCols, svd.V.values, bool(svd.V.isTransposed))
    # A projection without centring is what the principal component transformer applies.
    java = spark._jvm.org.apache.spark.ml.feature.PCAModel(
        f"lsa_{svd.V.numRows}_{svd.V.numCols}", _py2java(spark.sparkContext, matrix), _py2java(spark.sparkContext, Vectors.dense(svd.s.toArray()))
    )
    java.set(java.k(), matrix.numCols)
    bare = Reduction(PCAModel(java), 0.0)

    def variance(rows: DataFrame) -> float:
        return float(rows.agg(Summarizer.variance(F.col("features")).alias("v")).first()["v"].toArray().sum())

    before = variance(df)
    return Reduction(bare.model, variance(reduce_features(df.select("features"), bare)) / before if before else 0.0)


def vector_size(column: str):
    return F.size(vector_to_array(F.col(column)))
