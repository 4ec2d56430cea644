"""Registry of queries and the view of the given tables as reviews.

Every query reads the tables whole.  The oracle statements are put together
from named common table expressions, so that the same adapter and the same
fixed values feed both engines.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.session import spread

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Runner], Runner]:
    def add(run: Runner) -> Runner:
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(name, run, None if oracle is None else with_parts(oracle))
        return run

    return add


# --- SQL parts ---------------------------------------------------------------

PARTS: dict[str, str] = {}


def part(name: str, body: str) -> None:
    PARTS[name] = body.strip()


def _needed(body: str, found: list[str]) -> None:
    for name in PARTS:
        if name not in found and re.search(rf"\b{name}\b", body):
            _needed(PARTS[name], found)
            if name not in found:
                found.append(name)


def with_parts(body: str) -> str:
    """Prefix a statement with the parts it names, dependencies first."""
    found: list[str] = []
    _needed(body, found)
    if not found:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in found) + "\n" + body.strip()


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- the given tables as reviews ----------------------------------------------

# Review endings, chosen by doc_id % 12.
ENDINGS = (
    "",
    "รอคิวนานนนน ตั้ง 2 รอบ!!! 😡 กว่าจะได้โต๊ะ",
    "Parking FULL ตลอด จอดไกล ไม่น่าขับรถมา",
    "https://menu.invalid/p?id=7 www.menu.invalid แผนที่",
    "เด็กเสิร์ฟหายไปนาน 😡👎",
    "ปลาคาว หมูเหนียว แกงจืดชืด น้ำห่วย",
    "ไม่แนะนำ ไม่ค่อย ประทับใจ ไม่เคย ลืม",
    "เพลงเพราะ แอร์เย็น โต๊ะกว้าง",
    "รวม ๗๘๙ บาท 🚀✨",
    "ดีงาม ฟิน นัว ต้องลอง ❤️⭐",
    "yum yummm tasteeee??!!",
    "เจ้าของ   ต้อนรับ\tช้า",
)

# Three stand-in models, expectation = 1 + (id a + chars b) mod 401 / 100.
MODELS = (("baseline", 37, 11), ("embedding", 53, 7), ("transformer", 29, 17))
MODEL_NAMES = tuple(m for m, _, _ in MODELS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def expectation(a: int, b: int, id_col: str = "doc_id", chars: str = "n_chars") -> Column:
    return F.lit(1.0) + ((F.col(id_col) * a + F.col(chars) * b) % 401) / F.lit(100.0)


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """(review_id, review_body, stars, place_name, n_chars)"""
    endings = F.array(*[F.lit(e) for e in ENDINGS])
    body = F.concat(F.col("text"), F.lit(" "), F.element_at(endings, (F.col("doc_id") % 12 + 1).cast("int")))
    return spread(table(spark, folder, "documents"), "doc_id").select(
        F.col("doc_id").alias("review_id"),
        body.alias("review_body"),
        (F.lit(1) + (F.col("doc_id") * 7 + F.col("n_chars")) % 5).cast("int").alias("stars"),
        F.when(F.col("doc_id") % 17 != 0, F.col("source")).alias("place_name"),
        "n_chars",
    )


part(
    "reviews",
    f"""
    SELECT doc_id AS review_id,
           text || ' ' || [{", ".join(quote(e) for e in ENDINGS)}][doc_id % 12 + 1] AS review_body,
           CAST(1 + (doc_id * 7 + n_chars) % 5 AS INTEGER) AS stars,
           CASE WHEN doc_id % 17 <> 0 THEN source END AS place_name,
           n_chars
    FROM documents
    """,
)


def chats(spark: SparkSession, folder: str) -> DataFrame:
    """A second review source: (review_id, review_body, stars)."""
    return table(spark, folder, "conversations").select(
        F.concat_ws(":", F.lit("chat"), "conv_id", "turn").alias("review_id"),
        F.col("text").alias("review_body"),
        (F.lit(1) + (F.col("conv_id") * 3 + F.col("turn")) % 5).cast("int").alias("stars"),
    )


part(
    "chats",
    """
    SELECT 'chat:' || conv_id || ':' || turn AS review_id, text AS review_body,
           CAST(1 + (conv_id * 3 + turn) % 5 AS INTEGER) AS stars FROM conversations
    """,
)


def rated(spark: SparkSession, folder: str) -> DataFrame:
    """(review_id, user_rating, place_name, ai_expected_rating) of the first model."""
    _, a, b = MODELS[0]
    return reviews(spark, folder).select(
        "review_id",
        F.col("stars").alias("user_rating"),
        "place_name",
        expectation(a, b, "review_id").alias("ai_expected_rating"),
    )


part(
    "rated",
    f"""
    SELECT review_id, stars AS user_rating, place_name,
           1 + ((review_id * {MODELS[0][1]} + n_chars * {MODELS[0][2]}) % 401) / 100e0 AS ai_expected_rating
    FROM reviews
    """,
)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(model, model_order, review_id, user_rating, ai_expected_rating), all models."""
    options = [
        F.struct(
            F.lit(m).alias("model"),
            F.lit(i).alias("model_order"),
            expectation(a, b, "review_id").alias("ai_expected_rating"),
        )
        for i, (m, a, b) in enumerate(MODELS)
    ]
    return (
        reviews(spark, folder)
        .select("review_id", F.col("stars").alias("user_rating"), F.explode(F.array(*options)).alias("m"))
        .select("m.model", "m.model_order", "review_id", "user_rating", "m.ai_expected_rating")
    )


part(
    "predictions",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS model, {i} AS model_order, review_id, stars AS user_rating,
            1 + ((review_id * {a} + n_chars * {b}) % 401) / 100e0 AS ai_expected_rating FROM reviews"""
        for i, (m, a, b) in enumerate(MODELS)
    ),
)
part(
    "rounded",
    """
    SELECT *, greatest(1, least(5, CAST(round_even(ai_expected_rating, 0) AS INTEGER))) AS pred
    FROM predictions
    """,
)
