"""Ratings, probabilities and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starlens import lexicon

# Numbers a CSV reader would accept; Java-only suffixes such as "1d" are refused.
NUMERIC = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def parse_rating(raw: Column) -> Column:
    """Double, or null when the text is no finite number."""
    text = raw.cast("string")
    return F.when(text.rlike(NUMERIC), F.trim(text).try_cast("double"))


def round_star(value: Column) -> Column:
    """Half to even."""
    return F.bround(value, 0).cast("int")


def clip_star(value: Column) -> Column:
    """Half to even, held in 1..5."""
    return F.greatest(F.lit(1), F.least(F.lit(5), round_star(value)))


def in_range(star: Column) -> Column:
    return star.between(1, 5)


def rating_delta(user: Column, expected: Column) -> Column:
    return F.abs(user - expected)


def is_anomaly(user: Column, expected: Column, threshold: float = 2.0) -> Column:
    return rating_delta(user, expected) >= F.lit(threshold)


def is_severe(user: Column, expected: Column, min_delta: int = 2) -> Column:
    return F.abs(clip_star(expected) - user) >= F.lit(min_delta)


def _color(star: Column) -> Column:
    pairs = [F.lit(v) for kv in lexicon.STAR_COLORS.items() for v in kv]
    return F.element_at(F.create_map(*pairs), star)


def star_color(rating: Column) -> Column:
    """Colour of the half-to-even star; missing ratings look like three stars."""
    known = rating.isNotNull() & ~F.isnan(rating)
    return F.when(known, _color(clip_star(rating))).otherwise(F.lit(lexicon.STAR_COLORS[3]))


def venue_color(rating: Column) -> Column:
    """Venue colours round half up instead."""
    up = F.floor(rating + F.lit(0.5)).cast("int")
    return _color(F.greatest(F.lit(1), F.least(F.lit(5), up)))


def half_star(rating: Column) -> Column:
    """Nearest half star, half up."""
    return F.floor(rating * 2 + F.lit(0.5)) / F.lit(2.0)


def three_class(star: Column) -> Column:
    """1-2 -> 0, 3 -> 1, 4-5 -> 2."""
    return F.when(star <= 2, 0).when(star == 3, 1).otherwise(2)


def three_class_star(label: Column) -> Column:
    """Centre of the class, the index being held in 0..2."""
    centres = F.array(*[F.lit(c) for c in lexicon.THREE_CLASS_CENTRES])
    held = F.greatest(F.lit(0), F.least(F.lit(2), label.cast("int")))
    return F.element_at(centres, held + 1)


def training_label(star: Column, mode: str) -> Column:
    if mode == "three_class":
        return three_class(star).cast("double")
    if mode in ("five_class", "regression"):
        return (star - 1).cast("double")
    raise ValueError(f"unknown label mode: {mode}")


def regression_star(raw: Column) -> Column:
    """Model output on 0..4 back to a star, held in 1..5."""
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), raw + 1.0))


def expected_rating(probs: Column) -> Column:
    """Sum of star times probability."""
    weighted = F.transform(probs, lambda p, i: p * (i + 1))
    return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)


def argmax_class(probs: Column) -> Column:
    """Zero-based index of the first largest probability."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def normalise_array(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: x / total)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    return normalise_array(F.transform(logits, lambda x: F.exp(x - top)))


def gaussian_probs(expected: Column, sigma: float = 0.5) -> Column:
    """Pseudo probabilities of the five stars around an expectation."""
    stars = F.array(*[F.lit(float(s)) for s in lexicon.STARS])
    bell = F.transform(stars, lambda k: F.exp(-((k - expected) * (k - expected)) / F.lit(sigma)))
    return normalise_array(bell)


def focal_loss(probs: Column, target: Column, gamma: float = 2.0, alpha: list[float] | None = None) -> Column:
    """-(alpha) (1 - p)^gamma ln p of the true class (zero-based target)."""
    p = F.element_at(probs, target + 1)
    loss = -F.pow(1 - p, F.lit(gamma)) * F.log(p)
    if alpha is not None:
        loss = F.element_at(F.array(*[F.lit(float(a)) for a in alpha]), target + 1) * loss
    return loss
