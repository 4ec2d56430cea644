"""First reviews per venue, scored and rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame

from starlens.operators import venues
from starlens.params import Params
from starlens.plans.score import Scorer, score_reviews


def venue_reviews(reviews: DataFrame, model: Scorer, params: Params = Params(), k: int = 5) -> DataFrame:
    """Scored first k reviews of every venue; venues are dealt out if the table names none."""
    if "place_name" not in reviews.columns:
        reviews = venues.assign_venues(reviews)
    return score_reviews(venues.first_per_venue(reviews, k), model, params, skip_aspects=True)


def venue_cache(scored: DataFrame, k: int = 5) -> DataFrame:
    """Venues with id, rollup and their nested reviews (k per venue at most)."""
    rolled = venues.rollup(scored)
    named = venues.attach_venue_ids(rolled, venues.venue_ids(scored))
    return venues.nest_reviews(named, scored, k)
