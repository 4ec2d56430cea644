"""Run parameters, passed explicitly and never mutated."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # fixed values: defaults that decide the results
    seed: int = 42
    holdout_fraction: float = 0.2
    min_text_length: int = 5
    duplicate_keep: str | None = "first"  # first | last | none; None keeps duplicates
    max_review_chars: int = 500
    majority_star: int = 4

    word_max_features: int = 8000
    word_ngrams: tuple[int, int] = (1, 2)
    word_min_df: int = 2
    word_max_df: float = 0.9
    char_max_features: int = 4000
    char_ngrams: tuple[int, int] = (3, 5)
    use_char_features: bool = True
    use_extra_features: bool = False
    use_lsa: bool = False
    lsa_components: int = 400

    undersample_star: int = 4
    undersample_fraction: float = 0.65
    mock_fraction: float = 0.2
    oversample_low_stars: bool = True
    oversample_factor: int = 5
    low_stars: tuple[int, ...] = (1, 2)
    folds: int = 5

    augment: bool = True
    augment_stars: tuple[int, ...] = (1, 2, 3)
    augment_target: int = 2500
    synonym_prob: float = 0.3
    shuffle_prob: float = 0.2
    error_factor: int = 2

    anomaly_threshold: float = 2.0
    severe_delta: int = 2
    low_confidence: float = 0.4
    gaussian_sigma: float = 0.5
    target_accuracy: float = 0.9

    use_class_weight: bool = True
    low_star_boost: float = 3.0
    compat: bool = False  # weigh classes twice: balanced weights times the boosted ones
    mode: str = "five_class"  # five_class | three_class | regression
    strategy: str = "extended"
    default_model_strategy: str = "keep_digits"
    champion_metric: str = "mae"
    champion_fallback: str = "baseline"

    # iteration counts of the learners
    lr_max_iter: int = 100
    svm_max_iter: int = 50
    forest_trees: int = 100
    gbt_rounds: int = 50
    tree_depth: int = 5
    linear_strength: float = 1.0  # summed loss against half the squared coefficients, for stacked linear models

    def override(self, **changes) -> "Params":
        return replace(self, **changes)
