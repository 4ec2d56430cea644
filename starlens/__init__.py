"""starlens: review-reputation analytics as Spark DataFrame jobs."""

from starlens.params import Params

__all__ = ["Params"]
