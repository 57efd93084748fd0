"""The catalogue of queries with their reference SQL."""

from . import more  # noqa: F401  (registers its queries)
from .catalogue import CATALOGUE, flagship

__all__ = ["CATALOGUE", "flagship"]
