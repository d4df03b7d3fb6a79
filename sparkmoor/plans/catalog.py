"""All registered queries."""

from . import (decoding_queries, expert_queries, ngram_queries, text_queries, utility_queries, vector_queries)  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
