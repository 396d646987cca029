"""All queries of the core."""

from __future__ import annotations

from loomline.plans import corpus_queries, retrieval_queries, text_queries  # noqa: F401
from loomline.plans.shared import REGISTRY

__all__ = ["REGISTRY"]
