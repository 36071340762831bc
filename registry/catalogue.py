"""All registered queries."""

from __future__ import annotations

from registry import q_covisit, q_features, q_lists, q_plans, q_ranking, q_sources, q_vectors  # noqa: F401
from registry.core import registry

QUERIES = registry.all
