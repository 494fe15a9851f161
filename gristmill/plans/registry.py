"""All registered queries: name to (query, check SQL or None)."""

from __future__ import annotations

from .data_queries import DATA_QUERIES
from .model_queries import MODEL_QUERIES
from .training_queries import TRAINING_QUERIES

ALL_QUERIES = {**DATA_QUERIES, **MODEL_QUERIES, **TRAINING_QUERIES}
