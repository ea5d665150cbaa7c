"""Importing this module registers every query."""

from featmart.plans import (  # noqa: F401
    aggregate_queries,
    cleaning_queries,
    column_queries,
    credit_queries,
    key_queries,
    model_queries,
    profile_queries,
    score_queries,
    sequence_queries,
    source_queries,
    stream_queries,
)
from featmart.plans.registry import PLANS, SQL  # noqa: F401
