"""Queries over the given tables, and the pipelines they are built from."""

from tidemark.plans import evaluation_queries, forensic_queries, history_queries, identity_queries, landing_queries, model_queries, offer_queries, pipeline_queries, shape_queries  # noqa: F401
from tidemark.plans.base import ORACLES, QUERIES  # noqa: F401
