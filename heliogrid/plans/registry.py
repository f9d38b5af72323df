"""All registered queries."""

from __future__ import annotations

from heliogrid.plans import queries_models, queries_reduce, queries_spatial, queries_tables

QUERIES = {
    **queries_tables.QUERIES,
    **queries_reduce.QUERIES,
    **queries_spatial.QUERIES,
    **queries_models.QUERIES,
}

flagship = queries_models.model_scores
