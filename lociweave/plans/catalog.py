"""All named queries and their SQL: importing the modules registers them."""

from lociweave.plans import analysis_queries, chain_queries, label_queries, pair_queries, reference_queries, resampling_queries, sample_queries, strain_queries  # noqa: F401
from lociweave.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
