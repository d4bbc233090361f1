from workload.catalog import ORACLES, QUERIES
from workload import (  # noqa: F401
    analysis_queries, attribution_queries, design_queries, source_queries, streaming_queries,
)

__all__ = ["ORACLES", "QUERIES"]
