"""All query modules."""

from jobsight.plans import (  # noqa: F401
    costs,
    diagnosis,
    ingest,
    monitoring_queries,
    recommending,
    scalars,
    store,
    tuning_queries,
    workload_queries,
)
from jobsight.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
