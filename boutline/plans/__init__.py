"""Named queries on the driver's tables."""

from boutline.plans import cubes, entities, ingestion, models, outcomes, profiles, readers, records, relational, replays, scalars, sweeps  # noqa: F401
from boutline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
