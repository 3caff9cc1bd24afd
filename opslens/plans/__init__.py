"""Named queries over the driver tables, each beside its reference SQL."""

from opslens.plans import findings, fleet, governance, history, status, streams, sync  # noqa: F401  (each registers its queries)
from opslens.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
