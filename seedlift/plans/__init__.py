"""All queries; importing this package registers them."""

from seedlift.plans import agreement, learning, models, prep, tables  # noqa: F401
from seedlift.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
