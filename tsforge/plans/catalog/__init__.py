"""All catalog queries. Importing a module registers its queries."""

from tsforge.plans.catalog import (  # noqa: F401
    clean,
    columns,
    evaluate,
    features,
    joins,
    models,
    quality,
    reshape,
    scaling,
    sources,
    splits,
    streaming,
    windows,
)
from tsforge.plans.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
