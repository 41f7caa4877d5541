"""All queries of the subpackage. Importing a module registers its queries."""

from tsforge.llm import (  # noqa: F401
    bytebpe,
    chunks,
    divergence,
    idfiles,
    jaccard,
    lines,
    ordinal,
    packing,
    quality,
    ranked,
    tokencount,
    urlfilter,
    vectors,
)
from tsforge.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
