"""Every registered query over the reference's operators, with its SQL where SQL can express it."""

from __future__ import annotations

from .operators import documents, evidence, grounding, procedural, relational, retrieval, scoring  # noqa: F401  they register their queries
from .functions import tables  # noqa: F401
from .plans import flows  # noqa: F401
from .registry import ORACLES, QUERIES
from .sources import readers  # noqa: F401
from .streaming import state  # noqa: F401

FLAGSHIP = "V4_rrf_hybrid"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
