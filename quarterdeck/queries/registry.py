"""All registered queries."""

from __future__ import annotations

from . import changes, clients, documents, forecasts, gold, labels, silver  # noqa: F401  (each module registers its queries)
from .silver import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
