"""All registered queries of the core and their SQL."""

from __future__ import annotations

from wickerlane.plans import evaluation, events, further, ranking, recommend, reports, streams, training, vectors  # noqa: F401
from wickerlane.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
