"""All registered queries."""

from __future__ import annotations

from renewlake.plans import (  # noqa: F401
    dashboards, descriptive, feature_store, ingest, kpi, predictive, scenarios, scores, snapshots,
)
from renewlake.plans.registry import QUERIES

__all__ = ["QUERIES"]
