"""All queries and their SQL."""

from __future__ import annotations

from tastemill.plans import catalog_data, catalog_models

QUERIES = {**catalog_data.QUERIES, **catalog_models.QUERIES}
ORACLES = {**catalog_data.ORACLES, **catalog_models.ORACLES}
