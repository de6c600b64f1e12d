"""All registered queries of the planning library."""

from __future__ import annotations

from terraloom.plans import archive, catalog, dashboard, ingest, planting, records, regions, versions

_ALL = (dashboard, planting, archive, records, ingest, catalog, versions, regions)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _ALL for k, v in m.ORACLES.items()}
FLAGSHIP = dashboard.rollup
