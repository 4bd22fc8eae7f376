"""All queries of the provenance engine, and the SQL that checks them."""

from __future__ import annotations

from lodeweave.plans import catalog, etl, exports, extraction, graph, provenance, scalars, upkeep

MODULES = (provenance, catalog, graph, scalars, etl, extraction, exports, upkeep)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
