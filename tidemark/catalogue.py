"""Every registered query of the engine with its DuckDB equivalent."""

from __future__ import annotations

from tidemark.plans import relational, versioned

QUERIES = relational.QUERIES | versioned.QUERIES
ORACLES = relational.ORACLES | versioned.ORACLES
flagship = versioned.flagship
