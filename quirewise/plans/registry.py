"""All registered queries."""

from __future__ import annotations

from quirewise.plans import layers, page_set, records, redaction, runs, security

_MODULES = (page_set, redaction, security, records, layers, runs)

QUERIES = {name: make for module in _MODULES for name, make in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
