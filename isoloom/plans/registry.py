"""All queries and oracles of the annotation engine."""

from __future__ import annotations

from isoloom.plans import assembly_queries, io_queries, psi_queries, structure_queries, variant_queries

_MODULES = (psi_queries, structure_queries, variant_queries, assembly_queries, io_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
