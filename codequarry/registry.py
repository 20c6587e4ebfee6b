"""Registered queries of the code-intelligence engine and their SQL."""

from __future__ import annotations

from codequarry.plans import candidates, graph, resolve, sources, text

SPECS = [*graph.specs.found, *text.specs.found, *resolve.specs.found, *sources.specs.found, *candidates.specs.found]
QUERIES = {s.name: s.run for s in SPECS}
ORACLES = {s.name: s.sql for s in SPECS if s.sql}
