"""Claim query language and SPARQL subset, both planned as one DataFrame."""

from claimweave.query.lang import Query, parse, parse_sparql
from claimweave.query.plan import Store, plan, run

__all__ = ["Query", "Store", "parse", "parse_sparql", "plan", "run"]
