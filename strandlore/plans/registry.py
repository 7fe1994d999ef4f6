"""All registered queries and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from strandlore.plans import domain_plans, provenance_plans, service_plans, store_plans, text_plans, training_plans, upkeep_plans, vector_plans

MODULES = [provenance_plans, domain_plans, service_plans, store_plans, text_plans, training_plans, upkeep_plans, vector_plans]

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
