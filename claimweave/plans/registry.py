"""All registered queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from claimweave.plans import claim_queries as c
from claimweave.plans import model_queries, register_queries, substrate_queries as sq  # noqa: F401 (the first two add to the last)
from claimweave.plans import training_core as t

TRAINING = {n: getattr(t, n) for n in ("p1_found", "p1_instants", "p2_found", "p2_wide", "p2_overflow", "p4_found", "p4_paths", "p4_descendants", "p5_found", "p5_periods", "p6_found")}


def queries():
    return {**TRAINING, **c.QUERIES, **sq.QUERIES}


def oracle_sql():
    return {**t.SQL, **c.SQL, **sq.SQL}


def flagship(spark, folder):
    return c.flagship(spark, folder)
