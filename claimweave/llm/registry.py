"""Registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from claimweave.llm import queries as q

QUERIES = {n: getattr(q, n) for n in ("p3_found", "p7_found", "p8_packing", "p9_found", "p9_leaks", "p10_found", "p10_levels", "p10_cross_validation")}
SQL: dict[str, str] = {
    "p3_found": (
        "WITH RECURSIVE e AS (SELECT DISTINCT trim(source) AS a, trim(target) AS b FROM alignments WHERE lower(regexp_replace(relation, '[^A-Za-z]', '', 'g')) = 'exactequivalent' "
        "AND trim(source) <> '' AND trim(target) <> '' AND trim(source) <> trim(target)), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), "
        "r AS (SELECT a AS s, a AS n FROM l UNION SELECT r.s, l.b FROM r JOIN l ON l.a = r.n) SELECT n AS iri, min(s) AS group_iri FROM r GROUP BY n"
    ),
}


def queries():
    return QUERIES


def oracle_sql():
    return SQL
