"""Every register of the model as a query: a log of requests, some of them bad or repeated, checked and folded.

The logs are made from the documents' numbers, so both engines see the same rows; the SQL
is written from the register's rules (what is required, what is checked, which version counts).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.operators.store import REGISTERS
from claimweave.plans import substrate_queries as sq

# columns that aren't short texts
_SPECIAL = {
    "confidence": "CASE WHEN doc_id % 4 > 0 THEN (doc_id % 13) / CAST(10 AS DOUBLE) END", "strength": "(doc_id % 13) / CAST(10 AS DOUBLE)",
    "start_offset": "doc_id % 50", "end_offset": "doc_id % 60", "mode": "CASE doc_id % 3 WHEN 0 THEN 'permissive' WHEN 1 THEN 'curated' ELSE 'open' END",
    "byte_size": "doc_id % 7 - 1", "sha256": "CASE WHEN doc_id % 2 = 0 THEN concat(md5(concat('b', doc_id % 90)), md5('tail')) ELSE md5(concat('b', doc_id % 90)) END",
    "verdict": "CASE doc_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' WHEN 2 THEN 'violate' ELSE 'maybe' END", "allen_bitset": "doc_id % 9000 - 100",
    "chunk_index": "doc_id % 11", "row_idx": "doc_id % 7", "col_idx": "doc_id % 5", "canonical_of": "CASE WHEN doc_id % 3 = 0 THEN concat('n/', doc_id % 97) ELSE 'n/0' END",
}
# registers whose checks need arrays, or words that are reserved in SQL: they have queries of their own
_APART = {"identity_proposal", "vector", "identity_edge"}


def _columns(register) -> list[str]:
    named = [*register.key, *register.required]
    for check in register.checks:
        named += [w for w in _SPECIAL if w in check] + [w for w in ("alias", "canonical", "target", "source", "parent_context", "context") if f" {w}" in f" {check}"]
    return list(dict.fromkeys(named))


def _log(register) -> str:
    """SQL of the log: every eleventh row lacks its first required column."""
    parts = []
    for i, c in enumerate(_columns(register)):
        value = _SPECIAL.get(c, f"concat('n/', doc_id % {97 + 4 * (i % 3)})")
        if register.required and c == register.required[0] and c not in _SPECIAL:
            value = f"CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE {value} END"
        parts.append(f"{value} AS {c}")
    entry = "CASE WHEN doc_id % 5 > 0 THEN doc_id END" if register.mode == "coalesce" else "doc_id"
    return f"SELECT {', '.join(parts)}, {entry} AS entry, doc_id AS seq FROM {{num}}"


def _sql(register, name: str) -> str:
    rules = [f"trim(CAST({c} AS VARCHAR)) <> ''" for c in register.required] + [f"coalesce({c}, false)" for c in register.checks]
    where = " AND ".join(rules) or "true"
    keys = ", ".join(register.key)
    if register.mode in ("append", "close"):
        return f"SELECT {keys}, entry FROM {{{name}}} WHERE {where}"
    best = "arg_min" if register.mode == "first" else "arg_max"
    return f"SELECT {keys}, {best}(entry, seq) AS entry FROM {{{name}}} WHERE {where} GROUP BY {keys}"


def _register(name: str) -> None:
    register, log = REGISTERS[name], f"log_{name}"
    sq.FIX[log] = _log(register)

    def run(v):
        good, _ = register.split(v(log))
        return register.read(good).select(*register.key, "entry")

    run.__name__, run.__doc__ = f"register_{name}", f"Accepted and folded requests of the register {name}."
    sq.query(_sql(register, log))(run)


for _name in REGISTERS:
    if _name not in _APART:
        _register(_name)


@sq.query("SELECT target_id, n_rejected FROM (SELECT source AS target_id, count(*) FILTER (doc_id % 11 = 0 OR doc_id % 3 = 2) AS n_rejected FROM {num} GROUP BY 1) WHERE n_rejected > 0")
def register_rejections(v):
    """Requests set aside by a register's rules, counted per source: a bad row doesn't fail its batch."""
    rows = v("num").select(
        F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.concat(F.lit("n/"), F.col("doc_id").cast("string"))).alias("iri"),
        F.when(F.col("doc_id") % 3 == 2, "open").otherwise("curated").alias("mode"), "source",
    )
    _, bad = REGISTERS["context"].split(rows)
    return bad.groupBy(F.col("source").alias("target_id")).agg(F.count("*").alias("n_rejected"))
