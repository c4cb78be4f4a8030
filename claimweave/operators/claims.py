"""Bitemporal claims: matching, time travel, snapshots, write path, effective polarity.

A claims frame has ``statement_id, subject, predicate, object_iri, object_lit, context,
polarity, maturity, valid_lo, valid_hi, tx_lo, tx_hi``; ``object_lit`` is JSON text; a
null ``tx_hi`` means open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.scalars import contains_point, content_hash

COLUMNS = "statement_id subject predicate object_iri object_lit context polarity maturity valid_lo valid_hi tx_lo tx_hi".split()


def open_at(claims: DataFrame, as_of=None) -> DataFrame:
    """Rows believed now (open), or at a transaction time (half-open)."""
    if as_of is None:
        return claims.where("tx_hi is null")
    return claims.where(contains_point(F.col("tx_lo"), F.col("tx_hi"), F.lit(as_of).cast("timestamp")))


def match(
    claims: DataFrame, subject: str | None = None, predicate: str | None = None, object_iri: str | None = None,
    object_lit: str | None = None, scope: DataFrame | None = None, polarity: str | None = "asserted",
    min_maturity: int = 0, as_of_tx=None, as_of_valid=None,
) -> DataFrame:
    """Strict pattern match. ``scope`` is a frame with ``context``; None means every context, an empty one nothing."""
    out = open_at(claims, as_of_tx)
    for name, value in (("subject", subject), ("predicate", predicate), ("object_iri", object_iri), ("object_lit", object_lit), ("polarity", polarity)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if min_maturity:
        out = out.where(F.col("maturity") >= min_maturity)
    if as_of_valid is not None:
        out = out.where(contains_point(F.col("valid_lo"), F.col("valid_hi"), F.lit(as_of_valid).cast("date")))
    return out if scope is None else out.join(scope.select("context").distinct(), "context", "left_semi")


def match_aligned(claims: DataFrame, closure: DataFrame, predicate: str, min_confidence: float = 0.8, **filters) -> DataFrame:
    """Match a predicate and what the closure says is equivalent: direct, same-way and swapped rows.

    ``closure``: predicate, equivalent, relation, swap, confidence. Adds ``matched_via``
    and ``alignment_confidence``; the stored predicate is kept. Swapped rows exchange
    subject and object and exist for IRI objects only. Subject and object filters apply to
    the row as returned.
    """
    near = closure.where((F.col("predicate") == predicate) & (F.col("equivalent") != predicate) & (F.col("confidence") >= min_confidence))
    near = near.select(F.col("equivalent").alias("predicate"), "relation", "swap", F.col("confidence").alias("alignment_confidence"))
    want = {k: filters.pop(k, None) for k in ("subject", "object_iri")}
    base = match(claims, **filters)
    direct = base.where(F.col("predicate") == predicate).withColumns({"matched_via": F.lit("direct"), "alignment_confidence": F.lit(1.0)})
    joined = base.join(near, "predicate")  # closure rows of one predicate: broadcast by size if small
    same = joined.where("not swap").withColumn("matched_via", F.col("relation"))
    turned = joined.where("swap and object_iri is not null").withColumns(
        {"matched_via": F.col("relation"), "subject": F.col("object_iri"), "object_iri": F.col("subject")}
    )
    cols = [*claims.columns, "matched_via", "alignment_confidence"]
    out = direct.select(cols).unionByName(same.select(cols)).unionByName(turned.select(cols))
    for k, v in want.items():
        if v is not None:
            out = out.where(F.col(k) == v)
    return out


def snapshot(claims: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """``statement_id`` of the open statements in scope, all polarities: what a snapshot freezes."""
    return match(claims, scope=scope, polarity=None).select("statement_id").distinct()


def match_in_snapshot(claims: DataFrame, members: DataFrame, polarity: str | None = "asserted", min_maturity: int = 0) -> DataFrame:
    """Match over frozen members, whatever happened to them since."""
    out = claims.join(members.select("statement_id").distinct(), "statement_id", "left_semi")
    if polarity is not None:
        out = out.where(F.col("polarity") == polarity)
    return out.where(F.col("maturity") >= min_maturity)


def with_hash(claims: DataFrame) -> DataFrame:
    c = F.col
    return claims.withColumn(
        "content_hash",
        content_hash(c("subject"), c("predicate"), c("object_iri"), c("object_lit"), c("context"), c("polarity"), c("valid_lo"), c("valid_hi")),
    )


def assert_batch(claims: DataFrame, incoming: DataFrame, at: Column, curated: DataFrame | None = None, registered: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected rows) of a batch of assertions.

    A row equal in content to an open one, or to another of the batch, adds nothing; its
    maturity is not compared. Rows need exactly one object. In a ``curated`` context
    (frame with ``context``) the predicate must be ``registered`` (frame with
    ``predicate``). Ids derive from content and time, so a repeated run gives equal rows.
    """
    one = F.col("object_iri").isNull() != F.col("object_lit").isNull()
    named = F.col("subject").isNotNull() & F.col("predicate").isNotNull()
    ready = incoming.withColumns({
        "context": F.coalesce("context", F.lit("ctx:anonymous")), "polarity": F.coalesce(F.lower("polarity"), F.lit("asserted")),
        "maturity": F.coalesce("maturity", F.lit(0)),
    })
    good, bad = ready.where(one & named), ready.where(~F.coalesce(one & named, F.lit(False)))
    if curated is not None and registered is not None:
        held = good.join(curated.select("context").distinct(), "context", "left_semi").join(registered.select("predicate").distinct(), "predicate", "left_anti")
        free = good.join(curated.select("context").distinct(), "context", "left_anti")
        ok = good.join(curated.select("context").distinct(), "context", "left_semi").join(registered.select("predicate").distinct(), "predicate", "left_semi")
        good, bad = free.unionByName(ok), bad.unionByName(held, allowMissingColumns=True)
    hashed = with_hash(good).dropDuplicates(["content_hash"])
    fresh = hashed.join(with_hash(open_at(claims)).select("content_hash"), "content_hash", "left_anti")
    rows = fresh.withColumns({"tx_lo": at, "tx_hi": F.lit(None).cast("timestamp")})
    rows = rows.withColumn("statement_id", F.sha2(F.concat_ws("\x1f", "content_hash", F.col("tx_lo").cast("string")), 256))
    return rows.select(*COLUMNS), bad


def retract(claims: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Claims with the open rows among ``ids`` closed; closed rows and all others unchanged."""
    gone = ids.select("statement_id").distinct().withColumn("_gone", F.lit(True))
    return claims.join(gone, "statement_id", "left").withColumn(
        "tx_hi", F.when(F.col("tx_hi").isNull() & F.col("_gone"), at).otherwise(F.col("tx_hi"))
    ).drop("_gone")


def correct(claims: DataFrame, changes: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(claims with corrected rows closed, replacement rows): null fields of a change keep the old value.

    ``changes``: statement_id and any of subject, predicate, object_iri, object_lit,
    polarity. A new object of one kind replaces one of the other kind. Context, maturity
    and valid time are inherited.
    """
    have = set(changes.columns) - {"statement_id"}
    pick = lambda c: F.coalesce(F.col(f"n_{c}"), F.col(c)) if c in have else F.col(c)
    new = changes.select("statement_id", *[F.col(c).alias(f"n_{c}") for c in have])
    old = open_at(claims).join(new, "statement_id")
    n_iri = F.col("n_object_iri") if "object_iri" in have else F.lit(None).cast("string")
    n_lit = F.col("n_object_lit") if "object_lit" in have else F.lit(None).cast("string")
    fixed = old.select(
        pick("subject").alias("subject"), pick("predicate").alias("predicate"),
        F.when(n_lit.isNull(), F.coalesce(n_iri, F.col("object_iri"))).alias("object_iri"),
        F.when(n_iri.isNull() | n_lit.isNotNull(), F.coalesce(n_lit, F.col("object_lit"))).alias("object_lit"),
        "context", pick("polarity").alias("polarity"), "maturity", "valid_lo", "valid_hi",
    )
    shut = retract(claims, changes, at)
    added, _ = assert_batch(shut, fixed, at)
    return shut, added


def effective_polarity(claims: DataFrame) -> DataFrame:
    """Open rows with ``effective``: ``conflicting`` where another open row has the same subject, predicate, context and object but another polarity.

    One aggregate per object key and a join back, so a key with very many rows is
    reduced before it moves.
    """
    rows = open_at(claims)
    key = ["subject", "predicate", "context", "_object"]
    tagged = rows.withColumn("_object", F.coalesce(F.concat(F.lit("i"), "object_iri"), F.concat(F.lit("l"), "object_lit")))
    mixed = tagged.groupBy(*key).agg(F.min("polarity").alias("a"), F.max("polarity").alias("b")).where("a <> b").select(*key, F.lit(True).alias("_mixed"))
    return tagged.join(mixed, key, "left").withColumn("effective", F.when(F.col("_mixed"), "conflicting").otherwise(F.col("polarity"))).drop("_object", "_mixed")


def maturity_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Audit rows of a promotion batch: ``statement_id, from_maturity, to_maturity`` where they differ."""
    a = old.select("statement_id", F.col("maturity").alias("from_maturity"))
    b = new.select("statement_id", F.col("maturity").alias("to_maturity"))
    return a.join(b, "statement_id").where("from_maturity <> to_maturity")


def promote(claims: DataFrame, ids: DataFrame, target_context: str, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims with originals closed, copies in the target context, lineage rows) for candidate statements."""
    chosen = open_at(claims).join(ids.select("statement_id").distinct(), "statement_id", "left_semi")
    copies, _ = assert_batch(claims, chosen.withColumn("context", F.lit(target_context)).drop("statement_id", "tx_lo", "tx_hi"), at)
    key = ["subject", "predicate", "polarity"]
    pair = chosen.select(F.col("statement_id").alias("source_stmt"), *key, F.coalesce("object_iri", "object_lit").alias("_o"))
    lineage = copies.select("statement_id", *key, F.coalesce("object_iri", "object_lit").alias("_o")).join(pair, [*key, "_o"]).select("statement_id", "source_stmt")
    return retract(claims, chosen, at), copies, lineage
