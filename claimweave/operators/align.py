"""Predicate alignment: closure, canonical predicates, lexical and vector suggestions, shadows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.functions.scalars import cosine, local_words, trigram_similarity, trigrams

# Relation names that enter the closure, in order of precedence after "self".
RELATIONS = ["exact_equivalent", "inverse_equivalent", "sub_property_of", "close_match"]
CLOSE_FLOOR = 0.8


def closure(predicates: DataFrame, alignments: DataFrame) -> DataFrame:
    """One-hop equivalences ``predicate, equivalent, relation, swap, confidence``, one row per pair.

    ``predicates``: iri, status, canonical_of, inverse_of. ``alignments``: source, target,
    relation, confidence, tx_hi (open rows count). Exact and close relations work both
    ways, inverse ones both ways with subject and object swapped, a sub-property only
    answers for its parent. Of several reasons for a pair the first kind in order wins,
    then the highest confidence.
    """
    edge = lambda a, b, rel, swap, conf, rank: F.struct(
        F.col(a).alias("predicate"), F.col(b).alias("equivalent"), F.lit(rel).alias("relation"), F.lit(swap).alias("swap"),
        (F.col(conf) if isinstance(conf, str) else F.lit(conf)).cast("double").alias("confidence"), F.lit(rank).alias("rank"),
    )
    open_ = alignments.where("tx_hi is null and source is not null and target is not null")
    both = lambda rel, swap, rank: F.when(
        F.col("relation") == rel, F.array(edge("source", "target", rel, swap, "confidence", rank), edge("target", "source", rel, swap, "confidence", rank + 1))
    )
    per_row = F.coalesce(
        both("exact_equivalent", False, 1), both("inverse_equivalent", True, 3),
        F.when(F.col("relation") == "sub_property_of", F.array(edge("target", "source", "sub_property_of", False, "confidence", 5))),
        F.when(F.col("confidence") >= CLOSE_FLOOR, both("close_match", False, 6)),
    )
    parts = [
        predicates.where(F.col("status").isin("active", "implicit")).select(F.inline(F.array(edge("iri", "iri", "self", False, 1.0, 0)))),
        open_.select(F.inline(per_row)),
        predicates.where("canonical_of <> iri").select(F.inline(F.array(
            edge("canonical_of", "iri", "exact_equivalent", False, 1.0, 8), edge("iri", "canonical_of", "exact_equivalent", False, 1.0, 9)))),
        predicates.where("inverse_of <> iri").select(F.inline(F.array(
            edge("iri", "inverse_of", "inverse_equivalent", True, 1.0, 10), edge("inverse_of", "iri", "inverse_equivalent", True, 1.0, 11)))),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = rows.groupBy("predicate", "equivalent").agg(
        F.min(F.struct("rank", F.negative(F.coalesce("confidence", F.lit(-1.0))).alias("c"), "relation", "swap", "confidence")).alias("b")
    )
    return best.select("predicate", "equivalent", "b.relation", "b.swap", "b.confidence")


def canonical_predicate(rows: DataFrame, predicates: DataFrame, column: str = "predicate", out: str = "canonical") -> DataFrame:
    """Adds the canonical predicate, or the predicate itself when none is known."""
    known = predicates.where("canonical_of is not null").groupBy(F.col("iri").alias(column)).agg(F.min("canonical_of").alias("_c"))
    return rows.join(known, column, "left").withColumn(out, F.coalesce("_c", column)).drop("_c")


def canonical_at(rows: DataFrame, aliases: DataFrame, predicates: DataFrame, day: str = "day") -> DataFrame:
    """Canonical predicate on each row's date: a dated alias that holds then, else the timeless one, else itself.

    Of several dated aliases a bounded end is preferred, then a bounded start, then the
    smaller IRI. Rows have ``predicate`` and the day column.
    """
    a = aliases.select(F.col("alias").alias("predicate"), F.col("canonical").alias("_dated"), F.col("valid_lo").alias("_lo"), F.col("valid_hi").alias("_hi"))
    keyed = rows.select("predicate", day).distinct()
    on = (F.col("_lo").isNull() | (F.col("_lo") <= F.col(day))) & (F.col("_hi").isNull() | (F.col(day) < F.col("_hi")))
    best = keyed.join(a, "predicate").where(on).groupBy("predicate", day).agg(
        F.min(F.struct(F.col("_hi").isNull().alias("x"), F.col("_lo").isNull().alias("y"), "_dated")).alias("b")
    ).select("predicate", day, F.col("b._dated").alias("_dated"))
    out = canonical_predicate(rows.join(best, ["predicate", day], "left"), predicates, out="_timeless")
    return out.withColumn("canonical", F.coalesce("_dated", "_timeless")).drop("_dated", "_timeless")


def match_canonical(claims: DataFrame, predicates: DataFrame, predicate: str) -> DataFrame:
    """Open asserted rows whose predicate has the same canonical predicate as the given one."""
    spark = claims.sparkSession
    want = canonical_predicate(spark.createDataFrame([(predicate,)], "predicate string"), predicates).select("canonical")
    return canonical_predicate(claims.where("tx_hi is null and polarity = 'asserted'"), predicates).join(want, "canonical", "left_semi").drop("canonical")


def lexical_pairs(predicates: DataFrame, least: float = 0.3) -> DataFrame:
    """``a, b, similarity`` of predicate pairs (a < b) whose names share 3-grams enough.

    Pairs meet on a 3-gram of their names that is rare enough to be among the first
    ``n - ceil(least * n) + 1`` in order of rarity (prefix filter), so no pair above the
    threshold is lost and frequent 3-grams join nothing needlessly.
    """
    named = predicates.select("iri", local_words(F.col("iri")).alias("words")).distinct()
    grams = named.select("iri", F.explode(trigrams(F.col("words"))).alias("gram"))
    rarity = grams.groupBy("gram").agg(F.count("*").alias("n"))
    ranked = grams.join(rarity, "gram").groupBy("iri").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("g"))
    size = F.size("g")
    prefix = F.slice("g", F.lit(1), (size - F.ceil(F.lit(least) * size) + 1).cast("int"))
    keyed = ranked.select("iri", F.explode(prefix).alias("p")).select("iri", F.col("p.gram").alias("gram"))
    met = keyed.select(F.col("iri").alias("a"), "gram").join(keyed.select(F.col("iri").alias("b"), "gram"), "gram").where("a < b").select("a", "b").distinct()
    words = named.select(F.col("iri").alias("k"), "words")
    full = met.join(words.select(F.col("k").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("k").alias("b"), F.col("words").alias("wb")), "b")
    return full.select("a", "b", trigram_similarity(F.col("wa"), F.col("wb")).alias("similarity")).where(F.col("similarity") >= least)


def suggest_alignments(predicates: DataFrame, alignments: DataFrame, source: str, least: float = 0.3, limit: int = 10) -> DataFrame:
    """Best lexical matches of one predicate that are not aligned with it yet, either way."""
    spark = predicates.sparkSession
    words = spark.createDataFrame([(source,)], "iri string").select(local_words(F.col("iri")).alias("w0"))
    others = predicates.where(F.col("iri") != source).select("iri", local_words(F.col("iri")).alias("w")).distinct()
    scored = others.join(F.broadcast(words)).select(F.col("iri").alias("target"), trigram_similarity(F.col("w0"), F.col("w")).alias("similarity"))  # one row
    done = alignments.where(F.col("source") == source).select(F.col("target")).unionByName(alignments.where(F.col("target") == source).select(F.col("source").alias("target")))
    return scored.where(F.col("similarity") >= least).join(done.distinct(), "target", "left_anti").orderBy(F.desc("similarity"), "target").limit(limit)


def auto_align(predicates: DataFrame, alignments: DataFrame, least: float = 0.6) -> DataFrame:
    """Best partner of each predicate as close matches ``source, target, relation, confidence``.

    Set-based: one row per unordered pair that is the best choice of either side and not
    aligned yet, instead of one source after another.
    """
    pairs = lexical_pairs(predicates, least)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    done = alignments.select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).distinct()
    free = both.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(done, ["lo", "hi"], "left_anti")
    best = free.groupBy("a").agg(F.min(F.struct(F.negative("similarity").alias("s"), "b")).alias("m"))
    return best.select(F.least("a", "m.b").alias("source"), F.greatest("a", "m.b").alias("target"), F.lit("close_match").alias("relation"), (-F.col("m.s")).alias("confidence")).distinct()


def nearest_vectors(vectors: DataFrame, query: list[float], limit: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Top-k by cosine to a query vector; vectors without a cosine come last, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(id_col), cosine(F.col(vec_col).cast(T.ArrayType(T.DoubleType())), q).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc_nulls_last(), id_col).limit(limit)


def shadows(claims: DataFrame, closure_rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Canonical form of every open claim: predicate over exact closure rows, subject and object over entity aliases.

    Among exact equivalents the smallest IRI (itself included) stands for all.
    """
    exact = closure_rows.where("relation = 'exact_equivalent'").groupBy("predicate").agg(F.min("equivalent").alias("eq"))
    canon = exact.select("predicate", F.least("predicate", "eq").alias("canonical_predicate"))
    best = resolve_aliases(aliases)
    out = claims.where("tx_hi is null").join(canon, "predicate", "left")
    for col in ("subject", "object_iri"):
        out = out.join(best.select(F.col("alias").alias(col), F.col("canonical").alias(f"_{col}")), col, "left")
    return out.select(
        "statement_id", F.coalesce("canonical_predicate", "predicate").alias("canonical_predicate"),
        F.coalesce("_subject", "subject").alias("canonical_subject"), F.coalesce("_object_iri", "object_iri").alias("canonical_object_iri"), "object_lit",
    )


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """``alias, canonical``: the canonical entity of greatest confidence per alias, ties to the smaller IRI."""
    return aliases.groupBy("alias").agg(F.min(F.struct(F.negative(F.coalesce("confidence", F.lit(0.0))).alias("c"), "canonical")).alias("b")).select("alias", "b.canonical")


def decompose_to_frame(claims: DataFrame, frame_type: str) -> DataFrame:
    """Binary IRI claims as event frames: rdf:type, subject and object statements of a derived frame IRI."""
    frame = F.concat(F.lit("claim:frame/"), F.sha2(F.concat_ws("\x1f", "subject", "predicate", "object_iri", "context"), 256))
    parts = F.array(
        F.struct(F.lit("rdf:type").alias("p"), F.lit(frame_type).alias("o")),
        F.struct(F.concat("predicate", F.lit("/subject")).alias("p"), F.col("subject").alias("o")),
        F.struct(F.concat("predicate", F.lit("/object")).alias("p"), F.col("object_iri").alias("o")),
    )
    rows = claims.where("object_iri is not null").select(frame.alias("subject"), "context", F.explode(parts).alias("r"))
    return rows.select("subject", F.col("r.p").alias("predicate"), F.col("r.o").alias("object_iri"), "context").distinct()
