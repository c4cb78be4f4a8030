"""Queries of the training-data problems tagged llm (3, 7, 8, 9, 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import groups, leaks, names, packing, reading
from claimweave.plans.runtime import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every IRI linked to another one by exact equivalence, with its group's smallest IRI."""
    kind = F.lower(F.regexp_replace("relation", r"[^A-Za-z]", ""))
    end = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).alias(c)
    links = table(spark, folder, "alignments").where(kind == "exactequivalent").select(end("source"), end("target"))
    return groups.connected_groups(links, "source", "target").select(F.col("node").alias("iri"), F.col("group_id").alias("group_iri"))


def name_records(spark: SparkSession, folder: str) -> DataFrame:
    """``key, name, hint`` of all name records."""
    kind = F.lower("kind")
    ents = table(spark, folder, "entities").select(
        F.concat(F.lit("entities:"), "id").alias("key"), F.col("label").alias("name"),
        F.when(kind == "person", "person").when(kind.startswith("org"), "org").otherwise("any").alias("hint"),
    )
    claims = table(spark, folder, "claims").where(F.col("predicate").isin(names.PERSON_CLAIMS + names.ORG_CLAIMS)).select(
        F.concat(F.lit("claims:"), F.col("claim_id").cast("string")).alias("key"), F.col("object").alias("name"),
        F.when(F.col("predicate").isin(names.PERSON_CLAIMS), "person").otherwise("org").alias("hint"),
    )
    made = r"^ex:(person|org)/[^0-9]*[A-Za-z][^0-9]*$"
    subjects = table(spark, folder, "statements").where(F.col("subject").rlike(made)).select("subject").distinct()
    stmts = subjects.select(F.concat(F.lit("statements:"), "subject").alias("key"), F.col("subject").alias("name"), F.lit("any").alias("hint"))
    return ents.unionByName(claims).unionByName(stmts)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of name records that mean the same person or institution."""
    return names.linked_pairs(names.link_names(name_records(spark, folder)))


def p8_packing(spark: SparkSession, folder: str, capacity: int = 2_048) -> DataFrame:
    """Container of every document text, or of its pieces where it is larger than a container."""
    counts = packing.token_counts(table(spark, folder, "documents"))
    return packing.pack(counts, capacity).select("doc_id", "version", "piece", "n_tokens", "container")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks with the extent of each."""
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least half of a test item's words in one stretch."""
    return p9_leaks(spark, folder).select("doc_id", "item_id").distinct()


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Reading grade and band of every document row."""
    docs = table(spark, folder, "documents")
    return reading.reading_level(docs, reading.fit_model(docs))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents mostly written for first readers (1) or for scholars (3)."""
    return p10_levels(spark, folder).where("band in (1, 3)").select("doc_id", "band").distinct()


def p10_cross_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Mean absolute error of calibrated out-of-fold grades per source, beside that of the sentence's own index and of a constant."""
    model = reading.fit_model(table(spark, folder, "documents"))
    rows = [(s, n, *(round(v, 4) for v in errors)) for s, n, *errors in model.sources]
    return spark.createDataFrame(rows, "source string, n_sentences int, abs_error double, abs_error_index double, abs_error_constant double, bias double")
