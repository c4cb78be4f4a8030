"""Text search over literals and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def match_text(rows: DataFrame, text: Column, query: str) -> DataFrame:
    """Rows whose text holds every word of the query and none of those after a minus, with ``score``.

    Quoted words must stand in that order next to each other. The score is the share of
    the text's words that are query words; there is no stemming.
    """
    phrases = [p for i, p in enumerate(query.split('"')) if i % 2]
    words = [w for i, p in enumerate(query.split('"')) for w in p.lower().split()]
    want, ban = [w for w in words if not w.startswith("-")], [w[1:] for w in words if w.startswith("-") and len(w) > 1]
    out = rows.withColumn("_words", tokens(text))
    for w in want:
        out = out.where(F.array_contains("_words", w))
    for w in ban:
        out = out.where(~F.array_contains("_words", w))
    for p in phrases:
        out = out.where(F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")).contains(f" {' '.join(p.lower().split())} "))
    hits = F.size(F.filter("_words", lambda w: w.isin(want))) if want else F.lit(0)
    return out.withColumn("score", hits / F.nullif(F.size("_words"), F.lit(0))).drop("_words")


def label_search(claims: DataFrame, labels: DataFrame, needle: str) -> DataFrame:
    """``subject, label, n`` of subjects with a label that contains the text: the shortest label (ties: the smaller), open rows.

    ``labels``: subject, label.
    """
    hit = labels.where(F.lower("label").contains(needle.lower())).groupBy("subject").agg(F.min(F.struct(F.length("label").alias("l"), "label")).alias("m"))
    counts = claims.where("tx_hi is null").groupBy("subject").agg(F.count("*").alias("n"))
    return hit.join(counts, "subject", "left").select("subject", F.col("m.label").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))
