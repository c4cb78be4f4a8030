"""Per-key results where a few keys hold most rows.

Heavy keys are found with a mergeable sketch that every task builds for its own rows
(``approx_top_k``), so detection needs one small value per task. Rows of heavy keys are
recognised by a broadcast join with that list, whose length is a parameter, and are
spread over salted groups before they are reduced; rows of the other keys take one
ordinary shuffle by key. The two results are united. The sketch only decides which
way a row goes: results are exact whatever it misses or adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, share: float = 0.005, most: int = 512) -> DataFrame:
    """``key`` values that hold about ``share`` of the rows or more; at most ``most`` of them."""
    capacity = max(10_000, 4 * most)
    got = df.where(F.col(key).isNotNull()).agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {most}, {capacity})").alias("top")
    )
    return got.select("n", F.explode("top").alias("t")).where(F.col("t.count") >= F.col("n") * share).select(F.col("t.item").alias(key))


def distinct_counts(
    df: DataFrame, group: str | list[str], key: str, item: str, salts: int = 64, share: float = 0.005, most: int = 512
) -> DataFrame:
    """Exact number of different ``item`` values per (``group``, ``key``): columns group, key, ``n``.

    ``group`` may be several columns; a key is heavy if it holds much of all rows, under
    whatever group. Defined cases: rows with a null group, key or item are left out;
    repeated rows count once; an empty table gives no rows.
    """
    group = [group] if isinstance(group, str) else group
    rows = df.select(*group, key, item).where(" and ".join(f"`{c}` is not null" for c in (*group, key, item)))
    heavy = F.broadcast(heavy_keys(rows, key, share, most).withColumn("_heavy", F.lit(True)))  # at most `most` rows
    tagged = rows.join(heavy, key, "left")
    light = tagged.where("_heavy is null").groupBy(*group, key).agg(F.count_distinct(item).alias("n"))
    salt = F.pmod(F.xxhash64(item), F.lit(salts)).cast("int").alias("_salt")
    parts = (
        tagged.where("_heavy").select(*group, key, item, salt)
        .groupBy(*group, key, "_salt").agg(F.count_distinct(item).alias("n"))
    )
    return light.unionByName(parts.groupBy(*group, key).agg(F.sum("n").alias("n")))
