"""Units and their conversion through a common base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Unit, dimension, factor to the dimension's base (null factor: a base itself).
UNITS = [
    ("unit:ratio", "ratio", None), ("unit:accuracy", "ratio", 1.0), ("unit:percent", "ratio", 0.01), ("unit:bleu", "score", None), ("unit:f1", "ratio", 1.0),
    ("unit:second", "time", None), ("unit:millisecond", "time", 1e-3), ("unit:microsecond", "time", 1e-6), ("unit:nanosecond", "time", 1e-9),
    ("unit:attosecond", "time", 1e-18), ("unit:femtosecond", "time", 1e-15), ("unit:meter", "length", None), ("unit:nanometer", "length", 1e-9),
    ("unit:angstrom", "length", 1e-10), ("unit:kelvin", "temperature", None), ("unit:celsius", "temperature", 1.0), ("unit:ev", "energy", None),
    ("unit:joule", "energy", None), ("unit:usd", "currency", None), ("unit:eur", "currency", None), ("unit:year", "time", 31557600.0),
    ("unit:day", "time", 86400.0), ("unit:hour", "time", 3600.0), ("unit:kilogram", "mass", None), ("unit:gram", "mass", 0.001), ("unit:milligram", "mass", 1e-6),
]


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNITS, "unit string, dimension string, factor double")


def convert(rows: DataFrame, value: str = "value", source: str = "from_unit", target: str = "to_unit", out: str = "converted") -> DataFrame:
    """Adds the converted value; null for unknown units or different dimensions.

    A unit without factor counts as a base with factor 1; temperatures convert by factor alone.
    """
    u = units(rows.sparkSession).withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    a = u.select(F.col("unit").alias(source), F.col("dimension").alias("_d1"), F.col("factor").alias("_f1"))
    b = u.select(F.col("unit").alias(target), F.col("dimension").alias("_d2"), F.col("factor").alias("_f2"))
    got = rows.join(F.broadcast(a), source, "left").join(F.broadcast(b), target, "left")  # a fixed list of units
    return got.withColumn(out, F.when(F.col("_d1") == F.col("_d2"), F.col(value) * F.col("_f1") / F.col("_f2"))).drop("_d1", "_d2", "_f1", "_f2")
