"""Session-level plumbing: shared folder, lineage cuts, sorted numbering.

Nothing here keeps data on one machine: intermediate tables go to the folder the
cluster names in ``spark.checkpoint.dir`` and are read back from there, so a lost
executor costs at most the stage that it was running.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


SMALL = 1 << 18  # bytes of a compressed table that may be broadcast
_OWN: list[str] = []  # the folder made where the session names none


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; a local one is made only where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext.getCheckpointDir()
        path = held.rsplit("/", 1)[0] if held else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="claimweave-"))
        path = _OWN[0]
    return path.rstrip("/")


_ROOTS: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def remove_scratch() -> None:
    """Delete the intermediate tables of all operators; results that were not read yet need them, so this is for the end of a run."""
    while _ROOTS:
        spark, root = _ROOTS.pop()
        try:
            _delete(spark, root)
        except Exception:  # the session is gone: the folder's owner cleans up
            return


def _remove_at_exit(spark: SparkSession, root: str) -> None:
    _ROOTS.append((spark, root))


class Scratch:
    """Intermediate tables of one operator run, in the shared folder.

    ``keep`` writes a frame and returns it read back (lineage is cut there);
    ``drop`` removes tables that no later step needs.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/claimweave/{label}-{uuid.uuid4().hex}"
        self.count = 0
        _remove_at_exit(spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(_nullable(df.schema)).parquet(path)
        out._scratch_path = path
        return out

    def keep_counting(self, df: DataFrame, condition: str) -> tuple[DataFrame, int]:
        """``keep``, and the number of rows that meet a condition, counted while they are written."""
        seen = Observation()
        out = self.keep(df.observe(seen, F.count(F.when(F.expr(condition), 1)).alias("n")))
        return out, int(seen.get["n"])

    def sized(self, df: DataFrame) -> DataFrame:
        """``df``, a kept table, with the join strategy that its size allows: only up to ``SMALL`` bytes go through the driver.

        Left to itself Spark takes the compressed file for the size in memory, which is
        ten times that and more for names, so tables of the corpus would be gathered there.
        """
        where = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        held = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
        return df.hint("broadcast" if held <= SMALL else "merge")

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None) if df is not None else None
            if path:
                _delete(self.spark, path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def sorted_numbering(df: DataFrame, order: list[Column | str], scratch: Scratch, index: str = "ix") -> DataFrame:
    """Number all rows 0, 1, 2, ... in the given total order without a single-task window.

    The rows are range-partitioned (sampled splits, so a hot leading key is cut in
    several ranges by the following columns), numbered inside each partition, and
    shifted by the row counts of the earlier partitions. Only one count per
    partition is joined back; its size is the number of partitions.
    """
    local = df.repartitionByRange(*order).sortWithinPartitions(*order)
    shift = (1 << 33) - 1
    local = scratch.keep(local.select("*", F.monotonically_increasing_id().alias("_mid")))
    local_path = local._scratch_path
    parts = local.groupBy(F.shiftright("_mid", 33).alias("_part")).agg(F.count("*").alias("_n"))
    counts = sorted((r["_part"], r["_n"]) for r in parts.toLocalIterator())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    table = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    out = (
        local.withColumn("_part", F.shiftright("_mid", 33))
        .join(F.broadcast(table), "_part")
        .withColumn(index, F.col("_start") + F.col("_mid").bitwiseAND(F.lit(shift)))
        .drop("_part", "_start", "_mid")
    )
    out._scratch_path = local_path
    return out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
