"""Durable intermediate tables and joins that survive hot keys.

Intermediate results are Parquet tables in the folder that the session names in
``spark.checkpoint.dir``: every executor can read them, they cut lineage, and the loss of an
executor costs no recomputation of what lies before them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast after its rows were counted.
BROADCAST_ROWS = 200_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A local session without the setting gets a temporary folder of its own; a cluster without
    it is refused, because a machine's own folder isn't seen by the other machines.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    own = getattr(spark, "_prosescan_scratch", None)
    if own is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="prosescan-")
        spark._prosescan_scratch = own
    return own


def _new_folder(spark: SparkSession, label: str) -> str:
    """Name of a new folder that is deleted when the session's JVM ends."""
    path = f"{scratch_dir(spark)}/prosescan/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and return a DataFrame that reads it."""
    path = _new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Levels:
    """The levels of a frontier, each written once; one scan reads any number of them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder = spark, _new_folder(spark, label)
        self.paths: list[str] = []
        self.schema, self.written = None, 0

    def add(self, level: DataFrame, going: Column | None = None) -> tuple[DataFrame | None, int]:
        """Write the next level; a DataFrame that reads it, None if it has no rows, and the number of its rows for which ``going`` holds."""
        path = f"{self.folder}/{self.written}"
        self.written += 1
        rows = Observation()
        going = F.lit(True) if going is None else going
        level.observe(rows, F.count(F.lit(1)).alias("n"), F.count_if(going).alias("going")).write.parquet(path)
        self.schema = level.schema
        if not rows.get["n"]:
            return None, 0
        self.paths.append(path)
        return self.read([path]), rows.get["going"]

    def read(self, paths: list[str] | None = None) -> DataFrame:
        """All levels so far, or those at ``paths``."""
        paths = self.paths if paths is None else paths
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else left to a shuffle join.

    ``df`` must be cheap to count (a materialized table).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_by_frequency(left: DataFrame, right: DataFrame, keys: list[str], n: str, share: int = 2000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key and the key's row count ``n``.

    Keys with more than one ``share``-th of all rows are joined by broadcast: there are fewer
    than ``share`` of them, whatever the size of the data. The rest shuffles, and no remaining
    key is large enough to make a task slow. ``right`` must be materialized.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > F.lit(max(total // share, 1000))
    heavy = F.broadcast(right.where(hot))
    often = left.join(heavy, keys)
    rest = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti")
    return often.unionByName(rest.join(right.where(~hot), keys))


def trimmed(text: Column) -> Column:
    """``text`` without white space of any script at its ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+\z", "")
