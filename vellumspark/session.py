"""Making the package importable on executors, and tables in the folder that all of them share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, unless PYTHONPATH already leads to it."""
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if str(_ROOT.parent) in paths or getattr(context, "_vellum_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="vellum-package-")) / "vellumspark.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(_ROOT.rglob("*.py")):
            out.write(p, p.relative_to(_ROOT.parent))
    context.addPyFile(str(target))
    context._vellum_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, with its scheme.

    Where the session has none and runs on one machine (tests), a temporary folder is made once and set as the
    checkpoint folder; on a cluster that is an error, since every machine would have a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="vellum-")
        spark.sparkContext.setCheckpointDir(base)
    return qualified(spark, f"{base.rstrip('/')}/vellum")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark resolves it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: the lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.vellum_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.vellum_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_order(df: DataFrame, order: list, name: str, parts: int | None = None) -> DataFrame:
    """Sort by ranges and write; adds ``nth``, a row's place in the whole order, from 0.

    The last key should tell all rows apart, so that equal rows can lie in several ranges.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # monotonically_increasing_id holds the partition above 33 bits of the place in it.
    rows = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    return counted(rows)


def counted(df: DataFrame) -> DataFrame:
    """Replace ``__at``, a written monotonically_increasing_id, by ``nth``, which has no gaps."""
    part = F.shiftright("__at", 33)
    sizes = df.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    # One row per partition of the written table.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    out = df.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    out = out.withColumn("nth", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__before", "__at")
    out.vellum_path = df.vellum_path
    return out
