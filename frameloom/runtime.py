"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (tests) a folder of
    our own is made, and removed when the driver ends. A cluster without such a folder is an error: its executors share no local one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="frameloom-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame, looped: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; survives the loss of executors.

    A checkpointed frame keeps the size that the optimizer expected of it. Joins multiply these, so in a loop they would square from round to
    round into numbers of millions of digits: with ``looped`` the frame starts without any, and sizes are taken at run time."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    done = df.checkpoint(eager=True)
    if not looped:
        return done
    plan = done._jdf.queryExecution().logical()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), done._jdf.schema(), False), spark)


def discard(df: DataFrame) -> None:
    """Remove the files of a frame that ``cut`` gave, once nothing that is still to be computed reads it."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def task_count(df: DataFrame) -> int:
    """Tasks for a stage of heavy Python work: as many as a shuffle has, and no fewer than twice the cores."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a variant of it that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def tidy(column):
    """Trim outer white space, lower-case, and turn the empty string into null."""
    return F.nullif(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), F.lit(""))
