"""Session helpers.

Intermediate data go to the folder that ``spark.checkpoint.dir`` names.  Without
the setting only a local master, whose executors are this very process, gets a
fresh folder; on a cluster its absence is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Only takes effect when this process starts the JVM (local runs, tests).
    "spark.driver.memory": "8g",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "logweave",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    checkpoint_dir(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) \
        or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="logweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def checkpoint_dir(spark: SparkSession) -> str:
    path = shared_folder(spark)
    spark.sparkContext.setCheckpointDir(path)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once an application: on a cluster it need not be installed, and
    on a local master a program may run from any folder."""
    import shutil

    import logweave
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.dirname(os.path.abspath(logweave.__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="logweave-src-"), "logweave"), "zip", root, "logweave")
    spark.sparkContext.addPyFile(archive)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back (never localCheckpoint).  As a table it is compressed,
    read by columns, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if planned_bytes(out) >= FREED_BYTES:
        free_shuffles(spark)
    return out


#: Bytes of a written table from which the shuffles that made it are given up at once.
FREED_BYTES = 32 << 20


def planned_bytes(df: DataFrame) -> int:
    """Bytes of ``df`` as the planner puts them: those of its files, if it was just written."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sent(df: DataFrame, most: int) -> DataFrame:
    """A just written table for a join: sent to every task if its files hold no more than ``most`` bytes (compressed: several times that in memory)."""
    return broadcast(df) if planned_bytes(df) <= most else df


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the files of a finished job's shuffles once the driver has collected the objects that stand for them; a driver
    with memory to spare may not come to that for an hour, and they would pile up."""
    spark.sparkContext._jvm.java.lang.System.gc()


#: Bytes of input a core below which a table is dealt to all cores before costly work on its rows.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if the planner puts it under ``SPREAD_BYTES`` a core: a small file may be one
    unsplittable piece.  Larger tables come in splits of their own and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if planned_bytes(df) < SPREAD_BYTES * cores else df
