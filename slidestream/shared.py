"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. In local mode, where driver and executors are one process, a temporary folder serves
    if none is named; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="slidestream-")
        shared_dir.own = path
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Gives this package's modules to Python workers, unless the search path that they inherit has it. Once for a Spark context."""
    package, sc = Path(__file__).resolve().parent, spark.sparkContext
    on_path = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if package.parent in on_path or getattr(sc, "_slidestream", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="slidestream-")) / "slidestream.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))  # the driver serves it to executors
    sc._slidestream = True


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a folder that isn't there yet."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that ``new_folder`` named, and all in it; no folder is no error. Rows that are still to be read from it are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of at most a few numbers that may be broadcast.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which must be computed already (see ``cut``), marked for broadcast if it has so few rows; else as it is, for a join of
    exchanges, whose skewed partitions Spark splits."""
    return F.broadcast(df) if df.count() <= max_rows else df
