"""Session helpers: reading tables, cutting lineage, sizing by input."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the catalogue, its files in the shared folder; a table of that name is replaced."""
    df.write.mode("overwrite").option("path", shared_folder(df.sparkSession, name)).saveAsTable(name)
    return df.sparkSession.table(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a plain local session, where it is unset, gets a temporary one, which goes
    with the process."""
    global _temporary
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _temporary is None:
            _temporary = tempfile.mkdtemp(prefix="weftline-shared-")
            atexit.register(shutil.rmtree, _temporary, ignore_errors=True)
        folder = _temporary
    return folder


_temporary: str | None = None


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{_shared_base(spark)}/weftline-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = _shared_base(spark)
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df written as a table into the shared folder, which takes the place of another such table.

    For rounds of a loop: a checkpoint carries its plan's estimated size, which joins multiply from round to round, while
    a written table has the size of its files.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._weftline_folder = folder
    if instead_of is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(instead_of._weftline_folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out


def buckets_for(rows: int, per_bucket: int, least: int = 1) -> int:
    """Number of buckets so that a bucket holds about per_bucket rows, whatever the input's size."""
    return max(least, math.ceil(rows / per_bucket))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run; once a context."""
    context = spark.sparkContext
    if getattr(context, "_weftline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="weftline-package-")) / "weftline.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._weftline_shipped = True
