"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, so that they need no installed copy."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = os.path.dirname(os.path.abspath(__file__))
        place = tempfile.mkdtemp(prefix="veilspark-package-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{place}/veilspark", "zip", os.path.dirname(here), os.path.basename(here)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a fresh one is made if driver and executors are one machine; elsewhere that would lose data, so it's refused.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='veilspark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and reread: cuts lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(table: DataFrame) -> None:
    """Remove a table that ``stash`` gave and that nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        delete(table.sparkSession, path)


def clear_stash(spark: SparkSession) -> None:
    """Remove all tables that ``stash`` has written; results that still read them can't be read afterwards."""
    delete(spark, f"{shared_dir(spark)}/veilspark")


def timed_in_order(spark: SparkSession, files: list[str]) -> bool:
    """Give ``files`` ascending times of change, by which a stream reads them; False where the store takes none."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    if not paths:
        return True
    fs, first = paths[0].getFileSystem(spark._jsc.hadoopConfiguration()), int(time.time() - len(paths)) * 1000
    for i, path in enumerate(paths):
        fs.setTimes(path, first + 1000 * i, -1)
    return all(fs.getFileStatus(path).getModificationTime() == first + 1000 * i for i, path in enumerate(paths))


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
