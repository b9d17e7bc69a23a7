"""Session helpers: tables, the shared folder, lineage cuts and code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDERS: dict[str, str] = {}


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below the one that all executors share, spark.checkpoint.dir. It's deleted when the application ends, or by ``release``.

    Only a local master may do without that setting; it gets a temporary folder. Elsewhere every executor would write to a disk of its own.
    """
    context = spark.sparkContext
    found = _FOLDERS.get(context.applicationId)
    if found is None:
        root = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tamisol.shared.dir", None)
        if not root:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = "file://" + tempfile.gettempdir()
        found = _FOLDERS[context.applicationId] = f"{root.rstrip('/')}/tamisol-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        fs, place = _file_system(spark, found)
        fs.mkdirs(place)
        fs.deleteOnExit(place)
    return found


def release(spark: SparkSession) -> None:
    """Delete all that ``materialise`` has written for this application; results that weren't read yet can't be read any more."""
    found = _FOLDERS.pop(spark.sparkContext.applicationId, None)
    if found:
        fs, place = _file_system(spark, found)
        fs.delete(place, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder of files, on whatever file system it lies."""
    fs, place = _file_system(spark, path)
    return fs.exists(place) and fs.getFileStatus(place).isDirectory()


def materialise(df: DataFrame, what: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage in a way that survives the loss of executors.

    It runs at once, so a query that uses it starts its work while it is being built.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they were started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tamisol-zip-"), "tamisol.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("tamisol", os.path.relpath(full, root)))
    context.addPyFile(path)
    atexit.register(shutil.rmtree, os.path.dirname(path), ignore_errors=True)  # executors that come later fetch it from here
    _SHIPPED.add(context.applicationId)
