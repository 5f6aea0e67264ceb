"""Session helpers: table loading and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; lazy, so that filters and columns still reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of this application's checkpoints, under the one that spark.checkpoint.dir names.

    A session on one machine without that setting, as in tests, gets a temporary folder, removed at its end. A cluster
    without it is an error: executors could not read each other's local folders.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and continue from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> str:
    """Write df once to the shared checkpoint folder; tasks read it with stored_batches, so rows that many tasks need are not shuffled to each."""
    path = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stored_batches(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """What stored wrote, in batches of at most `rows`; runs in tasks, on the folder that all executors share."""
    local = re.match(r"^(file:)?/+(?=[^/])", path)
    system, root = (fs.LocalFileSystem(), "/" + path[local.end() :]) if local else fs.FileSystem.from_uri(path)
    for name in sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")):
        with system.open_input_file(name) as file:
            yield from parquet.ParquetFile(file).iter_batches(rows)


def remove_checkpoints(spark: SparkSession) -> None:
    """Delete all that this application has checkpointed; for the end of a job, when its results are written.

    While it runs, spark.cleaner.referenceTracking.cleanCheckpoints lets Spark drop what no plan refers to any more.
    """
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(known.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
