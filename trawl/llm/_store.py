"""Intermediate tables and model files in the folder that all executors share."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made for sessions on one machine, by application.
_own_folders: dict[str, str] = {}
#: Drops the shuffle files of a job as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, as a full URI on Hadoop's default filesystem if it names none.  Where
    it is unset and everything runs in one process (tests, one machine), a folder of our own; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="trawl-shared-")
        folder = "file://" + _own_folders[app]
    return qualified(spark, folder).rstrip("/")


def qualified(spark: SparkSession, folder: str) -> str:
    """The URI that Hadoop takes ``folder`` for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


@atexit.register
def _remove_own_folders() -> None:
    for folder in _own_folders.values():
        shutil.rmtree(folder, ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *used: DataFrame | str) -> DataFrame:
    """Cut the lineage: ``df`` as a Parquet table in the shared folder, which outlives any executor.  Its shuffle
    files go at once, and so do ``used``, tables of written() or paths that nothing reads afterwards."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    discard(spark, *used)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(spark: SparkSession, *used: DataFrame | str) -> None:
    """Delete tables of written(), or paths, of the shared folder."""
    for x in used:
        path = spark._jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of (long, long) that are broadcast at most: 8 MB.
BROADCAST_ROWS = 500_000


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, with the hint to broadcast it if it has no more than ``rows`` rows; beyond that joins shuffle."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def filesystem(uri: str):
    """The pyarrow filesystem and path of a URI, on the driver or in a worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def save_arrays(uri: str, **arrays: np.ndarray) -> None:
    """One .npz file of the shared folder."""
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    # a retried task may write the same file again: write aside, then rename
    aside = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(buffer.getvalue())
    system.move(aside, path)


def load_arrays(uri: str) -> dict[str, np.ndarray]:
    system, path = filesystem(uri)
    with system.open_input_file(path) as f:
        loaded = np.load(io.BytesIO(f.read()))
        return {k: loaded[k] for k in loaded.files}


def save_columns(uri: str, **columns: np.ndarray) -> None:
    """One Arrow file of the shared folder, columns of one length."""
    table = pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out, pa.ipc.new_file(out, table.schema) as file:
        file.write_batch(table)
    system.move(aside, path)


def load_columns(uri: str) -> dict[str, np.ndarray]:
    """Mapped, not read, where the shared folder is a local path: workers of a machine share the pages."""
    system, path = filesystem(uri)
    source = pa.memory_map(path) if system.type_name == "local" else pa.py_buffer(system.open_input_file(path).read())
    table = pa.ipc.open_file(source).get_batch(0)
    return {k: table.column(i).to_numpy() for i, k in enumerate(table.schema.names)}


def files_of(uri: str) -> frozenset[str]:
    """Names of the files in a folder."""
    from pyarrow import fs

    system, path = filesystem(uri)
    return frozenset(f.base_name for f in system.get_file_info(fs.FileSelector(path)))
