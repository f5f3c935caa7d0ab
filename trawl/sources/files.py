"""Files as rows, and results as text or JSON."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators.chunkers import run_command


def read_files(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """(path, mod_time_ns, file_length, content BINARY, content_hash) of files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(list(paths))
    return found.select(
        "path",
        (F.unix_micros("modificationTime") * 1000).alias("mod_time_ns"),
        F.col("length").alias("file_length"),
        "content",
        F.sha2("content", 256).alias("content_hash"),
    )


def list_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, mod_time_ns, file_length): contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return found.select("path", (F.unix_micros("modificationTime") * 1000).alias("mod_time_ns"), F.col("length").alias("file_length"))


def valid_text(content: Column) -> Column:
    """Bytes as text; invalid UTF-8 is an error."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.raise_error(F.lit("a text is not valid UTF-8")))


def chunked_by_command(files: DataFrame, command: str) -> DataFrame:
    """(path, pos, location, content) of files, as printed by a command that every executor can run on the path."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                local = path.removeprefix("file:").replace("///", "/", 1)
                rows = run_command(command, local)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()),
                        pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                    ],
                    ["path", "pos", "location", "content"],
                )

    return files.select("path").mapInArrow(run, "path string, pos int, location string, content string")


def scratch_folder(spark: SparkSession) -> str:
    """A folder that all executors share: ``spark.checkpoint.dir``, or where that is unset and everything runs in one
    process a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="trawl-")


def as_lines(results: DataFrame, scores: bool = False) -> DataFrame:
    """(value): "path:location" of each result, with its score to four places if wanted."""
    place = F.concat_ws(":", "path", "location")
    return results.select((F.format_string("%s\t%.4f", place, F.col("score")) if scores else place).alias("value"))


def as_json(chunks: DataFrame) -> DataFrame:
    """(value): one JSON object a chunk."""
    return chunks.select(F.to_json(F.struct("path", F.col("location").alias("range"), "content", "index", "attrs")).alias("value"))
