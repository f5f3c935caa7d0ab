"""Streams of chunks and of files into a database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.database import Database
from trawl.functions.text import chunk_hash
from trawl.operators.chunkers import chunked_lines


def new_chunks(stream: DataFrame, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """(path, pos, location, content, chunk_id) of a stream of texts (path, text), each content once.

    With a watermark on ``time`` the contents remembered are those of that span; without one, all."""
    if watermark:
        rows = chunked_lines(stream.withWatermark(time, watermark).select("path", time, "text"))
        return rows.withColumn("chunk_id", chunk_hash(F.col("content"))).dropDuplicatesWithinWatermark(["chunk_id"])
    return chunked_lines(stream.select("path", "text")).withColumn("chunk_id", chunk_hash(F.col("content"))).dropDuplicates(["chunk_id"])


def ingest(stream: DataFrame, db: Database, checkpoint: str, strategy: str = "line"):
    """Starts a query that adds each micro-batch of files (path, content) as a segment.  Files that are there already
    are replaced, so a batch that is run again does no harm."""

    def add(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates(["path"]).persist()
        try:
            known = batch.join(db.files.select("path"), "path", "left_semi")
            fresh = batch.join(db.files.select("path"), "path", "left_anti")
            if not known.isEmpty():
                db.reindex(known, strategy)
            if not fresh.isEmpty():
                db.add(fresh, strategy)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
