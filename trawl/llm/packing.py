"""Packing along a space-filling curve.

Every document becomes a hashed bag-of-words vector, is projected to a few dimensions and gets the key of its
place on a Hilbert curve through them.  Documents, range-sorted by that key, are laid end to end and the line is
cut every ``capacity`` words, so each pack holds neighbours of the curve and only the last pack is not full.

The place of a document on the line is a prefix sum, taken in two levels: over ranges of about equally many
documents, and within a range.  Ranges are of (key, doc_id, length), so one key that very many documents have is
split like any other; no task sees more than a range's (key, id, length) rows; texts are never shuffled.

Defined results: a null text, or one without words, has nothing to pack and is in no pack; a text longer than a
pack runs on over several; equal keys follow by doc_id (nulls first); repeated rows are packed as often as they
occur; an empty table gives no pack; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawl.llm._store import written
from trawl.llm._text import Words, encoded_chunks

WIDTH = 256  #: of the hashed vectors


def projection(dims: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).standard_normal((WIDTH, dims))


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows, dims), by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            has = (x[i] & q) != 0
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(has, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def keys_of(texts: list[bytes], dims: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hilbert key and number of words of each text."""
    words = Words(texts)
    n = np.diff(words.bounds)
    h = words.hashes
    cell = words.text_of_word() * WIDTH + (h & np.uint64(WIDTH - 1)).astype(np.int64)
    sign = ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1
    v = np.bincount(cell, sign, len(texts) * WIDTH).reshape(-1, WIDTH)
    v = np.sign(v) * np.sqrt(np.abs(v))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    # a coordinate of a unit vector is about standard normal here: its distribution function spreads it evenly
    u = 1 / (1 + np.exp(-1.702 * (v @ projection(dims))))
    return hilbert_key(np.minimum((u * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits), n


def place(docs: DataFrame, dims: int = 4, bits: int = 12) -> DataFrame:
    """(doc_id, key, n_words) of each row of ``docs``."""

    def run(batches):
        for batch in batches:
            for a, b, texts in encoded_chunks(batch.column(1)):
                key, n = keys_of(texts, dims, bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(key), pa.array(n.astype(np.int64))], ["doc_id", "key", "n_words"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key long, n_words long")


#: Documents of a range.
RANGE_ROWS = 1 << 19


def pack(docs: DataFrame, capacity: int = 2048, dims: int = 4, bits: int = 12) -> DataFrame:
    """Packs of ``capacity`` words: (pack_id, n_words, doc_ids, starts, lengths), the last three being parallel
    arrays: words [start, start + length) of that document, in the order of the curve."""
    placed = written(place(docs, dims, bits).where("n_words > 0"), "placed")
    ranges = max(8, -(-placed.count() // RANGE_ROWS))
    order = ["key", "doc_id", "n_words"]
    placed = written(placed.repartitionByRange(ranges, *order).withColumn("bucket", F.spark_partition_id()), "line", placed)
    # a row for each range
    before = placed.groupBy("bucket").agg(F.sum("n_words").alias("n")).withColumn(
        "base", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    line = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = (
        placed.withColumn("inner", F.coalesce(F.sum("n_words").over(line), F.lit(0)))
        .join(F.broadcast(before.select("bucket", "base")), "bucket")
        .withColumn("offset", F.col("base") + F.col("inner"))
    )
    pieces = at.select(
        "doc_id", "offset", "n_words",
        F.explode(F.expr(f"sequence(offset div {capacity}, (offset + n_words - 1) div {capacity})")).alias("pack_id"),
    ).withColumns(
        {
            "from": F.greatest("offset", F.col("pack_id") * capacity),
            "to": F.least(F.col("offset") + F.col("n_words"), (F.col("pack_id") + 1) * capacity),
        }
    )
    piece = F.struct("from", "doc_id", (F.col("from") - F.col("offset")).alias("start"), (F.col("to") - F.col("from")).alias("length"))
    return (
        pieces.groupBy("pack_id")
        .agg(F.sort_array(F.collect_list(piece)).alias("p"))
        .select(
            "pack_id",
            F.aggregate("p.length", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_words"),
            F.col("p.doc_id").alias("doc_ids"),
            F.col("p.start").alias("starts"),
            F.col("p.length").alias("lengths"),
        )
    )
