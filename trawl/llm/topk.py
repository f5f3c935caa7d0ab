"""Exact top-k search by columnar branch-and-bound.

Vectors lie in chunks in vertical layout: for each block of dimensions a matrix (dimensions, rows), and for each
row the mass (length) that remains after each block.  A task holds a block of queries and streams through the
chunks of its part of the table.  Squared Euclidean distances are accumulated block by block; what remains of a
distance is at least (|q_rest| - |x_rest|)^2, and a candidate is given up once that lower bound exceeds the
query's k-th best distance.  While most pairs survive a block is one matrix product; then the survivors are
compacted to a list and only these go on.

Dimensions are first turned to the eigenvectors of their second moments, largest first, which leaves distances as
they are and puts as much mass as possible into the first blocks.  Work is a grid of query blocks and table parts;
each part's best k are merged at the end, so neither side must fit into a task.

Distances of the survivors are computed again in double precision, from the vectors as they were and relative to
their largest difference, so no square overflows or vanishes and results are exact.

The queries are a stated set of rows; with q of them and n vectors there are q n / 2^30 cells, and what a cell costs
depends on how much pruning saves.

Defined results: a null vector, and one with a null, NaN or infinite number, is neither query nor answer; so is an
empty one and a row without vec_id; vectors of different dimensions are no neighbours; equal rows (vec_id and
vector) are one; a vec_id is no neighbour of itself; ties go to the lesser vec_id; a query with fewer than k
others gets all of them; a distance beyond the largest number is infinite; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawl.llm._store import load_arrays, new_path, save_arrays, written

CHUNK_ROWS = 4096
QUERY_ROWS = 1024
#: Chunks of a cell of the grid: 2^20 vectors.
PART_CHUNKS = 256
#: Above this share of survivors a block is done as a matrix product.
DENSE = 0.2


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim, version, largest) of distinct rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite).distinct()
    return v.withColumns({"dim": F.size("embedding"), "version": F.xxhash64("embedding"), "largest": F.array_max(F.transform("embedding", F.abs))})


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """By dimension, eigenvectors of the second moments of all vectors, largest first."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                x = _matrix(batch.column(0).filter(pa.array(dims == d)), d)
                # relative to the largest number: only the directions matter
                x = x / max(1e-300, np.abs(x).max())
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["dim", "m"])

    def add(table: pa.Table) -> pa.Table:
        m = sum(np.frombuffer(b.as_py()) for b in table.column("m"))
        return pa.table({"dim": table.column("dim")[:1], "m": pa.array([m.tobytes()], pa.binary())})

    moments = rows.select("embedding", "dim").mapInArrow(sums, "dim int, m binary").groupBy("dim").applyInArrow(add, "dim int, m binary")
    # one matrix for each dimension that occurs
    out = {}
    for r in moments.collect():
        _, vectors = np.linalg.eigh(np.frombuffer(r.m).reshape(r.dim, r.dim))
        out[r.dim] = np.ascontiguousarray(vectors[:, ::-1])
    return out


def block_cuts(dim: int, width: int = 16) -> list[int]:
    return [*range(0, dim, width), dim]


def vertical(x: np.ndarray, rotation: np.ndarray) -> dict[str, np.ndarray]:
    """One chunk in vertical layout."""
    y = x @ rotation
    cuts = block_cuts(x.shape[1])
    out = {f"b{i}": np.ascontiguousarray(y[:, a:b].T.astype(np.float32)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    out["own"] = np.array([(y[:, a:b] ** 2).sum(axis=1) for a, b in zip(cuts, cuts[1:])], np.float32)
    out["rest"] = np.array([np.sqrt((y[:, b:] ** 2).sum(axis=1)) for b in cuts[1:]], np.float32)
    return out


class Best:
    """The k nearest so far of each query, by (distance, id).  ``unit``: what one is in the vertical layout."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int, unit: float = 1.0):
        self.ids, self.x, self.k, self.unit = ids, x, k, unit
        self.columns = vertical(x / unit, rotation)
        self.length = np.sqrt(((x / unit) ** 2).sum(axis=1))
        self.query = np.zeros(0, np.int64)
        self.other = np.zeros(0, np.int64)
        self.distance = np.zeros(0)
        self.limit = np.full(len(ids), np.inf)

    def _slack(self, longest: float) -> np.ndarray:
        """Bound of the rounding of single precision: partial sums are of numbers up to (|q| + |x|)^2."""
        return 1e-5 * (self.length + longest) ** 2 + 1e-30

    def visit(self, ids: np.ndarray, x: np.ndarray, columns: dict[str, np.ndarray]) -> None:
        blocks = len(columns["own"])
        slack = self._slack(float(np.sqrt(((x / self.unit) ** 2).sum(axis=1).max())))
        bound = (self.limit + slack).astype(np.float32)
        q = self.columns
        dense = np.zeros((len(self.ids), len(ids)), np.float32)
        i = j = None
        for b in range(blocks):
            if i is None:
                dense += q["own"][b][:, None]
                dense += columns["own"][b][None, :]
                dense -= 2 * (q[f"b{b}"].T @ columns[f"b{b}"])
                if b + 1 < blocks:
                    low = q["rest"][b][:, None] - columns["rest"][b][None, :]
                    low *= low
                    low += dense
                    alive = low <= bound[:, None]
                else:
                    alive = dense <= bound[:, None]
                if b + 1 == blocks or np.count_nonzero(alive) < DENSE * alive.size:
                    i, j = np.nonzero(alive)
                    partial = dense[i, j]
            else:
                step = q[f"b{b}"][:, i] - columns[f"b{b}"][:, j]
                partial = partial + np.einsum("ij,ij->j", step, step)
                low = (q["rest"][b][i] - columns["rest"][b][j]) ** 2 if b + 1 < blocks else 0
                ok = partial + low <= bound[i]
                i, j, partial = i[ok], j[ok], partial[ok]
        ok = self.ids[i] != ids[j]
        i, j = i[ok], j[ok]
        if self.k * 4 * len(self.ids) < len(i):
            # many reach the end while limits are still wide: the k-th of the single-precision distances is a limit
            partial = partial[ok]
            order = np.lexsort([partial, i])
            i, j, partial = i[order], j[order], partial[order]
            start = np.searchsorted(i, np.arange(len(self.ids)))
            count = np.diff(np.concatenate([start, [len(i)]]))
            kth = np.full(len(self.ids), np.inf)
            has = count >= self.k
            kth[has] = partial[start[has] + self.k - 1]
            near = partial <= (kth + 2 * slack)[i]
            i, j = i[near], j[near]
        # halves: the difference of two numbers may be beyond the largest one
        apart = self.x[i] / 2 - x[j] / 2
        most = np.abs(apart).max(axis=1, initial=0.0)
        with np.errstate(over="ignore"):
            distance = 2 * (most * np.sqrt(((apart / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1)))
        self._merge(i, ids[j], distance)

    def _merge(self, query: np.ndarray, other: np.ndarray, distance: np.ndarray) -> None:
        ok = (distance / self.unit) ** 2 <= self.limit[query] * (1 + 1e-12) + 1e-300
        query = np.concatenate([self.query, query[ok]])
        other = np.concatenate([self.other, other[ok]])
        distance = np.concatenate([self.distance, distance[ok]])
        order = np.lexsort([other, distance, query])
        query, other, distance = query[order], other[order], distance[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.query, self.other, self.distance = query[keep], other[keep], distance[keep]
        full = rank == self.k - 1
        self.limit[query[full]] = (distance[full] / self.unit) ** 2


def neighbours(vectors: DataFrame, k: int = 10, queries: Column | None = None) -> DataFrame:
    """(query_id, query_row, rank, neighbour_id, distance) of the k nearest others, among all vectors, of every vector for
    which ``queries`` (a condition on vec_id) holds, or of all; distance is Euclidean.  query_row tells apart several
    vectors with one vec_id (0, 1, ...)."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    asked = rows if queries is None else rows.where(queries)
    n, largest = rows.agg(F.count("*"), F.max("largest")).first()
    n_asked = asked.count()
    # a power of two, so that scaling is exact; single precision neither overflows nor loses all digits
    unit = 2.0 ** min(1023.0, np.ceil(np.log2(largest))) if largest else 1.0
    turns = rotations(rows)
    path = new_path(spark, "vertical")

    def layer(of: DataFrame, n_chunks: int, name: str, columnar: bool) -> dict[int, list[int]]:
        """Write ``of`` in chunks; their numbers, by dimension: two numbers for each chunk."""

        def lay_out(table: pa.Table) -> pa.Table:
            d, chunk = table.column("dim")[0].as_py(), table.column("chunk")[0].as_py()
            x = _matrix(table.column("embedding").combine_chunks(), d)
            columns = {c: table.column(c).to_numpy() for c in ("vec_id", "version")}
            save_arrays(f"{path}/{name}-{d}-{chunk}.npz", x=x, **columns, **(vertical(x / unit, turns[d]) if columnar else {}))
            return pa.table({"dim": pa.array([d], pa.int32()), "chunk": pa.array([chunk], pa.int32())})

        in_chunks = of.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "version"), F.lit(max(1, n_chunks))).cast("int"))
        out: dict[int, list[int]] = {}
        for r in sorted(in_chunks.groupBy("dim", "chunk").applyInArrow(lay_out, "dim int, chunk int").collect()):
            out.setdefault(r.dim, []).append(r.chunk)
        return out

    chunks = layer(rows, -(-n // CHUNK_ROWS), "all", True)
    pieces = layer(asked, -(-n_asked // QUERY_ROWS), "asked", False)
    # cells of dimension d are numbered from first[d] on, query piece by query piece
    parts = {d: -(-len(chunks[d]) // PART_CHUNKS) for d in pieces}
    first, cells = {}, 0
    for d in pieces:
        first[d], cells = cells, cells + len(pieces[d]) * parts[d]
    schema = "query_id long, version long, neighbour_id long, distance double"

    def search(batches):
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                d = max((x for x in first if first[x] <= cell), key=first.__getitem__)
                piece, part = divmod(cell - first[d], parts[d])
                own = load_arrays(f"{path}/asked-{d}-{pieces[d][piece]}.npz")
                best = Best(own["vec_id"], own["x"], turns[d], k, unit)
                for other in chunks[d][part * PART_CHUNKS : (part + 1) * PART_CHUNKS]:
                    chunk = load_arrays(f"{path}/all-{d}-{other}.npz")
                    best.visit(chunk["vec_id"], chunk["x"], chunk)
                q = best.query
                yield pa.RecordBatch.from_arrays(
                    [pa.array(best.ids[q]), pa.array(own["version"][q]), pa.array(best.other), pa.array(best.distance)],
                    ["query_id", "version", "neighbour_id", "distance"],
                )

    grid = spark.range(0, cells, 1, max(1, min(cells, 1 << 14)))
    found = written(grid.mapInArrow(search, schema), "cells", rows, path)
    best_first = Window.partitionBy("query_id", "version").orderBy("distance", "neighbour_id")
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    versions = Window.partitionBy("query_id").orderBy("version")
    return ranked.withColumn("query_row", F.dense_rank().over(versions) - 1).select("query_id", "query_row", "rank", "neighbour_id", "distance")
