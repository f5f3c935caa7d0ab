"""Near-duplicate embeddings through spherical-cap filters.

A filter is a direction; a vector belongs to every filter whose direction it exceeds: inner product ``alpha`` or
more.  Directions are a random product code: after a random rotation the dimensions are cut into blocks, each
block has ``words`` random unit vectors, and every combination of one vector a block is a direction.  A vector's
filters are found by list decoding: block by block, dropping partial sums that the best words of the blocks to
come cannot lift to ``alpha``.

``alpha`` is set so that a filter holds about ``bucket`` of n random vectors, and a code is as large as it takes for
two vectors of the wanted similarity to share one filter on average.  The filters of a code depend on each other:
vectors whose blocks have no close words lie in few caps or none.  So there are several codes, each with a rotation
and words of its own.  Whether a pair shares a filter of a randomly rotated code depends on its angle alone, hence
the share of pairs that one code misses is simulated with random pairs at the wanted similarity, and as many codes
are taken as bring the share that all miss to e^-shared.  The work for a vector grows with a small power of n
(about (1 - t) / (1 + t)).

Vectors are joined on filters.  They travel as 8-bit numbers with a bound of their rounding error; pairs that may
reach the threshold are then verified with the vectors themselves.  Equal vectors are one entity, told by 128 bits
of hash, so copies cost nothing; a filter of more than TILE vectors is compared tile by tile, in several tasks.

Defined results: similarity is the cosine; a null vector, one with a null, NaN or infinite number, and one without
length have no links; vectors of different dimensions have none; rows without vec_id have no links and no class;
rows equal in vec_id and vector are one, rows that differ in either are different vectors; no partner is left out
for being one of many; an empty table gives no rows; other columns are ignored.  The search is approximate: a pair
at the threshold is missed about once in e^shared times, closer pairs less often.  Below ONE_BLOCK_DIM dimensions a
code has one block, since a product of shorter blocks would have few directions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm._components import components
from trawl.llm._store import broadcast_if_small, written

#: Vectors of a batch that are decoded at once, and pairs of a bucket that are compared at once.
DECODE_ROWS = 1024
COMPARE = 1 << 21
#: Vectors of a filter that are compared in one piece.
TILE = 4096


def cap_share(alpha: float, angle: float, dim: int) -> float:
    """Share of directions that exceed ``alpha`` with each of two unit vectors at an angle (0: with one).

    In the plane of the two, a random direction has a length r with P(r > x) = (1 - x^2)^((dim - 2) / 2), and any
    angle from their bisector alike; the integral is over s = sqrt(1 - r^2)."""
    if dim < 3:
        return 0.5 - angle / (2 * math.pi) if alpha <= 0 else 0.0
    least = alpha / math.cos(angle / 2)
    if least >= 1:
        return 0.0
    top = math.sqrt(1 - least * least)
    s = np.linspace(max(0.0, top * (1 - 60 / dim)), top, 4001)
    r = np.sqrt(1 - s * s)
    width = np.arccos(np.clip(alpha / np.maximum(r, 1e-300), -1, 1)) - angle / 2
    y = (dim - 2) * s ** (dim - 3) * np.maximum(width, 0) / math.pi
    return float(((y[1:] + y[:-1]) / 2).sum() * (s[1] - s[0]))


#: Vectors of fewer dimensions have a code of one block, with at most so many words.
ONE_BLOCK_DIM, ONE_BLOCK_WORDS = 16, 1 << 14


#: Words of a block at most, and pairs for each of some codes whose common filters are simulated.
BLOCK_WORDS, SIMULATED_CODES, SIMULATED_PAIRS = 1024, 16, 512


@dataclass(frozen=True)
class Code:
    blocks: int
    words: int
    alpha: float
    codes: int = 1

    @staticmethod
    def suited(n: int, t: float, bucket: int, shared: float, dim: int) -> Code:
        share, angle = min(0.5, bucket / max(n, 1)), math.acos(t)
        while True:
            lo, hi = 0.0, 1.0
            for _ in range(60 if dim > 2 and share < 0.5 else 0):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if cap_share(mid, 0.0, dim) > share else (lo, mid)
            joint = cap_share(lo, angle, dim)
            filters = shared / joint if joint else math.inf
            if dim >= ONE_BLOCK_DIM or filters <= ONE_BLOCK_WORDS:
                break
            share *= 2
        if dim < ONE_BLOCK_DIM:
            return Code(1, math.ceil(filters), lo)
        filters = 1 / joint if joint else math.inf
        blocks = max(2, math.ceil(math.log(filters) / math.log(BLOCK_WORDS)))
        code = Code(blocks, math.ceil(filters ** (1 / blocks)), lo)
        return replace(code, codes=math.ceil(shared / -math.log(missed(code, t, dim))))


def missed(code: Code, t: float, dim: int) -> float:
    """Share of pairs with cosine ``t`` that have no common filter in one code; simulated."""
    rng, none = np.random.Generator(np.random.PCG64([12, dim])), 0
    for i in range(SIMULATED_CODES):
        x, y = rng.standard_normal((2, SIMULATED_PAIRS, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = t * x + math.sqrt(max(0.0, 1 - t * t)) * y / np.linalg.norm(y, axis=1, keepdims=True)
        # random pairs need no rotation
        decoder = Decoder(code, dim, 1000 + i, rotated=False)
        (a, f), (b, g) = decoder.filters(x), decoder.filters(y)
        all_filters = code.words**code.blocks
        none += SIMULATED_PAIRS - len(np.unique(np.intersect1d(a * all_filters + f, b * all_filters + g) // all_filters))
    pairs = SIMULATED_CODES * SIMULATED_PAIRS
    return min((none + 1) / (pairs + 1), pairs / (pairs + 1))


class Decoder:
    """One code for vectors of one dimension."""

    def __init__(self, code: Code, dim: int, seed: int = 11, rotated: bool = True):
        rng = np.random.Generator(np.random.PCG64([seed, dim]))
        self.rotation: np.ndarray | None = None
        if rotated:
            q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
            self.rotation = (q * np.sign(np.diag(r))).astype(np.float32)
        blocks = min(code.blocks, dim)
        self.cuts = [dim * i // blocks for i in range(blocks + 1)]
        self.books = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            w = rng.standard_normal((code.words, b - a))
            # weighted by its share of the dimensions, each direction has length 1
            self.books.append((w / np.linalg.norm(w, axis=1, keepdims=True) * math.sqrt((b - a) / dim)).astype(np.float32))
        self.alpha, self.words, self.dim = code.alpha, code.words, dim

    def filters(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of each cap that a unit vector lies in."""
        rotated = unit.astype(np.float32)
        if self.rotation is not None:
            rotated = rotated @ self.rotation
        products = [rotated[:, a:b] @ book.T for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)]
        best = np.array([p.max(axis=1) for p in products], np.float64)
        rest = np.concatenate([np.cumsum(best[::-1], axis=0)[::-1][1:], np.zeros((1, len(unit)))])
        row, total, name = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), np.int64)
        for p, own, r in zip(products, best, rest):
            # words that the best ones of all other blocks can lift to alpha; by row, falling
            at, word = np.nonzero(p >= (self.alpha - 1e-9 - (best.sum(axis=0) - own))[:, None])
            value = p[at, word].astype(np.float64)
            order = np.argsort(at * 8.0 - value)
            word, value = word[order], value[order]
            keys, starts = at[order] * 8.0 - value, np.searchsorted(at, np.arange(len(unit) + 1))
            # those that suffice are a row's first ones
            need = self.alpha - total - r[row]
            count = np.clip(np.searchsorted(keys, row * 8.0 - need, side="right") - starts[row], 0, np.diff(starts)[row])
            which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row, total, name = (np.repeat(x, count) for x in (row, total, name))
            total = total + value[starts[row] + which]
            name = name * self.words + word[starts[row] + which]
        ok = total >= self.alpha
        return row[ok], name[ok]


class Decoders:
    """All codes for vectors of one dimension."""

    def __init__(self, code: Code, dim: int, seed: int = 11):
        self.decoders = [Decoder(code, dim, seed + i) for i in range(code.codes)]
        self.size = code.words**code.blocks

    def filters(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [d.filters(unit) for d in self.decoders]
        return np.concatenate([row for row, _ in found]), np.concatenate([name + i * self.size for i, (_, name) in enumerate(found)])


def unit_rows(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: positions and unit vectors of the usable rows."""
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    sizes[~column.is_valid().to_numpy(zero_copy_only=False)] = 0
    out = {}
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        v = values[offsets[at][:, None] + np.arange(dim)]
        with np.errstate(over="ignore", invalid="ignore"):
            # the largest number is brought to 1 first: no square overflows or vanishes
            v = v / np.abs(v).max(axis=1, keepdims=True)
            length = np.linalg.norm(v, axis=1)
        ok = np.isfinite(length) & (length > 0)
        out[dim] = (at[ok], v[ok] / length[ok, None])
    return out


def rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit numbers, their scale, and the length of the error."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


def _close(q: np.ndarray, scale: np.ndarray, error: np.ndarray, half: np.ndarray, t: float):
    """Positions (i, j), i on the left (half & 1) and j on the right (half & 2), of pairs whose cosine may be t or more."""
    v = q.astype(np.float32) * scale[:, None].astype(np.float32)
    left, right = np.flatnonzero(half & 1), np.flatnonzero(half & 2)
    step = max(1, min(len(left), COMPARE // max(1, min(len(right), 4096))))
    for a in range(0, len(left), step):
        x = left[a : a + step]
        for b in range(0, len(right), 4096):
            y = right[b : b + 4096]
            # both are unit vectors: the rounding of each moves the product by its error at most, and by both
            slack = error[x, None] + error[None, y] + error[x, None] * error[None, y] + 1e-5
            i, j = np.nonzero(v[x] @ v[y].T >= t - slack)
            yield x[i], y[j]


def entities(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, distinct): members(vec_id, h1, h2) has each row once; distinct(entity, embedding, copies, h1, h2)
    each vector once, entity being the least vec_id that has it and copies the number of them."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    base = base.where("vec_id is not null").withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    usable = base.where("embedding is not null and size(embedding) > 0")
    distinct = usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"), F.countDistinct("vec_id").alias("copies"))
    # a vec_id with two vectors would name both: the name is told apart by the hashes
    distinct = distinct.select(F.xxhash64("h1", "h2", "least").alias("entity"), "least", "embedding", "copies", "h1", "h2")
    return base.select("vec_id", "h1", "h2").distinct(), written(distinct, "distinct-vectors")


def linked(distinct: DataFrame, t: float, bucket: int, shared: float) -> DataFrame:
    """(a, b, cosine) of pairs of entities with cosine ``t`` or more."""
    base = distinct.select("entity", "embedding")
    # a number for each different dimension; one vector has no partner
    sizes = base.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).where("n > 1").collect()
    codes = {r.dim: Code.suited(r.n, t, bucket, shared, r.dim) for r in sizes}

    def send(batches):
        decoders: dict[int, Decoders] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(lo, DECODE_ROWS)
                ids = part.column(0).to_numpy()
                for dim, (at, unit) in unit_rows(part.column(1)).items():
                    if dim not in codes:
                        continue
                    if dim not in decoders:
                        decoders[dim] = Decoders(codes[dim], dim)
                    row, name = decoders[dim].filters(unit)
                    q, scale, error = rounded(unit)
                    data = pa.array([x.tobytes() for x in q], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(row), dim, np.int32)), pa.array(name), pa.array(ids[at[row]]),
                            data.take(pa.array(row)), pa.array(scale[row].astype(np.float32)), pa.array(error[row].astype(np.float32)),
                        ],
                        ["dim", "filter", "entity", "q", "scale", "error"],
                    )

    def compare(batches):
        held, key = [], None

        def flush():
            ids, q, scale, error, half = (np.concatenate([h[i] for h in held]) for i in range(5))
            for i, j in _close(q, scale, error, half, t):
                a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                pairs = np.unique(np.stack([a, b], 1)[a < b], axis=0)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, len(keys)]):
                if a == b:
                    continue
                if key != (now := tuple(keys[a].tolist())):
                    if held:
                        yield from flush()
                    held, key = [], now
                q = np.frombuffer(b"".join(batch.column(6).slice(a, b - a).to_pylist()), np.int8).reshape(b - a, -1)
                held.append((batch.column(5).to_numpy()[a:b], q, *(batch.column(i).to_numpy()[a:b].astype(np.float64) for i in (7, 8)), batch.column(4).to_numpy()[a:b]))
        if held:
            yield from flush()

    caps = written(base.mapInArrow(send, "dim int, filter long, entity long, q binary, scale float, error float"), "caps")
    large = caps.groupBy("dim", "filter").count().where(F.col("count") > TILE)
    large = written(large.select("dim", "filter", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "large-filters")
    whole = caps.withColumns({"left": F.lit(0), "right": F.lit(0), "half": F.lit(3)})
    if not large.isEmpty():
        many = broadcast_if_small(large)
        # tile i meets the tiles from itself on: a row of tile i is on the left of (i, j >= i), on the right of (j <= i, i)
        tiled = caps.join(many, ["dim", "filter"]).withColumn("own", F.pmod(F.xxhash64("entity"), F.col("tiles")).cast("int"))
        left = tiled.withColumns({"left": F.col("own"), "right": F.explode(F.expr("sequence(own, tiles - 1)"))}).withColumn("half", F.when(F.col("left") == F.col("right"), 3).otherwise(1))
        right = tiled.withColumns({"left": F.explode(F.expr("sequence(0, own)")), "right": F.col("own"), "half": F.lit(2)}).where("left < right")
        whole = whole.join(many, ["dim", "filter"], "left_anti").unionByName(left.drop("own", "tiles")).unionByName(right.drop("own", "tiles"))
    whole = whole.select("dim", "filter", "left", "right", "half", "entity", "q", "scale", "error")
    found = whole.repartition("dim", "filter", "left", "right").sortWithinPartitions("dim", "filter", "left", "right").mapInArrow(compare, "a long, b long")
    pairs = written(found.distinct(), "cap-pairs", caps, large)
    a, b = (base.select(F.col("entity").alias(x), F.col("embedding").alias(f"{x}_vector")) for x in "ab")

    def verify(batches):
        for batch in batches:
            left, right = unit_rows(batch.column(2)), unit_rows(batch.column(3))
            cosine = np.full(batch.num_rows, -2.0)
            for dim in left.keys() & right.keys():
                (i, u), (j, v) = left[dim], right[dim]
                both, x, y = np.intersect1d(i, j, assume_unique=True, return_indices=True)
                cosine[both] = np.clip((u[x] * v[y]).sum(axis=1), -1, 1)
            ok = np.flatnonzero(cosine >= t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok)), pa.array(cosine[ok])], ["a", "b", "cosine"])

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "a_vector", "b_vector")
    return written(joined.mapInArrow(verify, "a long, b long, cosine double"), "near-vectors", pairs)


def near_pairs(vectors: DataFrame, t: float = 0.9, bucket: int = 128, shared: float = 8.0) -> DataFrame:
    """(vec_a, vec_b, cosine) of pairs of different vectors with cosine ``t`` or more, each under the least vec_id
    that has it."""
    _, distinct = entities(vectors)
    a, b = (distinct.select(F.col("entity").alias(x), F.col("least").alias(f"vec_{x}")) for x in "ab")
    found = linked(distinct, t, bucket, shared).join(a, "a").join(b, "b")
    return found.select(F.least("vec_a", "vec_b").alias("vec_a"), F.greatest("vec_a", "vec_b").alias("vec_b"), "cosine")


def classes(vectors: DataFrame, t: float = 0.9, bucket: int = 128, shared: float = 8.0) -> DataFrame:
    """(vec_id, class_id, links) of each vector: the number of other vectors whose cosine to it is ``t`` or more, equal
    ones included, and the least vec_id of all that links connect it to."""
    return _classified(vectors, t, bucket, shared).select("vec_id", "class_id", "links")


def _classified(vectors: DataFrame, t: float, bucket: int, shared: float) -> DataFrame:
    members, distinct = entities(vectors)
    pairs = linked(distinct, t, bucket, shared)
    copies = distinct.select("entity", "copies")
    both = pairs.select(F.col("a").alias("of"), F.col("b").alias("entity")).unionByName(pairs.select(F.col("b").alias("of"), F.col("a").alias("entity")))
    near = both.join(copies, "entity").groupBy(F.col("of").alias("entity")).agg(F.sum("copies").alias("near"))
    groups = components(pairs.select("a", "b"))
    one = distinct.drop("embedding").join(groups, F.col("entity") == F.col("node"), "left").withColumn("component", F.coalesce("component", "entity"))
    least = one.groupBy("component").agg(F.min("least").alias("class_id"))
    one = one.join(least, "component").join(near, "entity", "left")
    # a vector without length is no link of its copies either
    has_length = F.exists(F.col("embedding"), lambda x: x != 0) & F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = distinct.select("entity", has_length.alias("usable"))
    one = one.join(usable, "entity").select("h1", "h2", F.when(F.col("usable"), F.col("class_id")).alias("class_id"), F.when(F.col("usable"), F.col("copies") - 1).otherwise(0).alias("equal"), F.coalesce("near", F.lit(0)).alias("near"))
    # a vector that nothing is known of is a class of its own
    found = members.join(one, ["h1", "h2"], "left")
    return found.select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), (F.coalesce("equal", F.lit(0)) + F.coalesce("near", F.lit(0))).alias("links"), "h1", "h2")


def deduplicate(vectors: DataFrame, t: float = 0.9) -> DataFrame:
    """``vectors`` with the vectors of one vec_id of each class; the least stays.  Rows without vec_id stay."""
    gone = written(_classified(vectors, t, 128, 8.0).where("vec_id <> class_id").select("vec_id", "h1", "h2"), "gone")
    gone = broadcast_if_small(gone)
    own = F.col("embedding").cast("array<double>")
    same = (vectors["vec_id"].cast("long") == gone["vec_id"]) & (F.xxhash64(own) == gone["h1"]) & (F.xxhash64(F.lit(1), own) == gone["h2"])
    return vectors.join(gone, same, "left_anti")
