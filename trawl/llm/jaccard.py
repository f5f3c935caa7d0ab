"""Exact Jaccard self-join of documents' word n-gram sets, through a token-group matrix.

A group holds similar documents: those with the same least token (a token is the hash of an n-gram, so this
is a min-hash, which near copies mostly share) and about the same size.  The matrix says which groups have which tokens in the union of
their members' sets.  A document q opens group g only if |q and union(g)| can reach t |q|, which any member with
Jaccard similarity t or more needs.

Spark's part, with every document as a query:

1. Token statistics over all documents.  Tokens are sent as sorted, difference-coded blocks of 40 bits to the
   task of their range, which tells those that occur once, and those that occur in more than ``hot`` documents.
2. Two sets of similarity t share at least k tokens among the first (1 - t) |s| + k of each, in any global
   order; k is a tenth of the smaller set.  The order puts hot tokens last, the most frequent at the very end, so that
   prefixes avoid tokens that very many documents have.  Prefix tokens that occur once cannot meet another document and stay behind (a bitmap of fixed size tells them; as it fills up, more are sent, with
   the same result).  Where a token meets several documents, its row of the matrix is counted for each (query,
   group) of about the same size, and pairs that stay below k, or whose sizes rule out similarity t, are given up.
3. Groups are opened in cells: up to MEMBERS of a group's members with up to QUERIES of its queries, so however
   large a group is, a task holds one cell at a time.  In a cell the bound comes first, then overlaps with the members as
   products of 0/1 matrices.  A cell tells of each text how many documents it is linked to, and a spanning forest
   of the links, never all pairs.

Equal sets are one entity throughout, so copies cost next to nothing.

Defined results: n-grams are of words between ASCII white space, in lower case; a text of fewer than n words has
one n-gram of all of them; a null or empty text, or one without words, has no n-gram and no link; rows equal in
doc_id and n-gram set are one document, rows that differ in either are different documents; rows without doc_id
have no links and no class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm._components import components
from trawl.llm._store import broadcast_if_small, discard, load_arrays, new_path, save_arrays, written
from trawl.llm._text import Words, encoded_chunks, input_parts, mix, ngram_hashes, pack_sorted, release, unpack_sorted

TOKEN_BITS = 40  #: of a token's hash that statistics and candidates go by; a clash only adds work
BITMAP_BITS = 28
COUNTED = 1_000_000  #: rows of the matrix that a task counts at a time
HOT_LIMIT = 2_000_000  #: hot tokens that tasks hold; above that ``hot`` is raised
LONGER = 10  #: prefixes are longer than it takes to share one token by this part of a set
GROUP_TOKENS = 1  #: least tokens that members of a group share
MEMBERS, QUERIES = 512, 2048  #: of a group, in one cell
KNOWN_TOKENS = 5_000_000
STEP = 1.5  #: sizes in a group differ by this factor at most
HASH_BITS = 26  #: of a group's number; the bits above them are its class of sizes


def sets_of(words: Words, n: int) -> list[np.ndarray]:
    """Ascending distinct n-gram hashes of each text."""
    grams = ngram_hashes(words.hashes, n)
    out = []
    for a, b in zip(words.bounds.tolist(), words.bounds[1:].tolist()):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            out.append(mix(ngram_hashes(words.hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(tokens: np.ndarray) -> int:
    return int(mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))]))[0])


def least_overlap(t: float, size: int) -> int:
    return math.ceil(t * size - 1e-9)


def prefix_length(t: float, size: int) -> int:
    """Two sets of similarity t or more, a and b, share at least 1 + min(|a|, |b|) // LONGER tokens of these prefixes:
    what they share elsewhere is in the rest of the one whose prefix ends first in the common order."""
    return min(size, size - least_overlap(t, size) + 1 + size // LONGER)


def least_shared(t: float, size: Column, low: Column) -> Column:
    """How many of its prefix tokens a set shares with any similar one in a group whose sizes are ``low`` at least;
    the size of a similar one is t |s| at least."""
    return F.least(1 + F.floor(F.least(size, F.greatest(low, F.ceil(size * t - 1e-9))) / LONGER), F.ceil(size * t - 1e-9))


def _ranges(sorted_tokens: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the 40-bit tokens begins."""
    edges = (np.arange(1, parts, dtype=np.uint64) << np.uint64(TOKEN_BITS)) // np.uint64(parts)
    return np.concatenate([[0], np.searchsorted(sorted_tokens, edges), [len(sorted_tokens)]])


def _shorten(tokens: np.ndarray) -> np.ndarray:
    return tokens >> np.uint64(64 - TOKEN_BITS)


def _set_batches(batches, n: int):
    for batch in batches:
        for a, b, texts in encoded_chunks(batch.column(1)):
            yield batch.slice(a, b - a), sets_of(Words(texts), n)


def token_statistics(docs: DataFrame, n: int, hot: int, parts: int) -> str:
    """Counts all tokens; the path of a file with the bitmap of those that occur more than once, and the hot ones."""

    def send(batches):
        held, count = [], 0

        def flush():
            tokens = np.sort(np.concatenate(held))
            cut = _ranges(tokens, parts)
            for p in np.flatnonzero(np.diff(cut)):
                yield int(p), pack_sorted(tokens[cut[p] : cut[p + 1]])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "block"])

        for _, sets in _set_batches(batches, n):
            held += [_shorten(s) for s in sets]
            count += sum(map(len, sets))
            if count > 4_000_000:
                yield batch_of(list(flush()))
                held, count = [], 0
        if count:
            yield batch_of(list(flush()))

    def tell(table: pa.Table) -> pa.Table:
        tokens = np.sort(np.concatenate([unpack_sorted(b.as_py()) for b in table.column("block")]))
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        count = np.diff(np.concatenate([first, [len(tokens)]]))
        tokens = tokens[first]
        common = count > hot
        slots = np.unique(mix(tokens[count > 1]) >> np.uint64(64 - BITMAP_BITS))
        release()
        return pa.table(
            {
                "repeated": pa.array([pack_sorted(slots)], pa.binary()),
                "hot": pa.array([tokens[common].astype(np.int64)], pa.list_(pa.int64())),
                "df": pa.array([count[common].astype(np.int64)], pa.list_(pa.int64())),
            }
        )

    spark = docs.sparkSession
    found = written(
        docs.select("doc_id", "text").mapInArrow(send, "part int, block binary").groupBy("part").applyInArrow(tell, "repeated binary, hot array<long>, df array<long>"),
        "token-statistics",
    )
    path = new_path(spark, "token-filter") + "/filter.npz"
    hot_rows = found.select(F.explode(F.arrays_zip("hot", "df")).alias("h")).select("h.hot", F.col("h.df").cast("int").alias("df"))
    # raise the limit rather than let the list that every task holds grow without bound
    while hot_rows.where(F.col("df") > hot).count() > HOT_LIMIT:
        hot *= 2
    kept_hot = hot_rows.where(F.col("df") > hot)

    def save(pieces):
        bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
        tokens, counts = [], []
        for batch in pieces:
            for repeated, some, df in zip(*(c.to_pylist() for c in batch.columns)):
                if repeated is not None:
                    slot = unpack_sorted(repeated)
                    np.bitwise_or.at(bitmap, (slot >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (slot & np.uint64(7)).astype(np.uint8)))
                if some is not None:
                    tokens.append(some)
                    counts.append(df)
        at = np.argsort(np.array(tokens, np.uint64))
        save_arrays(path, bitmap=bitmap, hot=np.array(tokens, np.uint64)[at], df=np.array(counts, np.int32)[at])
        yield pa.RecordBatch.from_arrays([pa.array([len(tokens)], pa.int64())], ["n"])

    # one task folds the parts into a file of fixed size
    both = found.select("repeated", F.lit(None).cast("long").alias("hot"), F.lit(None).cast("int").alias("df")).unionByName(kept_hot.select(F.lit(None).cast("binary").alias("repeated"), "hot", "df"))
    both.coalesce(1).mapInArrow(save, "n long").collect()
    return path


class _Order:
    """Prefixes in the global order: tokens that are not hot by hash, then the hot ones by frequency and hash."""

    def __init__(self, path: str, t: float):
        loaded = load_arrays(path)
        self.bitmap, self.hot, self.df, self.t = loaded["bitmap"], loaded["hot"], loaded["df"], t

    def prefix(self, tokens: np.ndarray) -> tuple[np.ndarray, int]:
        """Prefix of a set, shortened, and the number of its group."""
        s = _shorten(tokens)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, s), len(self.hot) - 1)
            is_hot = self.hot[at] == s
            s = np.concatenate([s[~is_hot], s[is_hot][np.argsort(self.df[at[is_hot]], kind="stable")]])
        s = s[: prefix_length(self.t, len(tokens))]
        least = mix(tokens[:GROUP_TOKENS]).sum(dtype=np.uint64, keepdims=True)
        size = int(math.log(len(tokens), STEP))
        return s, size << HASH_BITS | int(mix(least + np.uint64(size))[0] >> np.uint64(64 - HASH_BITS))

    def met(self, tokens: np.ndarray) -> np.ndarray:
        slot = mix(tokens) >> np.uint64(64 - BITMAP_BITS)
        return (self.bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def classes_apart(t: float) -> int:
    """By how many classes of sizes two sets of similarity t differ at most."""
    return math.floor(-math.log(t) / math.log(STEP) + 1e-9) + 1


def _matrix_part(batches: Iterator[pa.RecordBatch], apart: int) -> Iterator[pa.RecordBatch]:
    """(key, group, shared): the tokens of one range that a query shares with a group's union, for groups of up to
    ``apart`` classes of sizes from the query's.  Counts of one
    (key, group) come in several rows, so that a task holds no more than about COUNTED of them."""
    blocks = [(unpack_sorted(t.as_py()), np.frombuffer(k.as_py(), np.uint64)) for b in batches for t, k in zip(b.column("tokens"), b.column("keys"))]
    tokens, keys = (np.concatenate([b[i] for b in blocks]) for i in (0, 1))
    del blocks
    at = np.lexsort([keys, tokens])
    tokens, keys = tokens[at], keys[at]
    del at
    keep = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])])  # equal sets are one entity
    tokens, keys = tokens[keep], keys[keep]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(tokens)]]))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    pairs, found = np.zeros((0, 3), np.uint64), []

    def batch_of(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].astype(np.int64)) for i in range(3)], ["key", "group", "shared"])

    # within a token, keys ascend and begin with the group: entity i meets the groups from its own on
    step = 0
    while step < len(starts):
        stop = step + max(1, int(np.searchsorted(np.cumsum(sizes[step:].astype(np.float64) ** 2), COUNTED)))
        which = np.concatenate([np.arange(a, a + n) for a, n in zip(starts[step:stop], sizes[step:stop])])
        run = np.repeat(np.arange(stop - step), sizes[step:stop])[: len(which)]
        g = (keys[which] >> np.uint64(32)).astype(np.int64)
        first = np.concatenate([[True], (run[1:] != run[:-1]) | (g[1:] != g[:-1])])
        number = np.cumsum(first) - 1  # of the (token, group)
        groups = g[first]
        run_of_group = run[first]
        last = np.searchsorted(run_of_group, np.arange(stop - step), side="right")  # groups of a run end here
        alone = np.concatenate([first[1:], [True]])  # the last entity of its group: no partner in its own group
        begin = number + alone
        # and, as groups go by sizes, up to those that are too large for it
        size_of = lambda g: g >> HASH_BITS
        reach = np.searchsorted(run_of_group * 4096 + size_of(groups), run * 4096 + size_of(g) + apart, side="right")
        n = np.maximum(np.minimum(last[run], reach) - begin, 0)
        key, total, lo = keys[which], np.cumsum(n), 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + COUNTED, side="right")))
            q = np.repeat(key[lo:hi], n[lo:hi])
            offset = np.arange(len(q)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
            found.append(_counted(np.column_stack([q, groups[np.repeat(begin[lo:hi], n[lo:hi]) + offset].astype(np.uint64), np.ones(len(q), np.uint64)])))
            lo = hi
            if sum(map(len, found)) > COUNTED:
                pairs, found = _counted(np.concatenate([pairs, *found])), []
                if len(pairs) > COUNTED:
                    yield batch_of(pairs)
                    pairs = pairs[:0]
        step = stop
    yield batch_of(_counted(np.concatenate([pairs, *found])))
    del tokens, keys, pairs, found
    release()


def _counted(pairs: np.ndarray) -> np.ndarray:
    """Rows of equal first two columns as one, the third summed."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort([pairs[:, 1], pairs[:, 0]])]
    first = np.flatnonzero(np.concatenate([[True], (pairs[1:, :2] != pairs[:-1, :2]).any(1)]))
    return np.column_stack([pairs[first, :2], np.add.reduceat(pairs[:, 2], first)])


class Cell:
    """Some members of a group, and some of its queries; members may be queries too."""

    def __init__(self):
        self.names: list[int] = []
        self.sets: list[np.ndarray] = []
        self.role: list[int] = []  # 1: query of another group, 2: query that is a member of the group, 4: member here
        self.copies: list[int] = []

    def add(self, name: int, tokens: np.ndarray, role: int, copies: int) -> None:
        self.names.append(name)
        self.sets.append(tokens)
        self.role.append(role)
        self.copies.append(copies)

    def links(self, t: float) -> Iterator[tuple[int, int, int, int]]:
        """(query, member, overlap, size of both together), as positions, of similarity ``t`` or more; of two
        members of the group the greater is the query."""
        role = np.array(self.role, np.int64)
        members = np.flatnonzero(role & 4)
        if not len(members):
            return
        union = np.unique(np.concatenate([self.sets[i] for i in members]))
        opened = [i for i in np.flatnonzero(role & 3) if len(np.intersect1d(self.sets[i], union, assume_unique=True)) >= least_overlap(t, len(self.sets[i]))]
        if not opened:
            return
        # only tokens that two of these have take part in an overlap
        everyone = sorted({*members.tolist(), *map(int, opened)})
        tokens, count = np.unique(np.concatenate([self.sets[i] for i in everyone]), return_counts=True)
        tokens = tokens[count > 1]
        sizes = np.array([len(x) for x in self.sets])

        def rows(which) -> np.ndarray:
            m = np.zeros((len(which), len(tokens)), np.float32)
            for i, k in enumerate(which):
                x = self.sets[k]
                at = np.searchsorted(tokens, x)
                at[at == len(tokens)] = 0
                m[i, at[tokens[at] == x] if len(tokens) else []] = 1
            return m

        block = max(1, min(512, (1 << 23) // max(1, len(tokens))))
        for lo in range(0, len(members), block):
            base = members[lo : lo + block]
            m = rows(base)
            for left in range(0, len(opened), block):
                part = np.array(opened[left : left + block])
                overlap = rows(part) @ m.T
                together = sizes[part][:, None] + sizes[base][None, :] - overlap
                for x, y in zip(*np.nonzero(overlap >= t * together - 1e-6)):
                    q, k = int(part[x]), int(base[y])
                    if self.role[q] & 1 or self.names[q] > self.names[k]:
                        yield q, k, int(overlap[x, y]), int(together[x, y])

    def summary(self, t: float) -> list[tuple[int, int, int]]:
        """(name, root, links): the number of documents that a text is linked to in this cell, and the least name
        that these links connect it to."""
        root = list(range(len(self.names)))
        links = [0] * len(root)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for q, k, _, _ in self.links(t):
            links[q] += self.copies[k]
            links[k] += self.copies[q]
            a, b = find(q), find(k)
            if a != b:
                a, b = (a, b) if self.names[a] < self.names[b] else (b, a)
                root[b] = a
        return [(self.names[i], self.names[find(i)], n) for i, n in enumerate(links) if n]


def join(docs: DataFrame, t: float = 0.4, n: int = 4, hot: int = 16) -> tuple[DataFrame, DataFrame]:
    """(sets, found): sets(doc_id, text_hash, entity, key, size) has every document with n-grams, equal sets having
    equal entity; found(entity, root, links) tells of the links between different sets of similarity t or more: for
    each cell that an entity has links in, how many documents it is linked to, and to which entity they connect it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).where("doc_id is not null")
    parts = input_parts(docs)
    filter_path = token_statistics(docs, n, hot, parts)

    def send(batches):
        order = _Order(filter_path, t)
        for rows, sets in _set_batches(batches, n):
            has = [i for i, s in enumerate(sets) if len(s)]
            prefixes, keys, hashes = [], [], []
            for i in has:
                p, group = order.prefix(sets[i])
                h = set_hash(sets[i])
                prefixes.append(p)
                hashes.append(h)
                keys.append(group << 32 | h & 0xFFFFFFFF)
            if not has:
                continue
            tokens = np.concatenate(prefixes)
            owner = np.repeat(np.array(keys, np.uint64), list(map(len, prefixes)))
            met = order.met(tokens)
            tokens, owner = tokens[met], owner[met]
            at = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[at], owner[at]
            cut = _ranges(tokens, parts)
            full = np.flatnonzero(np.diff(cut)).tolist()
            m = len(full)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*full, -1], pa.int32()),
                    pa.array([pack_sorted(tokens[cut[p] : cut[p + 1]]) for p in full] + [None], pa.binary()),
                    pa.array([owner[cut[p] : cut[p + 1]].tobytes() for p in full] + [None], pa.binary()),
                    pa.array([None] * m + [[{"doc_id": d, "text_hash": x, "entity": h, "key": k, "size": s} for d, x, k, h, s in zip(
                        rows.column(0).take(pa.array(has)).to_pylist(), rows.column(2).take(pa.array(has)).to_pylist(), np.array(keys, np.uint64).astype(np.int64).tolist(), np.array(hashes, np.uint64).astype(np.int64).tolist(), [len(sets[i]) for i in has])]],
                        pa.list_(pa.struct([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("entity", pa.int64()), ("key", pa.int64()), ("size", pa.int64())]))),
                ],
                ["part", "tokens", "keys", "sets"],
            )

    apart = classes_apart(t)

    def matrix_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _matrix_part(batches, apart)

    sent = written(
        docs.mapInArrow(send, "part int, tokens binary, keys binary, sets array<struct<doc_id:long,text_hash:long,entity:long,key:long,size:long>>"), "prefixes"
    )
    sets = written(sent.where("part = -1").select(F.inline("sets")), "sets")
    shared = sent.where("part >= 0").select("part", "tokens", "keys").groupBy("part").applyInArrow(matrix_part, "key long, group long, shared long")
    one = sets.groupBy("entity", "key").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("doc_id").alias("copies"), F.first("size").alias("size"))
    one = written(one.withColumn("group", F.shiftrightunsigned("key", 32)), "entities")
    ranges = one.groupBy("group").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    candidates = (
        shared.groupBy("key", "group").agg(F.sum("shared").alias("shared")).join(one.drop("group"), "key").join(ranges, "group")
        .where(F.col("shared") >= least_shared(t, F.col("size"), F.col("low")))
        .where((F.col("high") >= F.col("size") * t - 1e-9) & (F.col("low") * t - 1e-9 <= F.col("size")))
        .select("entity", "doc_id", "copies", "group")
    )
    candidates = written(candidates, "candidates", sent)
    # different sets of one key are alike to the matrix: their groups are opened in any case
    clash = one.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.shiftrightunsigned("key", 32).alias("group"))
    opened = candidates.select("group").unionByName(clash).distinct()
    members = one.join(opened, "group", "left_semi").select("entity", "doc_id", "copies", "group", F.lit(6).alias("role"))
    queries = candidates.join(members.select("entity", "group"), ["entity", "group"], "left_anti").select("entity", "doc_id", "copies", "group", F.lit(1).alias("role"))
    rows = written(members.unionByName(queries), "group-rows", candidates)
    # with a group of more than a cell holds, its members meet its queries (and members) in a grid of cells
    grid = rows.groupBy("group").agg(F.ceil(F.count_if(F.col("role") == 6) / MEMBERS).alias("across"), F.ceil(F.count("*") / QUERIES).alias("down"), F.count("*").alias("n")).where("n > 1")
    at = lambda n, seed: F.pmod(F.xxhash64("entity", F.lit(seed)), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    placed = rows.join(grid, "group")
    as_query = placed.select("entity", "doc_id", "copies", "group", F.explode(every("across")).alias("i"), at("down", 1).alias("j"), F.when(F.col("role") == 6, 2).otherwise(1).alias("role"))
    as_member = placed.where("role = 6").select("entity", "doc_id", "copies", "group", at("across", 2).alias("i"), F.explode(every("down")).alias("j"), F.lit(4).alias("role"))
    wanted = as_query.unionByName(as_member).groupBy("group", "i", "j", "entity").agg(F.sum("role").cast("int").alias("role"), F.first("doc_id").alias("doc_id"), F.first("copies").alias("copies"))
    wanted = written(wanted, "cells", rows)
    ids = written(wanted.select("doc_id").distinct(), "cell-documents")
    # text of other documents stays where it is
    needed = docs.select("doc_id", "text").join(broadcast_if_small(ids), "doc_id", "left_semi")
    with_text = wanted.join(needed, "doc_id").select("group", "i", "j", "entity", "role", "copies", "text")

    def verify(batches):
        cell, held, taken = None, Cell(), set()
        known: dict[int, np.ndarray] = {}  # sets that this task has made, up to KNOWN_TOKENS numbers
        room = KNOWN_TOKENS

        def flush():
            found = held.summary(t)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["entity", "root", "links"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:6]]
            new = [i for i, e in enumerate(columns[3]) if e not in known]
            fresh: dict[int, np.ndarray] = {}
            for lo, hi, texts in encoded_chunks(batch.column(6).take(pa.array(new, pa.int64()))):
                for i, s in zip(new[lo:hi], sets_of(Words(texts), n)):
                    # another row with this doc_id may have another text
                    if len(s) and np.array(set_hash(s), np.uint64).astype(np.int64) == columns[3][i]:
                        fresh[columns[3][i]] = s
            for *now, entity, role, copies in zip(*columns):
                if now != cell:
                    yield from flush()
                    cell, held, taken = now, Cell(), set()
                s = known[entity] if entity in known else fresh.get(entity)
                if s is not None and entity not in taken:
                    taken.add(entity)
                    held.add(entity, s, role, copies)
            for entity, s in fresh.items():
                if len(s) > room:
                    known, room = {}, KNOWN_TOKENS
                if len(s) <= room:
                    known[entity] = s
                    room -= len(s)
        yield from flush()

    found = with_text.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(verify, "entity long, root long, links long")
    found = written(found, "links", wanted, ids)
    discard(docs.sparkSession, one, filter_path.rpartition("/")[0])
    return sets, found


def _with_classes(sets: DataFrame, found: DataFrame) -> DataFrame:
    """``sets`` with class_id, the least doc_id that links connect a document to."""
    groups = components(found.select(F.col("entity").alias("a"), F.col("root").alias("b")))
    member = sets.join(groups, F.col("entity") == F.col("node"), "left").withColumn("component", F.coalesce("component", "entity")).drop("node")
    least = member.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return member.join(least, "component").drop("component")


def classes(docs: DataFrame, t: float = 0.4, n: int = 4) -> DataFrame:
    """(doc_id, class_id, links) of each document: the number of other documents whose similarity to it is ``t`` or
    more, and the least doc_id of all that links connect it to."""
    sets, found = join(docs, t, n)
    one = _with_classes(sets.select("doc_id", "entity").distinct(), found)
    links = found.groupBy("entity").agg(F.sum("links").alias("near"))
    copies = sets.groupBy("entity").agg(F.countDistinct("doc_id").alias("copies"))
    linked = one.join(copies, "entity").join(links, "entity", "left").select("doc_id", "class_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    none = every.join(sets.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return linked.unionByName(none)


def deduplicate(docs: DataFrame, t: float = 0.4, n: int = 4) -> DataFrame:
    """``docs`` with one document of each class; the least doc_id stays (of one doc_id, the text of least hash; of
    repeated rows, any one).  Documents without n-grams or doc_id stay."""
    sets, found = join(docs, t, n)
    groups = components(found.select(F.col("entity").alias("a"), F.col("root").alias("b")))
    member = (
        sets.select("doc_id", "text_hash", "entity").join(groups, F.col("entity") == F.col("node"), "left")
        .select(F.struct("doc_id", "text_hash").alias("d"), F.coalesce("component", "entity").alias("g"))
    )
    first = member.groupBy("g").agg(F.min("d").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = written(member.join(first, "g").where("d <> first").select("d.*").distinct(), "gone", found)
    repeated = written(sets.groupBy("doc_id", "text_hash").count().where("count > 1"), "repeated", sets, groups)
    gone, repeated = broadcast_if_small(gone), broadcast_if_small(repeated)

    def same(of: DataFrame):
        return (docs["doc_id"].cast("long") == of["doc_id"]) & (F.xxhash64(docs["text"]) == of["text_hash"])

    kept = docs.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, same(repeated), "left_anti").unionByName(kept.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))
