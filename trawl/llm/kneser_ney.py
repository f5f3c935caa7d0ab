"""Quality classifier: interpolated modified Kneser-Ney n-gram model of trusted text.

A language's trusted documents (labelled quality 1 and not toxic), in order of a hash of doc_id, in turn train its model
and calibrate it: all of them, none is left out.  The threshold of a language is a high quantile of the calibration documents'
perplexity.  A language with fewer than ``min_docs`` trusted documents to train on gets its perplexity from the model
of all languages together, but no threshold: other languages' documents say nothing of what is usual in it.  That
model is fitted only if there is such a language.

1. Each task counts the n-grams of its training text and sends them to shards by the hash of their last two words.  A
   shard holds all n-grams of at least two words that end so: it writes their counts, and continuation counts of the shorter ones.
   That takes several rounds over the text, each for some of the shards: only what is sent in one is on disk at once.
2. What it knows of contexts and of single words goes to shards by their own hash, which add it up and write it, in
   rounds too.  Counts of counts come back to the driver, which computes the discounts.

The files hold counts; probabilities are computed from what is looked up.  Scoring covers every document.  A task
sorts the n-gram keys of a piece of text and merge-joins them with the shards, one after the other: the model, a part of
the corpus, travels to the documents and no text is shuffled.

The classifier's perplexity draws short texts towards the language's mean: exp((nll + k m) / (n + k)) for n
words, k = ``prior_words`` and m the calibration mean a word; of two words one is often rare, which says little.

Defined results: a null or empty text, or one without words, has perplexity null and is rejected; a null
language counts as one of its own; a document with several rows of labels is trusted if all of them say so;
repeated rows get equal results; without a threshold (a language with too few trusted documents, or none at all) it
is null and every document that has words is kept; an empty table gives no rows; other columns are untouched.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trawl.llm._store import broadcast_if_small, discard, files_of, load_columns, new_path, save_columns, written
from trawl.llm._text import Words, encoded_chunks, mix, powers, release

#: Of text that is looked up at once, and cut into words at once.
SCORED_BYTES, CUT_BYTES = 1 << 22, 1 << 19
#: Of training text, for a shard; words that a task counts before it sends them.
SHARD_BYTES, COUNTED_WORDS = 1 << 22, 1_000_000
#: Rounds at most in which n-grams are sent; of training text, for a round.
ROUNDS, ROUND_BYTES = 4, 1 << 25
_START = np.uint64(0xA5A5A5A5DEADBEEF)
_BASE = powers(0xC2B2AE3D27D4EB4F, 8)
#: nll is summed in this unit, so that no order of summing matters.
_UNIT = 2.0**20


def _columns(hashes: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """The word at each position, the one before it, ...; before a text stand start marks."""
    n = len(hashes)
    back = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    out = [hashes]
    for m in range(1, order):
        shifted = np.full(n, _START)
        if m < n:
            ok = back[m:] >= m
            shifted[m:][ok] = hashes[: n - m][ok]
        out.append(shifted)
    return out


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """Key of the words whose last one is in the first column."""
    total = np.zeros(len(columns[0]), np.uint64)
    for c, b in zip(columns, _BASE):
        total += c * b
    return mix(total + np.uint64(len(columns)))


def _unique(a: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, where each first occurs, how often (with ``n``: where one counts as so many)."""
    at = np.argsort(a, kind="stable")
    s = a[at]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    if n is not None and len(s):
        return s[first], at[first], np.add.reduceat(n[at], first)
    return s[first], at[first], np.diff(np.concatenate([first, [len(s)]]))


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and of each value the sum for each."""
    at = np.argsort(keys, kind="stable")
    s = keys[at]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return [s[first], *(np.add.reduceat(v[at].astype(np.int64), first) if len(s) else v.astype(np.int64) for v in values)]


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def save_table(uri: str, key: np.ndarray, **values: np.ndarray) -> None:
    """Different values are few: they are stored once, and their number for each key."""
    code = np.zeros(len(key), np.int64)
    for v in values.values():
        distinct, at = np.unique(v, return_inverse=True)
        code = np.unique(code * max(1, len(distinct)) + at, return_inverse=True)[1]
    first = np.unique(code, return_index=True)[1]
    save_columns(f"{uri}.values", **{k: v[first] for k, v in values.items()})
    save_columns(uri, key=key, code=_small(code))


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def discounts(counts: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the counts of counts."""
    return discounts_of(counts_of_counts(counts))


def discounts_of(counted: list[int]) -> np.ndarray:
    n = [0.0, *map(float, counted)]
    if not n[1]:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[1] / (n[1] + 2 * n[2])
    d = [0.0] + [(i - (i + 1) * y * n[i + 1] / n[i]) if n[i] else i * 0.5 for i in (1, 2, 3)]
    return np.array([min(max(x, 0.05 * i), 0.95 * i) for i, x in enumerate(d)])


def edges_of(shards: int) -> np.ndarray:
    """Where ranges of keys begin, but for the first."""
    return np.array([-(-(i << 32) // shards) << 32 for i in range(1, shards)], np.uint64)


def count_grams(columns: list[np.ndarray], n: np.ndarray) -> tuple[dict[int, tuple[np.ndarray, ...]], dict[int, list[np.ndarray]]]:
    """Of words that occur n times: by order (key, count, where it occurs), where all but the highest order have
    continuation counts; and by order, for the contexts of its n-grams, (key, total, n-grams of count 1, of 2, of more)."""
    order, grams, contexts = len(columns), {}, {}
    key, at, count = _unique(_key(columns), n)
    for m in range(order, 0, -1):
        grams[m] = key, count, at
        if m > 1:
            contexts[m] = _summed(_key([c[at] for c in columns[1:m]]), count, count == 1, count == 2, count > 2)
            key, first, count = _unique(_key([c[at] for c in columns[: m - 1]]))
            at = at[first]
    return grams, contexts


def train(hashes: np.ndarray, bounds: np.ndarray, order: int) -> dict[str, np.ndarray]:
    """The model in one piece: tables as the shards', with the key by which each row has its shard."""
    columns = _columns(hashes, bounds, order)
    grams, contexts = count_grams(columns, np.ones(len(hashes), np.int64))
    d, total, unknown = weights({m: (*counts_of_counts(c), len(c), int(c.sum())) for m, (_, c, _) in grams.items()}, order)
    key, n, at = joined_grams(grams)
    return {
        "grams": {"key": key, "n": n, "home": _key([c[at] for c in columns[:2]])},
        "words": {"key": grams[1][0], "n": grams[1][1], "home": grams[1][0]},
        "contexts": dict(zip(("key", "total", "n1", "n2", "n3"), joined_contexts(list(contexts.values())))),
        "discounts": d, "total": total, "unknown": np.array([unknown]),
    }


def joined_grams(grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Those of at least two words, in order of their keys."""
    parts = [np.concatenate([np.zeros(0, kind), *(grams[m][i] for m in grams if m > 1)]) for i, kind in enumerate((np.uint64, np.int64, np.int64))]
    at = np.argsort(parts[0])
    return [x[at] for x in parts]


def joined_contexts(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Contexts of all orders: keys of different numbers of words differ."""
    return _summed(*(np.concatenate([np.zeros(0, np.uint64 if not i else np.int64), *(p[i] for p in parts)]) for i in range(5)))


def weights(counted: dict[int, tuple[int, ...]], order: int) -> tuple[np.ndarray, float, float]:
    """From (counts of counts, size, total) of each order: discounts by order, total of single words, log p of a new word."""
    d = np.array([discounts_of(counted[m][:4]) for m in range(1, order + 1)])
    n1, n2, _, _, size, total = counted[1]
    left = d[0][1] * n1 + d[0][2] * n2 + d[0][3] * (size - n1 - n2)
    return d, float(max(total, 1)), float(np.log(left / total / (size + 1))) if total else 0.0


class Shards:
    """A model as range shards of keys: ``grams`` by their last two words, ``words`` and ``contexts``."""

    def __init__(self, uri: str | None, tables: list[dict] | None, edges: np.ndarray, unknown: float, discounts: np.ndarray | None = None, total: float = 1.0, files: frozenset[str] = frozenset()):
        self.uri, self.edges, self.unknown, self.files = uri, edges, unknown, files
        self.d, self.total = (tables[0]["discounts"], tables[0]["total"]) if tables else (discounts, total)
        self.held = {(kind, i): t[kind] for i, t in enumerate(tables or []) for kind in ("grams", "words", "contexts")}

    def _table(self, kind: str, i: int) -> dict[str, np.ndarray] | None:
        """None of a range without keys, which has no file."""
        if (kind, i) not in self.held and f"{kind}-{i}" in self.files:
            self.held[kind, i] = load_columns(f"{self.uri}/{kind}-{i}") | load_columns(f"{self.uri}/{kind}-{i}.values")
        return self.held.get((kind, i))

    def find(self, kind: str, at: np.ndarray, home: np.ndarray, keys: list[np.ndarray], values: tuple[str, ...]) -> list[list[np.ndarray]]:
        """For each of several keys at each position, what the table has; 0 where it has none.  ``at``: order of ``home``,
        by which a position has its shard."""
        out = [[np.zeros(len(home), np.float32) for _ in values] for _ in keys]
        cut = np.searchsorted(home[at], self.edges)
        for i, (a, b) in enumerate(zip([0, *cut], [*cut, len(at)])):
            if a < b and (t := self._table(kind, i)) is not None and len(t["key"]):
                for key, own in zip(keys, out):
                    q = key[at[a:b]]
                    j = np.minimum(np.searchsorted(t["key"], q), len(t["key"]) - 1)
                    hit = np.flatnonzero(t["key"][j] == q)
                    which = t["code"][j[hit]] if "code" in t else j[hit]
                    for v, x in zip(values, own):
                        x[at[a:b][hit]] = t[v][which]
        return out

    def nll(self, hashes: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
        """Negative log-likelihood of each text."""
        if not len(hashes):
            return np.zeros(len(bounds) - 1)
        columns = _columns(hashes, bounds, order)
        keys = [_key(columns[: m + 1]) for m in range(order)]
        del columns
        sorted_by = [np.argsort(k) for k in keys[:2]]
        count = self.find("words", sorted_by[0], keys[0], keys[:1], ("n",)) + (self.find("grams", sorted_by[1], keys[1], keys[1:], ("n",)) if order > 1 else [])
        gain = lambda m, c: c - self.d[m][np.minimum(c, 3).astype(np.int8)]
        p = gain(0, count[0][0]) / self.total + np.exp(self.unknown)
        first = bounds[:-1][np.diff(bounds) > 0]
        for m in range(1, order):
            by = sorted_by[m - 1] if m <= 2 else np.argsort(keys[m - 1])
            own = self.find("contexts", by, keys[m - 1], [keys[m - 1]], ("total", "n1", "n2", "n3"))[0]
            mark = _key([np.full(1, _START)] * m)
            start = self.find("contexts", np.zeros(1, np.int64), mark, [mark], ("total", "n1", "n2", "n3"))[0]
            own = [np.concatenate([s, x[:-1]]) for s, x in zip(start, own)]  # of the words before each position
            for s, x in zip(start, own):
                x[first] = s
            total = np.maximum(own[0], 1)
            left = own[1] * self.d[m][1] + own[2] * self.d[m][2] + own[3] * self.d[m][3]
            p = np.where(own[0] > 0, (gain(m, count[m][0]) + left * p) / total, p)
        out = np.zeros(len(bounds) - 1)
        out[np.diff(bounds) > 0] = np.add.reduceat(-np.log(p), first)
        return out


def split(model: dict[str, np.ndarray], shards: int) -> tuple[list[dict[str, np.ndarray]], np.ndarray]:
    edges = edges_of(shards)
    tables = [{"discounts": model["discounts"], "total": model["total"]} for _ in range(shards)]
    for kind in ("grams", "words", "contexts"):
        t = model[kind]
        which = np.searchsorted(edges, t.get("home", t["key"]), side="right")
        at = np.argsort(t["key"])
        for i, own in enumerate(tables):
            own[kind] = {k: v[at[which[at] == i]] for k, v in t.items()}
    return tables, edges


def perplexity(nll, n, mean: float, prior_words: float):
    return np.exp(np.minimum((nll + prior_words * mean) / (n + prior_words), 700.0))


def hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and bounds of the words of texts, cut a piece at a time."""
    end = np.cumsum([len(t) for t in texts])
    hashes, sizes, a = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + CUT_BYTES, side="right")))
        words = Words(texts[a:b])
        hashes.append(words.hashes)
        sizes.append(np.diff(words.bounds))
        a = b
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _blob(a: np.ndarray, ascending: bool = False) -> bytes:
    """Byte plane by byte plane, compressed; of ascending numbers the differences."""
    a = np.diff(a, prepend=a.dtype.type(0)) if ascending else a
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unblob(block: pa.Scalar, kind, ascending: bool = False) -> np.ndarray:
    packed = block.as_py()
    planes = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd")
    a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)
    return np.cumsum(a, dtype=kind) if ascending else a


def _unblobbed(column: pa.ChunkedArray, kind, ascending: bool = False) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_unblob(b, kind, ascending) for b in column)])


def count_trusted(texts: DataFrame, order: int, shards: list[int], uri: str, rounds: int = 1, *used: DataFrame) -> dict[int, dict[int, tuple[int, ...]]]:
    """Write the shards of the models of ``texts`` (model, text); of each model and order, counts of counts, size and total.
    ``texts`` is read once a round; ``used``: tables of written() that nothing reads after that."""
    base = np.concatenate([[0], np.cumsum(shards)])
    edges = [edges_of(s) for s in shards]
    sent_as = ("words", "places", "n")

    def counted_in(turn: int):
        def count(batches):
            held: list[list[np.ndarray]] = []

            def flush():
                nonlocal held
                shard, *columns = (np.concatenate([h[i] for h in held]) for i in range(1 + order))
                held = []
                full = _key(columns)
                at = np.lexsort((full, shard))
                shard, full = shard[at], full[at]
                first = np.flatnonzero(np.concatenate([[True], (full[1:] != full[:-1]) | (shard[1:] != shard[:-1])]))
                n = np.diff(np.concatenate([first, [len(full)]])).astype(np.uint32)
                shard, columns = shard[first], [c[at][first] for c in columns]
                cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                ends = [*cut[1:], len(shard)]
                # different words are few: they are sent once, and their numbers at each place
                blobs = []
                for a, b in zip(cut, ends):
                    distinct, at = np.unique(np.concatenate([c[a:b] for c in columns]), return_inverse=True)
                    blobs.append((_blob(distinct, True), _blob(at.astype(np.uint32)), _blob(n[a:b])))
                return pa.RecordBatch.from_arrays([pa.array(shard[cut], pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*blobs))], ["shard", *sent_as])

            for batch in batches:
                for a, b, part in encoded_chunks(batch.column(1), CUT_BYTES):
                    cutted = Words(part)
                    of = np.repeat(batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False), np.diff(cutted.bounds))
                    columns = _columns(cutted.hashes, cutted.bounds, order)
                    home, shard = _key(columns[:2]), np.zeros(len(of), np.int64)
                    for g in np.unique(of):
                        shard[of == g] = base[g] + np.searchsorted(edges[g], home[of == g], side="right")
                    now = np.flatnonzero(shard % rounds == turn)
                    if len(now):
                        held.append([x[now] for x in (shard, *columns)])
                    if sum(len(h[0]) for h in held) >= COUNTED_WORDS:
                        yield flush()
            if held:
                yield flush()
            release()

        return count

    sums = ("n1", "n2", "n3", "n4", "size", "total")

    def told(model: int, counted: dict[int, np.ndarray]) -> list[dict]:
        """Rows of what the driver sums up."""
        return [{"shard": -1 - model, "m": m} | dict(zip(sums, (*counts_of_counts(c), len(c), int(c.sum())))) for m, c in counted.items()]

    part_schema = pa.schema([("shard", pa.int32()), ("m", pa.int32()), *((k, pa.binary()) for k in ("key", "a", "b", "c", "d")), *((k, pa.int64()) for k in sums)])

    def grams_of(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        g = int(np.searchsorted(base, shard, side="right")) - 1
        at = [_unblob(w, np.uint64, True)[_unblob(p, np.uint32)].reshape(order, -1) for w, p in zip(table.column("words"), table.column("places"))]
        grams, contexts = count_grams(list(np.concatenate(at, axis=1)), _unblobbed(table.column("n"), np.uint32).astype(np.int64))
        key, n, _ = joined_grams(grams)
        save_table(f"{uri}/{g}/grams-{shard - base[g]}", key, n=n)
        rows = told(g, {m: grams[m][1] for m in range(2, order + 1)})
        for m, columns in ((1, grams[1][:2]), (2, joined_contexts(list(contexts.values())))):
            cut = [0, *np.searchsorted(columns[0], edges[g]), len(columns[0])]
            for i, (a, b) in enumerate(zip(cut, cut[1:])):
                if a < b:
                    blobs = [_blob(columns[0][a:b], True), *(_blob(x[a:b].astype(np.uint64)) for x in columns[1:])]
                    rows.append({"shard": int(base[g]) + i, "m": m} | dict(zip(("key", "a", "b", "c", "d"), blobs)))
        del grams, contexts, key, n
        release()
        return pa.Table.from_pylist(rows, part_schema)

    def contexts_of(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        g = int(np.searchsorted(base, shard, side="right")) - 1
        m = table.column("m").to_numpy()
        own, others = table.filter(pa.array(m == 1)), table.filter(pa.array(m == 2))
        key, n = _summed(*(_unblobbed(own.column(k), np.uint64, k == "key") for k in ("key", "a")))
        save_table(f"{uri}/{g}/words-{shard - base[g]}", key, n=n)
        parts = _summed(*(_unblobbed(others.column(k), np.uint64, k == "key") for k in ("key", "a", "b", "c", "d")))
        save_table(f"{uri}/{g}/contexts-{shard - base[g]}", parts[0], **dict(zip(("total", "n1", "n2", "n3"), parts[1:])))
        release()
        return pa.Table.from_pylist(told(g, {1: n}), part_schema).select(["shard", "m", *sums])

    blobs = ", ".join(f"{k} binary" for k in sent_as)
    long = ", ".join(f"{k} long" for k in sums)
    told_as = f"shard int, m int, {long}"
    parts, ends = [], []
    # each written, for its shuffle files to go at once
    for turn in range(rounds):
        sent = texts.select("model", "text").mapInArrow(counted_in(turn), f"shard int, {blobs}")
        parts.append(written(sent.groupBy("shard").applyInArrow(grams_of, f"shard int, m int, key binary, a binary, b binary, c binary, d binary, {long}"), "parts"))
    discard(texts.sparkSession, *used)
    every = reduce(DataFrame.unionAll, parts)
    for turn in range(rounds):
        own = every.where(f"shard >= 0 and shard % {rounds} = {turn}")
        ends.append(written(own.groupBy("shard").applyInArrow(contexts_of, told_as), "counts"))
    rows = reduce(DataFrame.unionAll, ends, every.where("shard < 0").select("shard", "m", *sums))
    found: dict[int, dict[int, tuple[int, ...]]] = {g: {m: (0,) * 6 for m in range(1, order + 1)} for g in range(len(shards))}
    for r in rows.groupBy("shard", "m").agg(*(F.sum(k).alias(k) for k in sums)).collect():
        found[-1 - r.shard][r.m] = tuple(r[k] for k in sums)
    discard(texts.sparkSession, *parts, *ends)
    return found


def fit(docs: DataFrame, labels: DataFrame, order: int, min_docs: int, quantile: float, prior_words: float, shards: int) -> tuple[dict[str, dict], dict | None]:
    """The model of each language that has one, and that of all together if a language has none."""
    spark = docs.sparkSession
    trusted = (
        labels.where("doc_id is not null").groupBy("doc_id")
        .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .where("q = 1 and t = 0").select("doc_id")
    )
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    known = base.select("doc_id", "lang").join(trusted, "doc_id", "left_semi").distinct()
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # ranks alternate: of an odd number, one less calibrates
    roles = written(known.select("doc_id", "lang", (F.row_number().over(by_hash) % 2 == 1).alias("trains")), "roles")
    joined = broadcast_if_small(roles)
    sizes = base.select("doc_id", "lang", F.octet_length("text").alias("size")).where(F.col("text").rlike(r"[^ \t\n\r\x0b\f]")).join(joined, ["doc_id", "lang"], "left")
    # a row for each language and use
    counted = {(r.lang, r.trains): (r.n, r.size) for r in sizes.groupBy("lang", "trains").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    rows = lambda langs, trains: sum(counted.get((x, trains), (0, 0))[0] for x in langs)
    enough = lambda langs: rows(langs, True) >= max(1, min_docs) and rows(langs, False) >= max(1, min_docs - 1)
    every = sorted({x for x, _ in counted})
    groups = [[x] for x in every if enough([x])]
    pooled = len(groups) if len(groups) < len(every) and enough(every) else None
    if pooled is not None:
        groups.append(every)
    if not groups:
        discard(spark, roles)
        return {}, None
    in_model = {x: [g for g, langs in enumerate(groups) if x in langs] for x in every}
    models_of = F.create_map(*(y for x, gs in in_model.items() for y in (F.lit(x), F.array(*map(F.lit, gs)).cast("array<int>"))))
    used = base.where(F.col("lang").isin([x for x, gs in in_model.items() if gs])).join(joined, ["doc_id", "lang"])
    used = used.select("trains", F.explode(models_of[F.col("lang")]).alias("model"), "text")
    uri = new_path(spark, "kneser-ney")
    trained = [sum(counted.get((x, True), (0, 0))[1] for x in langs) for langs in groups]
    parts = [max(shards, -(-size // SHARD_BYTES)) for size in trained]
    rounds = min(ROUNDS, max(1, -(-sum(trained) // ROUND_BYTES)))
    trains, calibrates = (used.where(x).select("model", "text") for x in ("trains", "not trains"))
    stored = []
    if joined is roles:  # the join shuffles the texts: not in each round, nor beside the model
        stored = [trains, calibrates] = [written(trains, "trains"), written(calibrates, "calibrates")]
    models = []
    for g, told in count_trusted(trains, order, parts, uri, rounds, *stored[:1]).items():
        d, total, unknown = weights(told, order)
        models.append({"uri": f"{uri}/{g}", "files": files_of(f"{uri}/{g}"), "shards": parts[g], "unknown": unknown, "discounts": d, "total": total})

    def calibrate(batches):
        held: dict[int, Shards] = {}
        for batch in batches:
            for a, b, part in encoded_chunks(batch.column(1), SCORED_BYTES):
                of = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                for g in np.unique(of).tolist():
                    hashes, bounds = hashes_of([part[i] for i in np.flatnonzero(of == g)])
                    n = np.diff(bounds)
                    nll = opened(held, g, models[g]).nll(hashes, bounds, order)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), g, np.int32)), pa.array(nll), pa.array(n)], ["model", "nll", "n"])

    told = written(calibrates.mapInArrow(calibrate, "model int, nll double, n long").where("n > 0"), "calibration", roles, *stored[1:])
    for r in told.groupBy("model").agg(F.sum(F.round(F.col("nll") * _UNIT).cast("long")).alias("nll"), F.sum("n").alias("n")).collect():
        models[r.model] |= {"mean": r.nll / _UNIT / r.n, "threshold": None}
    mean = F.element_at(F.array(*(F.lit(m["mean"]) for m in models)), F.col("model") + 1)
    drawn = told.select("model", ((F.col("nll") + F.lit(prior_words) * mean) / (F.col("n") + F.lit(prior_words))).alias("x"))
    # the quantile of all, the higher of two: a task sorts the numbers of a language
    whole, ascending = Window.partitionBy("model"), Window.partitionBy("model").orderBy("x")
    place = F.ceil(F.lit(quantile) * (F.count("*").over(whole) - 1)) + 1
    for r in drawn.select("model", "x", (F.row_number().over(ascending) == place).alias("here")).where("here").collect():
        if r.model != pooled:
            models[r.model]["threshold"] = float(np.exp(min(r.x, 700.0)))
    discard(spark, told)
    return {langs[0]: m for g, (langs, m) in enumerate(zip(groups, models)) if g != pooled}, None if pooled is None else models[pooled]


def opened(held: dict, key, model: dict) -> Shards:
    if key not in held:
        held[key] = Shards(model["uri"], None, edges_of(model["shards"]), model["unknown"], model["discounts"], model["total"], model["files"])
    return held[key]


def score(docs: DataFrame, labels: DataFrame, order: int = 3, min_docs: int = 20, quantile: float = 0.995, prior_words: float = 20.0, shards: int = 8) -> DataFrame:
    """``docs`` with n_words, perplexity, threshold and keep appended (a column of ``docs`` with one of these names
    is replaced)."""
    models, pooled = fit(docs, labels, order, min_docs, quantile, prior_words, shards)
    added = ["n_words", "perplexity", "threshold", "keep"]
    docs = docs.drop(*added)
    names = docs.columns
    text_at, lang_at = names.index("text"), names.index("lang")

    def run(batches):
        held: dict[str | None, Shards] = {}
        for batch in batches:
            langs = [x or "" for x in batch.column(lang_at).to_pylist()]
            for a, b, part in encoded_chunks(batch.column(text_at), SCORED_BYTES):
                n, ppl, limit = np.zeros(b - a, np.int64), np.full(b - a, np.nan), np.full(b - a, np.nan)
                of: dict[str | None, list[int]] = {}
                for i, x in enumerate(langs[a:b]):
                    of.setdefault(x if x in models else None, []).append(i)
                for lang, rows in of.items():
                    hashes, bounds = hashes_of([part[i] for i in rows])
                    n[rows] = np.diff(bounds)
                    m = models.get(lang, pooled)
                    if m is None:
                        continue
                    if m["threshold"] is not None:
                        limit[rows] = m["threshold"]
                    nll = opened(held, lang, m).nll(hashes, bounds, order)
                    ppl[rows] = np.where(n[rows] > 0, perplexity(nll, n[rows], m["mean"], prior_words), np.nan)
                keep = (n > 0) & ~(ppl > limit)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(a, b - a) for c in batch.columns]
                    + [pa.array(n), pa.array(ppl, mask=np.isnan(ppl)), pa.array(limit, mask=np.isnan(limit)), pa.array(keep)],
                    names + added,
                )

    schema = T.StructType([*docs.schema.fields]).add("n_words", "long").add("perplexity", "double").add("threshold", "double").add("keep", "boolean")
    return docs.mapInArrow(run, schema)


def kept(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with the columns of ``docs`` and no other."""
    plain = docs.toDF(*[c if c in ("doc_id", "lang", "text") else f"c{i}" for i, c in enumerate(docs.columns)])
    return score(plain, labels, **parameters).where("keep").select(plain.columns).toDF(*docs.columns)
