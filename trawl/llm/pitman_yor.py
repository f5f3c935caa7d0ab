"""Language-model scoring with a hierarchical Pitman-Yor model of words.

The restaurant of the two words before (v, and the one before v by 16 bits of its hash) has that of v alone as
parent, and this one a model of spelling, so any word has a probability: restaurants of bytes, each of the last three
bytes of the word so far with that of the last two as parent, then the last one, the root, and the uniform
distribution.  Every restaurant grows out of the corpus: restaurants of words with its size, those of bytes up to
the number of byte strings that words have.

1. Spelling.  Each task counts the four-byte strings of its words and sends them to shards by the last byte of the
   context; a shard samples its restaurants, and rounds of sweeps alternate with reseating the root, whose 256
   dishes' customers are the shards' tables.
2. Words.  Each task sends (v, u, w, document, count) of its words, with the probability of the spelling of w, to
   the shard of v.  A v that is behind more words than half a shard has several restaurants, by the word before it, and
   frequent v are dealt out to the shards with least, so that no shard holds much more than others.  A shard holds its restaurants of both levels, samples their
   seating, and tells each document the sum of the log probabilities of its words.  Sums come back by block of documents.

Seating is sampled by Gibbs sweeps.  Given the c customers of a dish, the number t of their tables has, with discount
1/2, conditional probability proportional to

    G(2 theta + T + t) G(2 c - t) / (G(t) G(c - t + 1)) (2 p)^t        (G: the gamma function)

T being the other dishes' tables.  p is the probability of a fixed parent; where the parent is a restaurant too, its weight
of t more customers at the dish's tables there stands for p^t.  Up to ENUMERATED
customers it is drawn from that distribution itself; above, by a Metropolis step whose proposal is the limit for many
customers, 1 + a negative binomial variate, so that a dish of two billion customers costs as much as one of twenty.
Tables of a restaurant are customers of its parent.  A third of a level's dishes, taken at random, is drawn at once
(given the rest, not one after the other: the usual parallel form of the sampler).  The concentration theta of either
level of words is sampled too, by a Metropolis step a sweep.  Predictive probabilities are averaged over samples.

Defined results: words are what stands between ASCII white space, in lower case; a null or empty text, or one without
words, has 0 words and perplexity null; texts of any length are counted and scored whole; repeated rows count each and
get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm._store import discard, load_arrays, new_path, save_arrays, written
from trawl.llm._text import Words, encoded_chunks, input_parts, mix, release

THETA = 1.0
D = 0.5
ENUMERATED = 16
#: Of text, for a shard of words; words that a task gathers before it sends them.
SHARD_BYTES, SENT_WORDS = 1 << 22, 1_200_000
SPACE = 32


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: Stirling's series after a shift by 8."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def strings_of(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the words ``which``, and a space after each: the number of its four-byte string, from the
    farthest byte of its context to itself; before a word stand zero bytes.  Also where each word begins."""
    length = words.ends[which] - words.starts[which] + 1
    first = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(first[-1])
    offset = at - np.repeat(first[:-1], length)
    own = words.data[np.repeat(words.starts[which], length) + offset].astype(np.uint32)
    own[first[1:] - 1] = SPACE
    full = own.copy()
    for back in (1, 2, 3):
        ok = offset >= back
        full[ok] |= own[at[ok] - back] << np.uint32(8 * back)
    return full, first[:-1]


def counted(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    at = np.argsort(keys, kind="stable") if weight is not None else None
    s = keys[at] if at is not None else np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    if weight is None:
        return s[first], np.diff(np.concatenate([first, [len(s)]]))
    return s[first], (np.add.reduceat(weight[at], first) if len(s) else weight)


class Level:
    """Restaurants with contexts of one length.  A dish is (context, byte); dishes are sorted."""

    def __init__(self, dishes: np.ndarray, customers: np.ndarray):
        self.dishes, self.c = dishes, customers.astype(np.float64)
        self.t = np.ones(len(dishes))
        self.contexts, self.restaurant = np.unique(dishes >> np.uint32(8), return_inverse=True)

    def link(self, parent: Level | None, mask: int) -> None:
        """mask: bits of a dish that the parent's dish has."""
        if parent is not None:
            self.up = np.searchsorted(parent.dishes, self.dishes & np.uint32(mask))
            self.up_context = np.searchsorted(parent.contexts, self.contexts & np.uint32(mask >> 8))

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.contexts)
        return np.bincount(self.restaurant, self.c, n), np.bincount(self.restaurant, self.t, n)

    def probability(self, base: np.ndarray) -> np.ndarray:
        """Of each dish, given the parent's for each."""
        cc, tt = self.totals()
        return (self.c - D * self.t + (THETA + D * tt[self.restaurant]) * base) / (THETA + cc[self.restaurant])


def tables(rng: np.random.Generator, c: np.ndarray, t: np.ndarray, other: np.ndarray, p: np.ndarray, theta: float = THETA) -> np.ndarray:
    """One Metropolis step for the number of tables of each dish."""
    new = 1.0 + rng.negative_binomial(2 * theta + other + 1, 1 - np.minimum(p, 1 - 1e-9))
    ok = new <= c
    new = np.where(ok, new, t)
    weight = lambda x: log_gamma(2 * c - x) - log_gamma(c - x + 1) + x * math.log(2)
    return np.where(ok & (np.log(rng.random(len(c))) < weight(new) - weight(t)), new, t)


@dataclass(frozen=True)
class Above:
    """Of some dishes, their dish of the parent without their own tables: its customers and tables, and all customers
    of its restaurant."""

    c: np.ndarray
    t: np.ndarray
    total: np.ndarray
    theta: float

    def take(self, at: np.ndarray) -> Above:
        return Above(self.c[at], self.t[at], self.total[at], self.theta)

    def log_weight(self, t: np.ndarray) -> np.ndarray:
        """Of ``t`` more customers at the parent's dish, whose tables stay as many."""
        c = self.c + t
        return np.where(c >= self.t, log_gamma(2 * c - self.t) - log_gamma(np.maximum(c - self.t, 0) + 1) - 2 * t * math.log(2) - log_gamma(self.theta + self.total + t), -np.inf)

    def ratio(self, t: np.ndarray) -> np.ndarray:
        """Weight of ``t`` + 1 over that of ``t``."""
        c = self.c[:, None] + t
        one = self.t[:, None]
        return (2 * c - one) * (2 * c - one + 1) / (4 * np.maximum(c - one + 1, 1)) / (self.theta + self.total[:, None] + t)


def drawn(rng: np.random.Generator, c: np.ndarray, t: np.ndarray, other: np.ndarray, p: np.ndarray, theta: float, above: Above | None = None) -> np.ndarray:
    """The number of tables of each dish, from its distribution given the other dishes' tables: with ``above`` given
    the parent's tables too, else with a parent of fixed probability ``p``."""
    out = t.copy()
    for n in range(2, ENUMERATED + 1):
        at = np.flatnonzero(c == n)
        if len(at):
            step = np.arange(1, n)
            ratio = (2 * theta + other[at, None] + step) * ((n - step) / (step * (2 * n - step - 1.0))) * 2
            ratio = ratio * (p[at, None] if above is None else above.take(at).ratio(step))
            weight = np.concatenate([np.ones((len(at), 1)), np.cumprod(ratio, axis=1)], axis=1)
            if above is not None:
                weight[np.arange(1, n + 1) + above.c[at, None] < above.t[at, None]] = 0
            weight = np.cumsum(weight, axis=1)
            out[at] = 1 + (rng.random((len(at), 1)) * weight[:, -1:] > weight).sum(axis=1)
    at = np.flatnonzero(c > ENUMERATED)
    if len(at):
        now = np.minimum(t[at], c[at])
        new = tables(rng, c[at], now, other[at], p[at], theta)
        if above is not None:
            # tables() is right for fixed p: what the parent's weight differs by is a second acceptance
            own = above.take(at)
            log_p = np.log(np.maximum(p[at], 1e-300))
            gain = own.log_weight(new) - own.log_weight(now) - (new - now) * log_p
            new = np.where(np.log(rng.random(len(at))) < gain, new, now)
        out[at] = new
    return out


class Restaurants:
    """Restaurants of two words over those of one, of a shard: dishes (context, word) with their customers.  Totals of
    restaurants follow each change; only dishes of several customers are ever drawn."""

    def __init__(self, of_two: np.ndarray, of_one: np.ndarray, up: np.ndarray, customers: np.ndarray, base: np.ndarray):
        """Of each dish of two words the restaurant, its dish of one word and customers; of each dish of one word the
        restaurant and the probability of its spelling."""
        self.restaurant, self.up = [of_two, of_one], up
        self.base, self.theta = base, [THETA, THETA]
        self.c = [customers.astype(np.float64), np.bincount(up, minlength=len(of_one)).astype(np.float64)]
        self.t = [np.ones(len(c)) for c in self.c]
        self.cc = [np.bincount(r, c) for r, c in zip(self.restaurant, self.c)]
        self.tt = [np.bincount(r, t) for r, t in zip(self.restaurant, self.t)]
        self.drawn_of_two = np.flatnonzero(self.c[0] > 1)

    def probability(self, i: int) -> np.ndarray:
        """Of each dish of the level."""
        below = self.base if i else self.probability(1)[self.up]
        r, theta = self.restaurant[i], self.theta[i]
        left = (theta + D * self.tt[i]) / (theta + self.cc[i])
        return (self.c[i] - D * self.t[i]) / (theta + self.cc[i])[r] + left[r] * below

    def _set_tables(self, i: int, at: np.ndarray, t: np.ndarray) -> None:
        change = t - self.t[i][at]
        moved = np.flatnonzero(change)
        at, change = at[moved], change[moved]
        self.t[i][at] += change
        np.add.at(self.tt[i], self.restaurant[i][at], change)
        if not i:
            up = self.up[at]
            np.add.at(self.c[1], up, change)
            np.add.at(self.cc[1], self.restaurant[1][up], change)
            # no more tables than customers; drawn anew in this sweep
            over = up[self.t[1][up] > self.c[1][up]]
            if len(over):
                over = np.unique(over)
                self._set_tables(1, over, self.c[1][over])

    def sweep(self, rng: np.random.Generator) -> None:
        for i in (0, 1):
            several = self.drawn_of_two if not i else np.flatnonzero(self.c[1] > 1)
            third = rng.integers(0, 3, len(several))
            for now in range(3):
                at = several[third == now]
                if not len(at):
                    continue
                p, above = (self.base[at], None) if i else self._without_own(at)
                other = self.tt[i][self.restaurant[i][at]] - self.t[i][at]
                self._set_tables(i, at, drawn(rng, self.c[i][at], self.t[i][at], other, np.minimum(p, 1.0), self.theta[i], above))
            self._concentration(rng, i)

    def _without_own(self, at: np.ndarray) -> tuple[np.ndarray, Above]:
        """The parent's probability of some dishes of two words, each without its own tables among the customers."""
        up, own, theta = self.up[at], self.t[0][at], self.theta[1]
        r = self.restaurant[1][up]
        c = self.c[1][up] - own
        t = np.minimum(self.t[1][up], c)
        left = theta + D * (self.tt[1][r] - self.t[1][up] + t)
        total = self.cc[1][r] - own
        return (c - D * t + left * self.base[up]) / (theta + total), Above(c, self.t[1][up], total, theta)

    def _concentration(self, rng: np.random.Generator, i: int) -> None:
        several = self.cc[i] > 1  # a restaurant of one customer says nothing
        # few numbers of customers and tables are different
        (c, n_c), (t, n_t) = (np.unique(x[several], return_counts=True) for x in (self.cc[i], self.tt[i]))

        def log_p(x: float) -> float:
            one = log_gamma(np.array([x, 2 * x]))
            return float((n_t * (log_gamma(2 * x + t) - one[1])).sum() - (n_c * (log_gamma(x + c) - one[0])).sum()) - x

        now = self.theta[i]
        new = now * math.exp(rng.normal(0, 0.3))
        if len(c) and math.log(1 - rng.random()) < log_p(new) - log_p(now) + math.log(new / now):
            self.theta[i] = new


class Shard:
    """Restaurants of bytes whose contexts end in the same byte."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray):
        self.levels = [Level(strings, counts)]
        for mask in (0xFFFFFF, 0xFFFF):
            below = self.levels[-1]
            dishes, customers = counted(below.dishes & np.uint32(mask), below.t)
            self.levels.append(Level(dishes, customers))
            below.link(self.levels[-1], mask)
        self.levels[-1].link(None, 0)

    def base(self, level: int, root: np.ndarray) -> np.ndarray:
        """For each dish of the level, the parent's probability of it."""
        p = root[(self.levels[-1].dishes & np.uint32(255)).astype(np.int64)]
        for i in range(len(self.levels) - 1, level, -1):
            p = self.levels[i].probability(p)[self.levels[i - 1].up]
        return p

    def sweep(self, rng: np.random.Generator, root: np.ndarray) -> None:
        for i, level in enumerate(self.levels):
            half = rng.random(len(level.c)) < 0.5
            for chosen in (half, ~half):
                at = np.flatnonzero(chosen & (level.c > 1))
                if not len(at):
                    continue
                p = self.base(i, root)
                if i + 1 < len(self.levels):
                    p = self._without_own(i, p, root)
                _, tt = level.totals()
                level.t[at] = tables(rng, level.c[at], level.t[at], (tt[level.restaurant] - level.t)[at], p[at])
                if i + 1 < len(self.levels):
                    above = self.levels[i + 1]
                    above.c = np.bincount(level.up, level.t, len(above.c))
                    above.t = np.minimum(above.t, above.c)

    def _without_own(self, i: int, p: np.ndarray, root: np.ndarray) -> np.ndarray:
        """The parent's probability of each dish, the dish's own tables not being among its customers."""
        level, above = self.levels[i], self.levels[i + 1]
        cc, tt = above.totals()
        r = above.restaurant[level.up]
        c = above.c[level.up] - level.t
        t = np.minimum(above.t[level.up], c)
        left = THETA + D * (tt[r] - above.t[level.up] + t)
        return (c - D * t + left * self.base(i + 1, root)[level.up]) / (THETA + cc[r] - level.t)

    def predictive(self, root: np.ndarray) -> list[np.ndarray]:
        """For each level, from the longest context on, a row of 256 for each restaurant."""
        out: list[np.ndarray] = []
        parent = root[None, :]
        for level in reversed(self.levels):
            cc, tt = level.totals()
            row = parent[np.zeros(len(level.contexts), np.int64) if len(out) == 0 else level.up_context]
            row = row * ((THETA + D * tt) / (THETA + cc))[:, None]
            row[level.restaurant, (level.dishes & np.uint32(255)).astype(np.int64)] += (level.c - D * level.t) / (THETA + cc)[level.restaurant]
            out.append(row)
            parent = row
        return out[::-1]


def root_probability(rng: np.random.Generator, customers: np.ndarray, sweeps: int) -> np.ndarray:
    """The root's predictive distribution, averaged over a few seatings of its 256 dishes."""
    served = np.flatnonzero(customers)
    c, t, total = customers[served], np.ones(len(served)), np.zeros(256)
    uniform = np.full(len(served), 1 / 256)
    for _ in range(sweeps):
        t = tables(rng, c, t, t.sum() - t, uniform) if len(c) else t
        p = np.full(256, (THETA + D * t.sum()) / (THETA + c.sum()) / 256)
        p[served] += (c - D * t) / (THETA + c.sum())
        total += p
    return total / sweeps


def count_strings(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, strings, counts): blocks of uint32 strings and int64 counts; with shard -1, hashes and counts of words
    that are more than a sixteenth of what a shard of words holds."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        often: dict[int, int] = {}
        for batch in batches:
            for _, _, texts in encoded_chunks(batch.column(0)):
                words = Words(texts)
                if not len(words.hashes):
                    continue
                distinct, at, n = np.unique(words.hashes, return_index=True, return_counts=True)
                for i in np.flatnonzero(n * 16.0 * shards > len(words.hashes)).tolist():
                    often[int(distinct[i])] = often.get(int(distinct[i]), 0) + int(n[i])
                strings, first = strings_of(words, at)
                held.append(counted(strings, np.repeat(n, np.diff(np.concatenate([first, [len(strings)]])))))
                if sum(len(k) for k, _ in held) > 1_000_000:
                    held = [counted(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))]
        if not held:
            return
        keys, counts = counted(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
        shard = (keys >> np.uint32(8)) & np.uint32(255)
        at = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[at], np.arange(257))
        full = np.flatnonzero(np.diff(cut)).tolist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*full, -1], pa.int32()),
                pa.array([keys[at[cut[s] : cut[s + 1]]].tobytes() for s in full] + [np.array(list(often), np.uint64).tobytes()], pa.binary()),
                pa.array([counts[at[cut[s] : cut[s + 1]]].astype(np.int64).tobytes() for s in full] + [np.array(list(often.values()), np.int64).tobytes()], pa.binary()),
            ],
            ["shard", "strings", "counts"],
        )

    return docs.select("text").mapInArrow(run, "shard int, strings binary, counts binary")


def fit(docs: DataFrame, shards_of_words: int, burn_in: int = 8, samples: int = 8, rounds: int = 2, seed: int = 1) -> tuple[str, list[int], np.ndarray, dict[int, int]]:
    """Spelling: path of the shards' files, their numbers, the root's distribution; and how often frequent words occur."""

    def gather(table: pa.Table) -> pa.Table:
        kind = np.uint64 if table.column("shard")[0].as_py() < 0 else np.uint32
        keys, counts = counted(
            np.concatenate([np.frombuffer(b.as_py(), kind) for b in table.column("strings")]),
            np.concatenate([np.frombuffer(b.as_py(), np.int64) for b in table.column("counts")]),
        )
        return pa.table({"shard": table.column("shard")[:1].cast(pa.int32()), "strings": pa.array([keys.tobytes()]), "counts": pa.array([counts.tobytes()])})

    spark = docs.sparkSession
    strings = written(count_strings(docs, shards_of_words).groupBy("shard").applyInArrow(gather, "shard int, strings binary, counts binary"), "strings")
    often: dict[int, int] = {}
    for r in strings.where("shard < 0").collect():  # at most 16 for each shard of words and piece of text
        often = dict(zip(np.frombuffer(r.strings, np.uint64).tolist(), np.frombuffer(r.counts, np.int64).tolist()))
    path = new_path(spark, "pitman-yor")
    root = np.full(256, 1 / 256)
    shards: list[int] = []
    for number in range(rounds):
        last = number == rounds - 1

        def sample(batches, root=root, number=number, last=last):
            for batch in batches:
                for s, k, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    rng = np.random.Generator(np.random.PCG64([seed, number, s]))
                    shard = Shard(np.frombuffer(k, np.uint32), np.frombuffer(c, np.int64))
                    for _ in range(burn_in):
                        shard.sweep(rng, root)
                    if last:
                        rows = None
                        for _ in range(samples):
                            shard.sweep(rng, root)
                            p = shard.predictive(root)
                            rows = p if rows is None else [a + b for a, b in zip(rows, p)]
                        _save(f"{path}/{s}.npz", shard, [r / samples for r in rows])
                    top = shard.levels[-1]
                    served = np.zeros(256)
                    served[(top.dishes & np.uint32(255)).astype(np.int64)] = top.t
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([served.tolist()], pa.list_(pa.float64()))], ["shard", "tables"])

        # 256 numbers from each of at most 256 shards, whatever the input
        told = strings.where("shard >= 0").repartition(64, "shard").mapInArrow(sample, "shard int, tables array<double>").collect()
        shards = sorted(r.shard for r in told)
        if not last:
            customers = np.sum([r.tables for r in told], axis=0) if told else np.zeros(256)
            root = root_probability(np.random.Generator(np.random.PCG64([seed, number])), customers, samples)
    discard(spark, strings)
    return path, shards, root, often


def _save(uri: str, shard: Shard, rows: list[np.ndarray]) -> None:
    """All rows of a shard, and which one serves each pair of farther context bytes."""
    three, two, _ = shard.levels
    which = np.zeros(1 << 16, np.int32)  # row 0: the restaurant of the last byte alone
    second = np.zeros(256, np.int32)
    second[(two.contexts >> np.uint32(8)).astype(np.int64)] = 1 + np.arange(len(two.contexts))
    which[:] = np.tile(second, 256)
    which[(three.contexts >> np.uint32(8)).astype(np.int64)] = 1 + len(two.contexts) + np.arange(len(three.contexts))
    save_arrays(uri, which=which, log_p=np.log(np.concatenate(rows[::-1])).astype(np.float32))


class Model:
    """Spelling.  Reads the shards' files as they are needed and holds up to ``held_bytes`` of them."""

    def __init__(self, path: str, shards: list[int], root: np.ndarray, held_bytes: int = 1 << 28):
        self.path, self.shards, self.root, self.room = path, set(shards), np.log(root), held_bytes
        self.held: dict[int, dict[str, np.ndarray]] = {}

    def _shard(self, s: int) -> dict[str, np.ndarray]:
        if s in self.held:
            return self.held[s]
        loaded = load_arrays(f"{self.path}/{s}.npz")
        size = sum(a.nbytes for a in loaded.values())
        if size <= self.room:
            self.room -= size
            self.held[s] = loaded
        return loaded

    def log_probability(self, strings: np.ndarray) -> np.ndarray:
        last = ((strings >> np.uint32(8)) & np.uint32(255)).astype(np.uint8)
        at = np.argsort(last, kind="stable")
        cut = np.searchsorted(last[at], np.arange(256))
        out = np.empty(len(strings))
        for s, (a, b) in enumerate(zip(cut, [*cut[1:], len(at)])):
            if a < b:
                x = strings[at[a:b]]
                if s in self.shards:
                    m = self._shard(s)
                    out[at[a:b]] = m["log_p"][m["which"][(x >> np.uint32(16)).astype(np.int64)], (x & np.uint32(255)).astype(np.int64)]
                else:
                    out[at[a:b]] = self.root[(x & np.uint32(255)).astype(np.int64)]
        return out


def _planes(a: np.ndarray) -> bytes:
    """Byte plane by byte plane."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unplanes(block: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


#: What is sent of a word in its place: hash of v, of u, of the word, -log of its spelling's probability, document in the block, count.
SENT = {"v": np.uint64, "u": np.uint16, "w": np.uint32, "p": np.float16, "doc": np.uint32, "n": np.uint32}
V_BITS = 40


def placed(often: dict[int, int], words: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent v in order, where each one's pieces begin, and the pieces' shards: the largest first, each to the shard that
    has least of them, those of one v to different shards as far as there are so many."""
    pieces = {h: max(1, -(-2 * n * shards // max(1, words))) for h, n in often.items()}
    least = [(0.0, s) for s in range(shards)]
    where: dict[int, list[int]] = {}
    for h in sorted(often, key=lambda h: (-often[h] / pieces[h], h)):
        taken = [heapq.heappop(least) for _ in range(min(pieces[h], shards))]
        where[h] = [taken[i % len(taken)][1] for i in range(pieces[h])]
        for i, (load, s) in enumerate(taken):
            heapq.heappush(least, (load + often[h] / pieces[h] * len(range(i, pieces[h], len(taken))), s))
    v = sorted(often)
    return np.array(v, np.uint64), np.cumsum([0, *(pieces[h] for h in v)]), np.array([s for h in v for s in where[h]], np.int64)


def shard_of(v: np.ndarray, u: np.ndarray, often: dict[int, int], words: int, shards: int, places: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Shard of each word; frequent v are spread over several, by u."""
    frequent, first, where = places or placed(often, words, shards)
    out = (mix(v) % np.uint64(shards)).astype(np.int64)
    if len(frequent):
        j = np.minimum(np.searchsorted(frequent, v), len(frequent) - 1)
        at = np.flatnonzero(frequent[j] == v)
        j = j[at]
        piece = mix(u[at].astype(np.uint64)) % (first[j + 1] - first[j]).astype(np.uint64)
        out[at] = where[first[j] + piece.astype(np.int64)]
    return out


def send_words(docs: DataFrame, path: str, byte_shards: list[int], root: np.ndarray, often: dict[int, int], shards: int, n_words: int) -> DataFrame:
    """Blocks (shard, block, columns of SENT), and with shard -1 the block's documents (doc_id, number of words)."""
    places = placed(often, n_words, shards)

    def run(batches):
        from pyspark import TaskContext

        model, block = Model(path, byte_shards, root), TaskContext.get().partitionId() << 32
        held: list[list[np.ndarray]] = []
        ids: list[pa.Array] = []
        sizes: list[np.ndarray] = []

        def flush():
            """The block of what is held; its arrays are gone before it is sent."""
            nonlocal block, held, ids, sizes
            v, u, w, p, doc = (np.concatenate([h[i] for h in held]) for i in range(5))
            held = []
            shard = shard_of(v, u, often, n_words, shards, places)
            v >>= np.uint64(64 - V_BITS)
            # by shard, v, u, word and document
            at = np.argsort(v << np.uint64(16) | u)
            context = _numbered((v << np.uint64(16) | u)[at])
            key = context << 32 | w[at].astype(np.int64)
            order = np.argsort(key)
            at = at[order]
            at = at[np.argsort(_numbered(key[order]) << 32 | doc[at].astype(np.int64))]
            at = at[np.argsort(shard[at], kind="stable")]
            shard, v, u, w, p, doc = (x[at] for x in (shard, v, u, w, p, doc))
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (u[1:] != u[:-1]) | (doc[1:] != doc[:-1]) | (shard[1:] != shard[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.concatenate([first, [len(v)]])).astype(np.uint32)
            columns = {"v": v[first], "u": u[first], "w": w[first], "p": p[first], "doc": doc[first], "n": n}
            cut = np.concatenate([[0], np.searchsorted(shard[first], np.arange(1, shards)), [len(first)]])
            full = np.flatnonzero(np.diff(cut)).tolist()
            blobs = []
            for k, x in columns.items():
                if k == "v":  # ascending in a shard
                    x = [np.diff(x[cut[s] : cut[s + 1]], prepend=np.uint64(0)) for s in full]
                else:
                    x = [x[cut[s] : cut[s + 1]] for s in full]
                blobs.append(pa.array([None, *map(_planes, x)], pa.binary()))
            total = np.concatenate(sizes)
            sent = pa.RecordBatch.from_arrays(
                [pa.array([-1, *full], pa.int32()), pa.array([block] * (1 + len(full)), pa.int64()), *blobs,
                 pa.array([pa.concat_arrays(ids).to_pylist(), *[None] * len(full)], pa.list_(pa.int64())), pa.array([total.tolist(), *[None] * len(full)], pa.list_(pa.int64()))],
                ["shard", "block", *columns, "doc_ids", "n_words"],
            )
            block, ids, sizes = block + 1, [], []
            return sent

        for batch in batches:
            for a, b, texts in encoded_chunks(batch.column(1)):
                words = Words(texts)
                before = sum(map(len, sizes))
                ids.append(batch.column(0).slice(a, b - a))
                sizes.append(np.diff(words.bounds))
                h = words.hashes
                if len(h):
                    distinct, at, which = np.unique(h, return_index=True, return_inverse=True)
                    strings, first = strings_of(words, at)
                    p = np.minimum(np.add.reduceat(-model.log_probability(strings), first), 65_504).astype(np.float16)[which]
                    place = np.arange(len(h)) - np.repeat(words.bounds[:-1], sizes[-1])
                    v, u = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint16)
                    v[1:] = np.where(place[1:] > 0, h[:-1], 0)
                    u[2:] = np.where(place[2:] > 1, (h[:-2] >> np.uint64(48)).astype(np.uint16), 0)
                    held.append([v, u, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), p, (before + words.text_of_word()).astype(np.uint32)])
                if sum(len(x[0]) for x in held) >= SENT_WORDS:
                    yield flush()
                    release()
        if ids:
            if not held:
                held.append([np.zeros(0, k) for k in (np.uint64, np.uint16, np.uint32, np.float16, np.uint32)])
            yield flush()
            release()

    columns = ", ".join(f"{k} binary" for k in SENT)
    return docs.mapInArrow(run, f"shard int, block long, {columns}, doc_ids array<long>, n_words array<long>")


def seated(v: np.ndarray, u: np.ndarray, w: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[Restaurants, np.ndarray]:
    """The restaurants of a shard, and for each row its dish of two words."""
    two = v << np.uint64(16) | u.astype(np.uint64)
    at = np.argsort(two)
    context = _numbered(two[at])
    key = context << 32 | w[at].astype(np.int64)
    order = np.argsort(key)
    at, key, context = at[order], key[order], context[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    dish = np.empty(len(at), np.int64)
    dish[at] = np.cumsum(new) - 1
    customers = np.add.reduceat(n[at].astype(np.int64), first)
    at, of_two = at[first], context[first]
    # contexts of two words ascend with the word that ends them
    one_key = _numbered(v[at]) << 32 | w[at].astype(np.int64)
    order = np.argsort(one_key)
    number = _numbered(one_key[order])
    up = np.empty(len(at), np.int64)
    up[order] = number
    where = order[np.flatnonzero(np.diff(number, prepend=-1))]
    base = np.exp(-p[at][where].astype(np.float64))
    return Restaurants(of_two, one_key[where] >> 32, up, customers, base), dish


def _numbered(ascending: np.ndarray) -> np.ndarray:
    """0 for the first value, 1 for the next different one, ..."""
    new = np.zeros(len(ascending), np.int64)
    new[1:] = ascending[1:] != ascending[:-1]
    return np.cumsum(new)


def score(docs: DataFrame, burn_in: int = 6, samples: int = 4, rounds: int = 2, seed: int = 1) -> DataFrame:
    """(doc_id, n_words, log_probability, perplexity) of each row, perplexity by word."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = input_parts(docs, SHARD_BYTES)
    path, byte_shards, root, often = fit(chosen, shards, burn_in, samples, rounds, seed)
    # what frequent words are counted against: about one word for six bytes
    n_words = max(1, shards * SHARD_BYTES // 6)
    sent = send_words(chosen, path, byte_shards, root, often, shards, n_words)

    def sample(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blocks = table.column("block").to_pylist()
        if shard < 0:
            return pa.table({"block": table.column("block"), "docs": pa.nulls(len(blocks), pa.binary()), "sums": pa.nulls(len(blocks), pa.binary()), "doc_ids": table.column("doc_ids"), "n_words": table.column("n_words")})
        parts = {k: [_unplanes(b.as_py(), kind) for b in table.column(k)] for k, kind in SENT.items()}
        parts["v"] = [np.cumsum(x, dtype=np.uint64) for x in parts["v"]]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in parts["n"]])])
        c = {k: np.concatenate(x) for k, x in parts.items()}
        del parts
        rng = np.random.Generator(np.random.PCG64([seed, shard]))
        model, dish = seated(c.pop("v"), c.pop("u"), c.pop("w"), c.pop("p"), c["n"])
        release()
        for _ in range(burn_in):
            model.sweep(rng)
        mean = np.zeros(len(model.c[0]))
        for _ in range(samples):
            model.sweep(rng)
            mean += model.probability(0)
        log_p = np.log(mean / samples)[dish] * c["n"]
        docs_of, sums = [], []
        for a, b in zip(edges, edges[1:]):
            which, place = np.unique(c["doc"][a:b], return_inverse=True)
            docs_of.append(which.tobytes())
            sums.append(np.bincount(place, log_p[a:b]).astype(np.float32).tobytes())
        del model, dish, c, log_p
        release()
        return pa.table({"block": pa.array(blocks, pa.int64()), "docs": pa.array(docs_of, pa.binary()), "sums": pa.array(sums, pa.binary()), "doc_ids": pa.nulls(len(blocks), pa.list_(pa.int64())), "n_words": pa.nulls(len(blocks), pa.list_(pa.int64()))})

    def gather(table: pa.Table) -> pa.Table:
        told = np.flatnonzero(table.column("doc_ids").is_valid().to_numpy())
        ids, n = (table.column(k)[int(told[0])].values for k in ("doc_ids", "n_words"))
        total = np.zeros(len(ids))
        for d, x in zip(table.column("docs"), table.column("sums")):
            if d.is_valid:
                total[np.frombuffer(d.as_py(), np.uint32)] += np.frombuffer(x.as_py(), np.float32)
        n = n.to_numpy(zero_copy_only=False)
        ppl = np.exp(np.minimum(-total / np.maximum(n, 1), 700.0))
        return pa.table({"doc_id": ids, "n_words": pa.array(n), "log_probability": pa.array(total), "perplexity": pa.array(ppl, mask=n == 0)})

    sums = sent.withColumn("salt", F.when(F.col("shard") < 0, F.col("block")).otherwise(0)).groupBy("shard", "salt").applyInArrow(
        sample, "block long, docs binary, sums binary, doc_ids array<long>, n_words array<long>"
    )
    sums = written(sums, "sums", path)
    return sums.groupBy("block").applyInArrow(gather, "doc_id long, n_words long, log_probability double, perplexity double")
