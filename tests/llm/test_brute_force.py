"""Each operator against a plain version of the same."""

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.llm import _components, _store, bpe, caps, chat, jaccard, kneser_ney, licences, packing, pitman_yor, queries, repeats, topk
from trawl.llm._text import Words, mix, window_hashes

WORDS = [f"w{i}" for i in range(60)]


def _texts(n, seed, long=60):
    """Random texts, copies, and copies with changes and shared passages."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.3:
            words = rng.choice(out).split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
        elif out and kind < 0.5:
            words = rng.choice(out).split()[:20] + [rng.choice(WORDS) for _ in range(rng.randrange(1, 30))]
        else:
            words = [rng.choice(WORDS) for _ in range(rng.randrange(1, long))]
        out.append(" ".join(words))
    return out


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def _unit(n, dim, rng):
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_caps_recall(spark):
    rng = np.random.default_rng(5)
    base = _unit(1500, 48, rng)
    near = base[:500] + 0.055 * rng.standard_normal((500, 48))
    group = base[0] + 0.01 * rng.standard_normal((60, 48))
    x = np.concatenate([base, near, group])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    found = {(r.vec_a, r.vec_b): r.cosine for r in caps.near_pairs(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = u @ u.T
    i, j = np.nonzero(np.triu(cosine >= 0.9, 1))
    truth = set(zip(i.tolist(), j.tolist()))
    assert set(found) <= truth and len(found) >= 0.97 * len(truth) > 1500
    assert all(abs(cosine[k] - v) < 1e-9 for k, v in found.items())


def _vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("tile", [4096, 16])
def test_classes_of_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(caps, "TILE", tile)
    rng = np.random.default_rng(8)
    x = _unit(300, 24, rng)
    x = np.concatenate([x, x[:40] + 0.02 * rng.standard_normal((40, 24)), x[:30], np.repeat(x[:1], 60, axis=0), x[0] + 0.01 * rng.standard_normal((50, 24))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.9, 1)))]
    links = Counter(i for p in pairs for i in p)
    got = {r.vec_id: (r.class_id, r.links) for r in caps.classes(_vectors(spark, x)).collect()}
    assert got == {i: (g, links[i]) for i, g in enumerate(plain_groups(pairs, len(x)))}
    kept = {r.vec_id for r in caps.deduplicate(_vectors(spark, x)).collect()}
    assert kept == set(plain_groups(pairs, len(x)))


def test_list_decoding_is_complete():
    code = caps.Code(3, 9, 0.27)
    d = caps.Decoder(code, 20)
    unit = _unit(50, 20, np.random.default_rng(1))
    row, name = d.filters(unit)
    rotated = unit @ d.rotation
    whole = np.stack([np.concatenate([d.books[0][a], d.books[1][b], d.books[2][c]]) for a in range(9) for b in range(9) for c in range(9)])
    assert np.allclose(np.linalg.norm(whole, axis=1), 1, atol=1e-5)
    i, j = np.nonzero(rotated @ whole.T >= d.alpha)
    assert len(set(zip(i, j)) ^ set(zip(row, name))) <= 1 + len(i) // 1000  # single precision


@pytest.mark.parametrize("n,dim", [(10**5, 16), (10**6, 64), (10**6, 384), (10**7, 64)])
def test_caps_recall_for_many_vectors(n, dim):
    rng = np.random.default_rng(n + dim)
    decoders = caps.Decoders(caps.Code.suited(n, 0.9, 128, 8.0, dim), dim)
    x, y = _unit(1500, dim, rng), rng.standard_normal((1500, dim))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    own = set(zip(*(a.tolist() for a in decoders.filters(x))))
    for t in (0.9, 0.96, 1.0):
        found = {k[0] for k in zip(*(a.tolist() for a in decoders.filters(t * x + math.sqrt(1 - t * t) * y))) if k in own}
        assert len(found) >= 0.98 * len(x)


@pytest.mark.parametrize("alpha,dim", [(0.3, 10), (0.1, 64), (0.5, 3)])
def test_shares_of_caps(alpha, dim):
    x = _unit(400_000, dim, np.random.default_rng(dim))
    t = 0.8
    other = t * x[:, 0] + math.sqrt(1 - t * t) * x[:, 1]
    assert abs((x[:, 0] >= alpha).mean() - caps.cap_share(alpha, 0.0, dim)) < 2e-3
    assert abs(((x[:, 0] >= alpha) & (other >= alpha)).mean() - caps.cap_share(alpha, math.acos(t), dim)) < 2e-3


def test_topk_is_exact(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((900, 40)) * np.linspace(2, 0.1, 40), np.repeat(rng.standard_normal((4, 40)), 15, axis=0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    found = defaultdict(list)
    for r in topk.neighbours(df, k=7).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.neighbour_id, r.distance))
    y = x.astype(np.float64)
    for q in range(len(x)):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort([np.arange(len(x)), d]) if i != q][:7]
        assert [i for i, _ in found[q]] == order and np.allclose([v for _, v in found[q]], d[order])


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1e300])
def test_topk_of_very_large_and_small_numbers(spark, scale):
    x = np.array([[0.0, 0.0], [0.0, 1.0], [3.0, 4.0], [0.0, 1.5], [0.0, 1.0]]) * scale
    out = defaultdict(list)
    for r in topk.neighbours(_vectors(spark, x), k=2).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.neighbour_id, r.distance / scale))
    assert [i for i, _ in out[0]] == [1, 4] and [i for i, _ in out[1]] == [4, 3] and [i for i, _ in out[3]] == [1, 4]
    assert np.allclose([d for _, d in out[2]], [math.hypot(3, 2.5), math.hypot(3, 3)]) and [i for i, _ in out[2]] == [3, 1]


def test_topk_of_numbers_far_apart(spark):
    x = np.array([[1e-200, 0.0], [2e-200, 0.0], [5e-200, 0.0], [1e200, 0.0]])
    out = {(r.query_id, r.rank): (r.neighbour_id, r.distance) for r in topk.neighbours(_vectors(spark, x), k=3).collect()}
    assert out[2, 1] == (1, pytest.approx(3e-200)) and out[2, 2] == (0, pytest.approx(4e-200)) and out[3, 1] == (0, 1e200)


def test_topk_of_stated_queries(spark):
    from pyspark.sql import functions as F

    df = _vectors(spark, np.random.default_rng(1).standard_normal((90, 5)))
    every = {(r.query_id, r.rank): r.neighbour_id for r in topk.neighbours(df, k=3).collect()}
    some = {(r.query_id, r.rank): r.neighbour_id for r in topk.neighbours(df, k=3, queries=F.col("vec_id") % 20 == 0).collect()}
    assert some == {k: v for k, v in every.items() if k[0] % 20 == 0} and len(some) == 15


def test_topk_prunes_and_merges_parts(spark, monkeypatch):
    for name, value in (("CHUNK_ROWS", 64), ("QUERY_ROWS", 32), ("PART_CHUNKS", 2)):
        monkeypatch.setattr(topk, name, value)
    test_topk_is_exact(spark)


def test_table_counts_follow_their_distribution():
    c, other, p, theta = 9, 4.0, 0.3, pitman_yor.THETA
    log_weight = [math.lgamma(2 * theta + other + t) + math.lgamma(2 * c - t) - math.lgamma(t) - math.lgamma(c - t + 1) + t * math.log(2 * p) for t in range(1, c + 1)]
    exact = np.exp(np.array(log_weight) - max(log_weight))
    exact /= exact.sum()
    rng = np.random.default_rng(0)
    t = np.ones(20_000)
    for _ in range(40):
        t = pitman_yor.tables(rng, np.full(len(t), float(c)), t, np.full(len(t), other), np.full(len(t), p))
    assert np.abs(np.bincount(t.astype(int), minlength=c + 1)[1:] / len(t) - exact).max() < 0.02


def test_seating_weights_are_those_of_the_process():
    """The closed form against a sum over all seatings of c customers at t tables with discount 1/2.  It grows by 4^t;
    the rising factorial of the tables' weights takes 2^t of that."""

    def seatings(c, t):
        # generalised Stirling numbers
        s = [[0.0] * (c + 2) for _ in range(c + 1)]
        s[0][0] = 1
        for n in range(c):
            for k in range(c + 1):
                s[n + 1][k] = (s[n][k - 1] if k else 0) + (n - k * 0.5) * s[n][k]
        return s[c][t]

    for c in (2, 5, 8):
        ratio = [seatings(c, t) / math.exp(math.lgamma(2 * c - t) - math.lgamma(t) - math.lgamma(c - t + 1) + t * math.log(4)) for t in range(1, c + 1)]
        assert max(ratio) / min(ratio) < 1 + 1e-9


def test_log_gamma():
    assert np.allclose(pitman_yor.log_gamma(np.array([0.5, 1, 3.3, 1e6])), [math.lgamma(v) for v in (0.5, 1, 3.3, 1e6)], atol=1e-6)


class PlainPitmanYor:
    """Customers at tables, seated one after the other; contexts of two words, of one, and a base distribution."""

    def __init__(self, tokens, base, rng):
        self.base, self.rng, self.theta = base, rng, [1.0, 1.0]
        self.tables = [defaultdict(lambda: defaultdict(list)) for _ in range(2)]  # context -> dish -> sizes
        self.tokens = tokens
        for g in tokens:
            self.add(0, g)

    def context(self, i, g):
        return g[:2] if i == 0 else g[1:2]

    def p(self, i, g):
        if i == 2:
            return self.base[g[2]]
        room = self.tables[i].get(self.context(i, g), {})
        c, t = sum(map(sum, room.values())), sum(map(len, room.values()))
        own = room.get(g[2], [])
        return (sum(own) - 0.5 * len(own) + (self.theta[i] + 0.5 * t) * self.p(i + 1, g)) / (self.theta[i] + c)

    def add(self, i, g):
        if i == 2:
            return
        room = self.tables[i][self.context(i, g)]
        t = sum(map(len, room.values()))
        own = room[g[2]]
        weights = [n - 0.5 for n in own] + [(self.theta[i] + 0.5 * t) * self.p(i + 1, g)]
        k = self.rng.choices(range(len(weights)), weights)[0]
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            self.add(i + 1, g)

    def remove(self, i, g):
        if i == 2:
            return
        own = self.tables[i][self.context(i, g)][g[2]]
        k = self.rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            del own[k]
            self.remove(i + 1, g)

    def sweep(self):
        for g in self.tokens:
            self.remove(0, g)
            self.add(0, g)
        for i in (0, 1):
            rooms = [(sum(map(sum, r.values())), sum(map(len, r.values()))) for r in self.tables[i].values()]

            def log_p(x):
                return sum(math.lgamma(2 * x + t) - math.lgamma(2 * x) - math.lgamma(x + c) + math.lgamma(x) for c, t in rooms if c > 1) - x

            new = self.theta[i] * math.exp(self.rng.gauss(0, 0.3))
            if math.log(1 - self.rng.random()) < log_p(new) - log_p(self.theta[i]) + math.log(new / self.theta[i]):
                self.theta[i] = new


def test_word_restaurants_against_a_plain_sampler():
    rng = random.Random(9)
    sentence = lambda: [rng.choice("abcdefgh") if rng.random() < 0.5 else "x" for _ in range(12)]
    docs = [sentence() for _ in range(25)]
    docs += docs[:3]  # texts that occur twice
    grams = [[tuple((["", ""] + d)[i : i + 3]) for i in range(len(d))] for d in docs]
    flat = [g for d in grams for g in d]
    base = {w: 1 / (20 + 5 * i) for i, w in enumerate("abcdefghx")}
    plain, total = PlainPitmanYor(flat, base, rng), np.zeros(len(flat))
    for k in range(300):
        plain.sweep()
        if k >= 60:
            total += [plain.p(0, g) for g in flat]
    names = {w: i for i, w in enumerate(["", *"abcdefghx"])}
    v, u, w = (np.array([names[g[i]] for g in flat]) for i in (1, 0, 2))
    p = np.array([-math.log(base[g[2]]) for g in flat])
    model, dish = pitman_yor.seated(v.astype(np.uint64), u.astype(np.uint16), w.astype(np.uint32), p, np.ones(len(flat), np.uint32))
    own, gen = np.zeros(len(model.c[0])), np.random.default_rng(4)
    for k in range(900):
        model.sweep(gen)
        if k >= 100:
            own += model.probability(0)
    got, expected = np.log(own / 800)[dish], np.log(total / 240)
    at = np.cumsum([0, *map(len, docs)])
    got, expected = (np.array([x[a:b].mean() for a, b in zip(at, at[1:])]) for x in (got, expected))
    assert np.abs(got - expected).max() < 0.04 and np.corrcoef(got, expected)[0, 1] > 0.99


def test_tables_are_drawn_from_their_distribution():
    rng = np.random.default_rng(2)
    for c, other, p, theta in ((5, 3.0, 0.2, 0.7), (16, 2.0, 0.6, 1.5), (19, 4.0, 0.3, 1.0)):
        log_weight = [math.lgamma(2 * theta + other + t) + math.lgamma(2 * c - t) - math.lgamma(t) - math.lgamma(c - t + 1) + t * math.log(2 * p) for t in range(1, c + 1)]
        exact = np.exp(np.array(log_weight) - max(log_weight))
        t = np.ones(20_000)
        for _ in range(1 if c <= pitman_yor.ENUMERATED else 40):
            t = pitman_yor.drawn(rng, np.full(len(t), float(c)), t, np.full(len(t), other), np.full(len(t), p), theta)
        assert np.abs(np.bincount(t.astype(int), minlength=c + 1)[1:] / len(t) - exact / exact.sum()).max() < 0.02


def test_spelling_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path, shards, root, often = pitman_yor.fit(docs, 8, burn_in=4, samples=4)
    model = pitman_yor.Model(path, shards, root)
    for context in (b"the", b"\0\0\0", b"\xff\xfe\xfd", "é ".encode()):
        number = int.from_bytes(context[-3:], "big") << 8
        assert abs(np.exp(model.log_probability(np.arange(number, number + 256, dtype=np.uint32))).sum() - 1) < 1e-3
    words = Counter(w.encode() for r in docs.select("text").collect() for w in r.text.lower().split())
    assert often == {int(Words([w]).hashes[0]): n for w, n in words.items() if int(Words([w]).hashes[0]) in often} and max(words.values()) in often.values()
    some = Words([b" ".join(words)])
    strings, first = pitman_yor.strings_of(some, np.arange(len(some.hashes)))
    log_p = np.add.reduceat(model.log_probability(strings), first)
    n = np.array(list(words.values()))
    # better than bytes by themselves
    single = Counter(b for w, k in words.items() for b in (w + b" ") * k)
    total = sum(single.values())
    plain = -sum(v / total * math.log(v / total) for v in single.values())
    assert -(log_p * n).sum() / total < 0.8 * plain


def test_frequent_words_are_dealt_out_evenly():
    rng = np.random.default_rng(3)
    share = 1 / np.arange(1, 20_001)
    share /= share.sum()
    for shards in (8, 128):
        v, u = mix(rng.choice(20_000, 400_000, p=share).astype(np.uint64)), rng.integers(0, 1 << 16, 400_000)
        distinct, n = np.unique(v, return_counts=True)
        often = {int(h): int(c) for h, c in zip(distinct, n) if c * 16 * shards > len(v)}
        shard = pitman_yor.shard_of(v, u, often, len(v), shards)
        assert np.bincount(shard, minlength=shards).max() < 1.4 * len(v) / shards
        for h in often:
            pieces = -(-2 * often[h] * shards // len(v))
            own = shard[v == np.uint64(h)]
            assert len(np.unique(own)) == min(pieces, shards) and all(len(np.unique(shard[(v == np.uint64(h)) & (u == x)])) == 1 for x in u[v == np.uint64(h)][:3])  # by u


def test_strings_of_words():
    words = Words([b"abcd", b"", b"xy \n z"])
    strings, first = pitman_yor.strings_of(words, np.array([0, 1, 2]))
    assert [int(s).to_bytes(4, "big") for s in strings] == [b"\0\0\0a", b"\0\0ab", b"\0abc", b"abcd", b"bcd ", b"\0\0\0x", b"\0\0xy", b"\0xy ", b"\0\0\0z", b"\0\0z "]
    assert first.tolist() == [0, 5, 8]


def test_scores_tell_repeated_texts_apart(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "and", *(f"w{rng.randrange(4000)}" for _ in range(3))])
    once = [" ".join(word() for _ in range(80)) for _ in range(150)]
    twice = [" ".join(word() for _ in range(80)) for _ in range(20)]
    docs = _docs(spark, [*once, *twice, *twice])
    scored = {r.doc_id: r for r in pitman_yor.score(docs).collect()}
    ppl = [scored[i].perplexity for i in range(len(scored))]
    assert np.quantile(ppl[150:], 0.9) < np.quantile(ppl[:150], 0.05) and all(scored[i].n_words == 80 for i in scored)
    assert np.allclose(ppl[150:170], ppl[170:], rtol=1e-4)
    # the same in several blocks and shards, up to sampling
    for name, value in (("SENT_WORDS", 500), ("SHARD_BYTES", 3000)):
        monkeypatch.setattr(pitman_yor, name, value)
    again = {r.doc_id: r.perplexity for r in pitman_yor.score(docs).collect()}
    assert np.corrcoef(np.log(ppl), np.log([again[i] for i in range(len(ppl))]))[0, 1] > 0.97


class PlainKneserNey:
    def __init__(self, texts, order):
        self.order = order
        sents = [["<s>"] * (order - 1) + t.split() for t in texts]
        grams = [Counter() for _ in range(order)]
        for s in sents:
            for i in range(order - 1, len(s)):
                for m in range(1, order + 1):
                    grams[m - 1][tuple(s[i - m + 1 : i + 1])] += 1
        self.counts = []
        for m in range(order):
            c = grams[m] if m == order - 1 else Counter(g[1:] for g in grams[m + 1])
            self.counts.append(c)
        self.d = [kneser_ney.discounts(np.array(list(c.values()))) for c in self.counts]
        self.total = [Counter() for _ in range(order)]
        self.left = [Counter() for _ in range(order)]
        for m, c in enumerate(self.counts):
            for g, n in c.items():
                self.total[m][g[:-1]] += n
                self.left[m][g[:-1]] += self.d[m][min(n, 3)]

    def p(self, gram):
        m = len(gram) - 1
        h = gram[:-1]
        lower = 1 / (len(self.counts[0]) + 1) if m == 0 else self.p(gram[1:])
        if not self.total[m][h]:
            return lower
        n = self.counts[m][gram]
        return (n - self.d[m][min(n, 3)]) / self.total[m][h] + self.left[m][h] / self.total[m][h] * lower


def test_kneser_ney_probabilities():
    texts = _texts(80, 1)
    words = Words([t.encode() for t in texts])
    model = kneser_ney.train(words.hashes, words.bounds, 3)
    tables, edges = kneser_ney.split(model, 5)
    shards = kneser_ney.Shards(None, tables, edges, float(model["unknown"][0]))
    plain = PlainKneserNey(texts, 3)
    fresh = [*_texts(20, 2), "w1 never seen w2 w3", "w5"]
    w = Words([t.encode() for t in fresh])
    got = shards.nll(w.hashes, w.bounds, 3)
    for t, nll in zip(fresh, got):
        s = ["<s>"] * 2 + t.split()
        assert abs(nll + sum(math.log(plain.p(tuple(s[i - 2 : i + 1]))) for i in range(2, len(s)))) < 1e-3 * max(1, nll)
    assert abs(sum(plain.p(("w1", "w2", v)) for v in {x for t in texts for x in t.split()} | {"unknown"}) - 1) < 1e-9


def test_quality_classifier_counts_all_trusted_text(spark, monkeypatch):
    for name, value in (("SHARD_BYTES", 9000), ("COUNTED_WORDS", 3000), ("SCORED_BYTES", 5000), ("CUT_BYTES", 2000)):
        monkeypatch.setattr(kneser_ney, name, value)
    rng = random.Random(7)
    text = lambda prefix: " ".join(f"{prefix}{int(rng.paretovariate(0.7)) % 900}" for _ in range(rng.randrange(1, 12)))
    rows = [(i, text("w"), "en") for i in range(4500)] + [(i, text("r"), "xx") for i in range(4500, 4530)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    trusted = {i for i, _, _ in rows if i < 4300 or 4500 <= i < 4506}
    labels = spark.createDataFrame([(i, int(i in trusted), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    texts = {i: t for i, t, _ in rows}
    in_turn = [sorted((i for i in trusted if (i < 4500) == en), key=lambda i: (hashes[i], i)) for en in (True, False)]
    en, both = (([x[::2] for x in langs], [x[1::2] for x in langs]) for langs in (in_turn[:1], in_turn))

    def model(parts):
        trains, calibrates = (sum(x, []) for x in parts)
        plain = PlainKneserNey([texts[i] for i in trains], 3)

        def nll(i):
            s = ["<s>"] * 2 + texts[i].split()
            return -sum(math.log(plain.p(tuple(s[j - 2 : j + 1]))) for j in range(2, len(s))), len(s) - 2

        own = [nll(i) for i in calibrates]
        mean = sum(x for x, _ in own) / sum(n for _, n in own)
        ppl = lambda x, n: math.exp((x + 20 * mean) / (n + 20))
        return lambda i: ppl(*nll(i)), np.quantile([ppl(*x) for x in own], 0.995, method="higher")

    (of_en, limit), (of_both, _) = model(en), model(both)
    for r in kneser_ney.score(docs, labels, shards=3).collect():
        assert r.perplexity == pytest.approx((of_en if r.doc_id < 4500 else of_both)(r.doc_id), rel=1e-5)
        assert r.threshold == (pytest.approx(limit, rel=1e-5) if r.doc_id < 4500 else None)
        assert r.keep == (r.threshold is None or r.perplexity <= r.threshold)


def most_shuffled(spark, run):
    """What run() returns, and the bytes that the stage with most of them wrote for others meanwhile."""
    context = spark.sparkContext._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    result = run()
    return result, max(n for i, n in stages().items() if i not in before)


def test_quality_classifier_sends_its_counts_in_rounds(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda prefix: " ".join(f"{prefix}{int(rng.paretovariate(0.5)) % 90_000}" for _ in range(100))
    rows = [(i, text("w"), "en") for i in range(1200)] + [(i, text("r"), "xx") for i in range(1200, 1230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1100 or i > 1220), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    folder = Path(_store.shared_dir(spark).removeprefix("file://"))
    stored = lambda: {x.name for x in folder.iterdir() if not x.name.startswith("kneser-ney")}
    there = stored()

    def scored():
        return sorted(tuple(r) for r in kneser_ney.score(docs, labels).collect())

    whole, sent_whole = most_shuffled(spark, scored)
    monkeypatch.setattr(kneser_ney, "ROUND_BYTES", 50_000, raising=False)
    in_rounds, sent = most_shuffled(spark, scored)
    assert in_rounds == whole and len(whole) == len(rows)
    assert sent < 0.4 * sent_whole
    # the same if trusted documents are too many for a broadcast
    monkeypatch.setattr(kneser_ney, "broadcast_if_small", lambda table: table)
    assert scored() == whole
    assert stored() == there


def test_quality_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op3_quality_classifier(spark, sf).select("doc_id", "keep")
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1 and not r.toxic]
    bad = [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < np.mean(good)


def test_quality_classifier_keeps_a_rare_language(spark):
    rng = random.Random(4)
    text = lambda prefix, words: " ".join(f"{prefix}{rng.randrange(words)}" for _ in range(60))
    rows = [(i, text("en", 40), "en") for i in range(100)] + [(i, text("rare", 5000), "xx") for i in range(100, 140)]
    rows += [(i, text("rare", 5000), None) for i in range(140, 160)] + [(i, text("odd", 5000), "en") for i in range(160, 170)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(80), *range(100, 106), *range(140, 143)]], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r for r in kneser_ney.score(docs, labels).collect()}
    for i in range(100, 160):  # clean, in a language with few trusted documents
        assert scored[i].keep and scored[i].threshold is None and scored[i].perplexity > 0
    assert not any(scored[i].keep for i in range(160, 170)) and np.mean([scored[i].keep for i in range(100)]) > 0.9


@given(st.lists(st.text(max_size=60), max_size=5))
@settings(max_examples=60, deadline=None)
def test_bpe_equals_tiktoken(texts):
    encoder, reference = _encoders()
    values, offsets = encoder.encode(texts)
    assert [values[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [reference.encode_ordinary(t) for t in texts]
    assert bpe.decode(tuple(bpe.read_vocabulary()), values, offsets) == [t.encode() for t in texts]


_made = []


def _encoders():
    if not _made:
        import tiktoken

        vocabulary = bpe.read_vocabulary()
        ranks = {v: i for i, v in enumerate(vocabulary)}
        _made.extend([bpe.Encoder(bpe.model_bytes(vocabulary)), tiktoken.Encoding("own", pat_str=bpe.PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})])
    return _made


def test_bpe_on_documents(spark, sf):
    rows = queries.op5_byte_bpe(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.round_trip and list(r.token_ids) == _encoders()[1].encode_ordinary(texts[r.doc_id]) for r in rows) and len(rows) == len(texts)
    back = bpe.decode_ids(bpe.encode(spark.read.parquet(f"{sf}/documents.parquet"))).collect()
    assert {r.doc_id: r.text for r in back} == texts


def _windows(text, window):
    words = text.lower().split()
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


def plain_repeats(texts, window):
    """For each document, words within windows that stood before, in the order of the documents."""
    seen, out = {}, {}
    for i, t in enumerate(texts):
        gone = set()
        for p, w in enumerate(_windows(t, window)):
            if w in seen:
                gone.update(range(p, p + window))
            else:
                seen[w] = (i, p)
        out[i] = gone
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    texts = [*_texts(150, seed), " ".join(["w1", "w2", "w3"] * 20)]
    docs = _docs(spark, texts)
    expected = plain_repeats(texts, 12)
    found = defaultdict(set)
    for r in repeats.occurrences(docs, 12).collect():
        found[r.doc_id].update(range(r.start_word, r.end_word))
        first = texts[r.first_doc_id].split()[r.first_start_word :][:12]
        assert texts[r.doc_id].split()[r.start_word :][:12] == first
    assert {i: g for i, g in expected.items() if g} == dict(found) and len(found) > 20
    left = {r.doc_id: r.text.split() for r in repeats.remove(docs, 12).collect()}
    for i, t in enumerate(texts):
        assert left.get(i, []) == [w for p, w in enumerate(t.split()) if p not in expected[i]]


def test_a_passage_in_every_document(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([rng.choice(WORDS) for _ in range(rng.randrange(20))] + passage + [rng.choice(WORDS) for _ in range(rng.randrange(20))]) for _ in range(120)]
    expected = plain_repeats(texts, 12)
    left = {r.doc_id: r.text.split() for r in repeats.remove(_docs(spark, texts), 12).collect()}
    for i, t in enumerate(texts):
        assert left.get(i, []) == [w for p, w in enumerate(t.split()) if p not in expected[i]]


def test_window_hashes_agree():
    words = Words([b"a b c d a b c d"])
    h = window_hashes(words.hashes, 4)
    assert h[0] == h[4] and len(set(h.tolist())) == 4


def test_chat_tokens(spark):
    import tiktoken

    vocabulary = bpe.read_vocabulary()
    stop, start, end = chat.reserved_ids(len(vocabulary))
    plain = tiktoken.Encoding("own", pat_str=bpe.PRE_TOKENS, mergeable_ranks={v: i for i, v in enumerate(vocabulary)}, special_tokens={}).encode_ordinary
    rows = [(1, 1, "assistant", "yes <|im_end|> no"), (1, 0, "user", "Is it?\n"), (2, 0, "system", "<|endoftext|>"), (2, 1, "assistant", "ok")]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in (1, 2):
        ids, mask = [], []
        for _, _, role, text in sorted(r for r in rows if r[0] == conv):
            head, body = [start, *plain(role + "\n")], [*plain(chat.escape(text)), end]
            ids += head + body + plain("\n")
            mask += [0] * len(head) + [int(role == "assistant")] * len(body) + [0] * len(plain("\n"))
        assert list(out[conv].token_ids) == [*ids, stop] and list(out[conv].loss_mask) == [*mask, 0]
        assert Counter(i for i in out[conv].token_ids if i >= stop) == {start: 2, end: 2, stop: 1}


@given(st.text(alphabet="<|\\>imend_startoftx", max_size=60))
def test_escape_is_undone(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def plain_pairs(texts, t, n):
    sets = []
    for text in texts:
        w = text.lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    out = {}
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both / len(sets[i] | sets[j]) >= t:
                out[i, j] = (both, both / len(sets[i] | sets[j]))
    return out


def plain_classes(texts, t, n):
    """(class, number of links) of each text."""
    pairs = plain_pairs(texts, t, n)
    links = Counter(i for p in pairs for i in p)
    return {i: (g, links[i]) for i, g in enumerate(plain_groups(pairs, len(texts)))}


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_classes(spark, seed):
    texts = _texts(220, seed)
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard.classes(_docs(spark, texts)).collect()}
    assert got == plain_classes(texts, 0.4, 4) and sum(n for _, n in got.values()) > 100


def test_jaccard_classes_are_the_same_in_pieces(spark, monkeypatch):
    for name, value in (("COUNTED", 50), ("MEMBERS", 3), ("QUERIES", 5)):
        monkeypatch.setattr(jaccard, name, value)
    # a group of near copies beyond one cell
    base = [f"v{i}" for i in range(40)]
    near = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(12, 36)]
    texts = [*_texts(100, 5), *near, *near[:5]]
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard.classes(_docs(spark, texts)).collect()}
    assert got == plain_classes(texts, 0.4, 4)


@given(st.lists(st.tuples(st.sets(st.integers(0, 12), min_size=1), st.sampled_from([1, 4, 6]), st.integers(1, 3)), min_size=1, max_size=9), st.sampled_from([0.3, 0.5, 0.9]))
@settings(max_examples=80, deadline=None)
def test_links_of_a_cell(rows, t):
    cell = jaccard.Cell()
    for name, (s, role, copies) in enumerate(rows):
        cell.add(name, np.array(sorted(s), np.uint64), role, copies)
    expected = Counter()
    for i, (a, role_a, copies_a) in enumerate(rows):
        for j, (b, role_b, copies_b) in enumerate(rows):
            meets = role_b & 4 and (role_a & 1 or (role_a & 2 and i > j)) and i != j
            if meets and len(a & b) / len(a | b) >= t:
                expected[i] += copies_b
                expected[j] += copies_a
    assert {name: n for name, _, n in cell.summary(t)} == dict(expected)


def plain_groups(pairs, n):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, 300)]
    got = {r.node: r.component for r in _components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    expected = plain_groups(pairs, 301)
    assert got == {i: expected[i] for a, b in pairs if a != b for i in (a, b)}


def test_jaccard_keeps_one_of_each_group(spark):
    texts = _texts(200, 6)
    kept = {r.doc_id for r in jaccard.deduplicate(_docs(spark, texts)).collect()}
    assert kept == set(plain_groups(plain_pairs(texts, 0.4, 4), len(texts)))


@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=20))
@settings(max_examples=150, deadline=None)
def test_matching_statistics(templates, tokens):
    automaton = licences.SuffixAutomaton(templates)
    runs = automaton.longest_runs(tokens)
    subs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    spans = [(i, j) for i in range(len(tokens)) for j in range(i + 1, len(tokens) + 1) if tuple(tokens[i:j]) in subs]
    longest = sorted(s for s in spans if not any(o != s and o[0] <= s[0] and o[1] >= s[1] for o in spans))
    assert sorted((s, s + n) for s, n, _ in runs) == longest
    for s, n, state in runs:
        run = tokens[s : s + n]
        assert automaton.ends[state] == {(t, e) for t, x in enumerate(templates) for e in range(n, len(x) + 1) if x[e - n : e] == run}


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 20), st.integers(1, 6)), max_size=8), st.integers(0, 6))
@settings(max_examples=200, deadline=None)
def test_chains(fragments, max_gap):
    def follows(a, b):
        return a[0] + a[2] <= b[0] <= a[0] + a[2] + max_gap and a[1] + a[2] <= b[1] <= a[1] + a[2] + max_gap

    def chains_from(path):
        yield path
        for f in set(fragments):
            if follows(path[-1], f):
                yield from chains_from([*path, f])

    every = [c for f in set(fragments) for c in chains_from([f])]
    found = licences.chains(fragments, max_gap)
    assert max((c for _, _, c, _ in found), default=0) == max((sum(f[2] for f in c) for c in every), default=0)
    possible = {(c[0][0], c[-1][0] + c[-1][2], sum(f[2] for f in c), len(c)) for c in every}
    assert set(found) <= possible and sum(n for *_, n in found) == len(set(fragments))


def test_licence_spans(spark):
    header = licences.TEMPLATES["gpl-header"]
    words = header.split()
    changed = " ".join(words[:15] + ["really", "truly"] + words[15:])
    rows = [(1, f"code here {header} and more"), (2, changed), (3, "nothing"), (4, " ".join(words[:8])), (5, "All rights reserved. All rights reserved.")]
    out = defaultdict(list)
    for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "start_token").collect():
        out[r.doc_id].append(r)
    assert [(r.licence, r.start_token, r.coverage, r.n_fragments) for r in out[1]] == [("gpl-header", 2, 1.0, 1)]
    assert rows[0][1].lower().encode()[out[1][0].start_byte : out[1][0].end_byte].decode() == header.lower().rstrip(".")
    assert [(r.licence, r.coverage, r.n_fragments) for r in out[2]] == [("gpl-header", 1.0, 2)]
    assert not out[3] and not out[4] and [(r.start_token, r.end_token) for r in out[5]] == [(0, 3), (3, 6)]


def test_licence_notice_that_another_template_continues(spark):
    notice = "Licensed under the Apache License, Version 2.0"
    rows = [(1, f"{notice}. The rest is code"), (2, f'{notice} (the "License"); you may not use it'), (3, f"see: {notice}"), (4, licences.TEMPLATES["apache-2.0-header"])]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.licence, r.start_token, r.coverage) for r in found] == [
        (1, "apache-2.0-notice", 0, 1.0), (2, "apache-2.0-notice", 0, 1.0), (3, "apache-2.0-notice", 1, 1.0), (4, "apache-2.0-header", 0, 1.0),
    ]


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = packing.hilbert_key(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def plain_packs(texts, capacity):
    line = []
    for i, t in enumerate(texts):
        key, n = packing.keys_of([t.lower().encode()], 4, 12)
        line.append((int(key[0]), i, int(n[0])))
    words = [(i, p) for _, i, n in sorted(line) for p in range(n)]
    return [words[a : a + capacity] for a in range(0, len(words), capacity)]


def test_packing(spark):
    texts = _texts(200, 7)
    got = packing.pack(_docs(spark, texts), capacity=64).orderBy("pack_id").collect()
    spread = [[(d, p) for d, s, n in zip(r.doc_ids, r.starts, r.lengths) for p in range(s, s + n)] for r in got]
    assert spread == plain_packs(texts, 64) and [r.pack_id for r in got] == list(range(len(got)))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = sorted((r.doc_id, r.text) for r in kneser_ney.score(docs, labels).where("keep").collect())
    ids, texts = [i for i, _ in kept], [t for _, t in kept]
    group = plain_groups(plain_pairs(texts, 0.4, 4), len(texts))
    single = [(ids[i], texts[i]) for i in range(len(ids)) if group[i] == i]
    gone = plain_repeats([t for _, t in single], 50)
    left = {d: [w for p, w in enumerate(t.split()) if p not in gone[i]] for i, (d, t) in enumerate(single)}
    packs = corpus_pipeline.run(spark, sf).collect()
    packed = Counter()
    for p in packs:
        for d, n in zip(p.doc_ids, p.lengths):
            packed[d] += n
    assert packed == Counter({d: len(w) for d, w in left.items() if w})
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram jaccard join", "substring dedup", "packing"]
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, sf)
        assert stage.columns == docs.columns
