"""Search: trigram conditions, scores, filters, order.

All searches return (path, location, score, file_id, chunk_id): one row for each chunk and file, with the first
place of the chunk in it, best first, then by path and location as strings.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawl.functions.patterns import Need, needed_trigrams, to_java
from trawl.functions.text import lowered, pair_get, parse_terms, simple_lower, tokens
from trawl.operators.corpus import Corpus, any_of, count_trigrams, has_trigrams, let
from trawl.plans.options import Options

RESULT = ["path", "location", "score", "file_id", "chunk_id"]
K1, B = 1.2, 0.75
#: Candidates that are broadcast at most, about 100 bytes each.
FEW_CANDIDATES = 50_000


@dataclass(frozen=True)
class Query:
    """A query after parsing and choice of trigrams."""

    terms: list[str]
    #: distinct trigrams of each term, before any choice
    by_term: list[list[int]]
    active: list[int]

    @staticmethod
    def plan(corpus: Corpus, text: str, options: Options) -> Query:
        terms = parse_terms(text)
        by_term = [list(dict.fromkeys(corpus.encoding.trigrams(t))) for t in terms]
        active = list(dict.fromkeys(t for ts in by_term for t in ts))
        if options.trigram_filter and active:
            found, total, _ = corpus.counts(active)
            active = [t for t, _ in options.trigram_filter(found, total)]
        return Query(terms, by_term, active)

    def condition(self, loose: bool, has: Callable[[int], Column]) -> Column:
        """Of the trigrams that are active: a term is met by having all of its own."""
        on = set(self.active)
        met = [[t for t in ts if t in on] for ts in self.by_term]
        parts = [_all([has(t) for t in ts]) for ts in met if ts]
        return any_of(parts) if loose else _all(parts)


def _all(parts: list[Column]) -> Column:
    out = parts[0] if parts else F.lit(True)
    for p in parts[1:]:
        out = out & p
    return out


def _matching(corpus: Corpus, trigrams: list[int], condition: Callable[[Callable[[int], Column]], Column], counts: bool) -> tuple[DataFrame, Callable[[int], Column]]:
    """Occurrences that meet a condition on trigrams, and a function from a trigram to its count in the chunk
    (without ``counts``: 1 or 0)."""
    place = {t: i for i, t in enumerate(trigrams)}
    if corpus.postings is not None:
        found = corpus.postings_of(trigrams, condition).groupBy(corpus.key)
        per_chunk = found.agg(*[F.max(F.when(F.col("trigram") == t, F.col("tf"))).alias(f"_t{i}") for i, t in enumerate(trigrams)])
        per_chunk = per_chunk.where(condition(lambda t: F.col(f"_t{place[t]}").isNotNull()))
        per_chunk = per_chunk.select(corpus.key, F.array(*[F.coalesce(f"_t{i}", F.lit(0)) for i in range(len(trigrams))]).alias("_tf"))
        # candidates first: what is stored of other chunks is not shuffled
        if corpus.fetch and per_chunk.limit(FEW_CANDIDATES + 1).count() <= FEW_CANDIDATES:
            return corpus.occurrences_of(F.broadcast(corpus.named(F.broadcast(per_chunk)))), lambda t: F.col("_tf")[place[t]]
        return corpus.occurrences_of(corpus.named(per_chunk)), lambda t: F.col("_tf")[place[t]]
    has = has_trigrams(corpus.encoding, F.col("content"), trigrams)
    rows = corpus.occurrences.where(condition(lambda t: has[place[t]]))
    each = count_trigrams(corpus.encoding, F.col("content"), trigrams) if counts else F.array(*[h.cast("int") for h in has])
    return rows.withColumn("_tf", each), lambda t: F.col("_tf")[place[t]]


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def distinct_tokens() -> Column:
    return F.size(F.array_distinct(tokens(F.col("content"))))


def bm25(frequencies: list[tuple[int, int]], total_chunks: int, total_tokens: int, k1: float = K1, b: float = B) -> Callable[..., Column]:
    """A scorer; frequencies are (trigram, df) in the order of the tf columns."""
    mean = total_tokens / total_chunks if total_chunks else 0.0

    def score(tf: list[Column], n_tokens: Column) -> Column:
        norm = k1 * (1 - b + b * n_tokens / mean) if mean else F.lit(k1)
        parts = []
        for f, (_, df) in zip(tf, frequencies):
            idf = math.log((total_chunks - df + 0.5) / (df + 0.5) + 1)
            parts.append(F.lit(idf) * (f * (k1 + 1)) / (f + norm))
        return _sum(parts)

    return score


def _score(corpus: Corpus, query: Query, scoring: str | Callable[..., Column], tf: Callable[[int], Column]) -> Column:
    active = [tf(t) for t in query.active]
    n = distinct_tokens()
    if callable(scoring):
        return scoring(active, n)
    if scoring == "coverage":
        return _sum([F.when(f > 0, 1.0).otherwise(0.0) for f in active]) / max(len(active), 1)
    if scoring == "overlap":
        return _sum([F.when(f > 0, 1.0).otherwise(0.0) for f in active])
    if scoring == "density":
        return F.when(n > 0, _sum(active) / n).otherwise(0.0)
    if scoring == "terms":
        met = [_all([tf(t) > 0 for t in ts]) for ts in query.by_term if ts]
        return _sum([F.when(m, 1.0).otherwise(0.0) for m in met]) / max(len(query.terms), 1)
    if scoring == "bm25":
        return bm25(*corpus.counts(query.active))(active, n)
    raise ValueError(f"no scoring {scoring!r}")


def _all_trigrams(query: Query) -> list[int]:
    return list(dict.fromkeys([*query.active, *(t for ts in query.by_term for t in ts)]))


def _chunk_filters(rows: DataFrame, options: Options) -> DataFrame:
    """Filters of chunks by time and by own conditions.  A chunk's attributes and time are those of the first file
    that has it."""
    if options.after is None and options.before is None and not options.chunk_filters:
        return rows
    # aggregated before it is shuffled: a chunk may be in very many files
    first = rows.groupBy("chunk_id").agg(F.min_by(F.struct("attrs", "mod_time_ns"), F.struct("file_id", "pos")).alias("_first"))
    rows = rows.join(first, "chunk_id").withColumn("attrs", F.col("_first.attrs"))
    time = F.coalesce(F.try_to_number(pair_get(F.col("attrs"), "timestamp"), F.lit("S9999999999999999999")).cast("long"), F.col("_first.mod_time_ns"), F.lit(0))
    if options.after is not None:
        rows = rows.where(time >= options.after)
    if options.before is not None:
        rows = rows.where(time < options.before)
    for f in options.chunk_filters:
        rows = rows.where(f(F.col("content"), F.col("attrs"), distinct_tokens()))
    return rows.drop("_first")


def _file_filters(rows: DataFrame, options: Options) -> DataFrame:
    if options.wanted_files is not None:
        rows = rows.where(F.col("file_id").isin(sorted(options.wanted_files)) if options.wanted_files else F.lit(False))
    if options.except_files:
        rows = rows.where(~F.col("file_id").isin(sorted(options.except_files)))
    return rows.where("not is_tmp") if options.no_tmp else rows


def _text_filters(rows: DataFrame, options: Options, terms: list[str]) -> DataFrame:
    if options.verify and terms:
        rows = rows.where(let(lowered(F.col("content")), lambda c: _all([F.contains(c, F.lit(simple_lower(t))) for t in terms])))
    for p in options.regex:
        rows = rows.where(F.col("content").rlike(to_java(p)))
    for p in options.except_regex:
        rows = rows.where(~F.col("content").rlike(to_java(p)))
    return rows


def _resolved(rows: DataFrame, scores: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row for each chunk and file, at the chunk's first place."""
    values = F.struct("path", "location", *scores, *(keep or []))
    return rows.groupBy("chunk_id", "file_id").agg(F.min_by(values, "pos").alias("r")).select("chunk_id", "file_id", "r.*")


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("score"), "path", "location").select(*RESULT)


def _nothing(corpus: Corpus) -> DataFrame:
    return corpus.occurrences.sparkSession.createDataFrame([], "path string, location string, score double, file_id long, chunk_id string")


def min_span(content: Column, terms: list[str]) -> Column:
    """Least distance, in words, of places that together have all terms, each place the nearest to one of the first
    term; 0 if a term is missing."""
    words = F.regexp_extract_all(lowered(content), F.lit(r"[^\s\x0B\x85\p{Z}]+"), F.lit(0))

    def places(w: Column, term: str) -> Column:
        return F.array_compact(F.transform(w, lambda x, i: F.when(F.contains(x, F.lit(term)), i)))

    def spans(w: Column) -> Column:
        others = [places(w, simple_lower(t)) for t in terms[1:]]

        def span(a: Column) -> Column:
            nearest = [F.array_min(F.transform(o, lambda p: F.struct(F.abs(p - a).alias("d"), p.alias("p"))))["p"] for o in others]
            return F.greatest(a, *nearest) - F.least(a, *nearest) if nearest else F.lit(0)

        first = places(w, simple_lower(terms[0]))
        found = _all([F.size(p) > 0 for p in [first, *others]])
        return F.when(found, F.least(F.size(w), F.array_min(F.transform(first, span)))).otherwise(0)

    return let(words, spans)


def _reranked(rows: DataFrame, terms: list[str], n: int) -> DataFrame:
    """Adds 1 / (1 + span) to the scores of the first n; rows have content."""
    if len(terms) < 2 or n <= 0:
        return rows
    top = rows.orderBy(F.desc("score"), "path", "location").limit(n)
    span = min_span(F.col("content"), terms)
    better = top.withColumn("score", F.col("score") + F.when(span > 0, 1 / (1 + span)).otherwise(0.0))
    return rows.join(top.select("chunk_id", "file_id"), ["chunk_id", "file_id"], "left_anti").unionByName(better)


def search(corpus: Corpus, text: str, options: Options | None = None) -> DataFrame:
    """Chunks with all terms of a query, or any with ``loose``."""
    options = options or Options()
    query = Query.plan(corpus, text, options)
    if not query.active:
        return _nothing(corpus)
    scoring = options.scoring or ("terms" if options.loose else "coverage")
    rows, tf = _matching(corpus, _all_trigrams(query), lambda has: query.condition(options.loose, has), scoring not in ("coverage", "overlap", "terms"))
    rows = _text_filters(_chunk_filters(rows, options), options, query.terms)
    rows = rows.withColumn("score", _score(corpus, query, scoring, tf).cast("double")).where("score > 0")
    rows = _resolved(_file_filters(rows, options), ["score"], ["content"] if options.proximity else None)
    return _ordered(_reranked(rows, query.terms, options.proximity))


def _meets(need: Need, has: Callable[[int], Column]) -> Column:
    parts = [has(t) for t in sorted(need.trigrams)] + [_meets(p, has) for p in need.parts]
    return _all(parts) if need.all else any_of(parts)


def _trigrams_in(need: Need) -> list[int]:
    return sorted(need.trigrams.union(*(_trigrams_in(p) for p in need.parts)))


def search_regex(corpus: Corpus, pattern: str, options: Options | None = None) -> DataFrame:
    """Chunks in which a pattern (RE2's dialect) matches, all with score 1."""
    options = options or Options()
    java = to_java(pattern)
    rows = corpus.occurrences
    need = needed_trigrams(pattern, corpus.encoding)
    if corpus.postings is not None and not need.nothing:
        rows, _ = _matching(corpus, _trigrams_in(need), lambda has: _meets(need, has), False)
    rows = rows.where(F.col("content").rlike(java))
    rows = _text_filters(_chunk_filters(rows, options), options, []).withColumn("score", F.lit(1.0))
    return _ordered(_resolved(_file_filters(rows, options), ["score"]))


def search_fuzzy(corpus: Corpus, text: str, k: int = 20, options: Options | None = None) -> DataFrame:
    """The k chunks with most of the query's trigrams (ties by chunk_id), scored by the share they have; at most k
    results."""
    options = options or Options()
    k = k if k > 0 else 20
    plain = Options()
    query = Query.plan(corpus, text, plain)
    if not query.active:
        return _nothing(corpus)
    base = corpus
    if options.no_tmp:
        fetch = (lambda c: corpus.occurrences_of(c).where("not is_tmp")) if corpus.fetch else None
        base = replace(corpus, occurrences=corpus.occurrences.where("not is_tmp"), fetch=fetch)
    if base.postings is not None:
        # the best are found in the postings alone
        per_chunk = base.still_live(base.postings_of(query.active)).groupBy(base.key).agg(F.count("*").alias("n"))
        per_chunk = base.named(per_chunk)
        if options.no_tmp:
            per_chunk = per_chunk.join(base.occurrences.select("chunk_id"), "chunk_id", "left_semi")
        best = per_chunk.orderBy(F.desc("n"), "chunk_id").limit(k)
        rows = base.occurrences_of(F.broadcast(best)).withColumn("score", F.col("n") / len(query.active))
        rows = _text_filters(_chunk_filters(rows, options), options, query.terms)
        rows = _resolved(_file_filters(rows, options), ["score"], ["content"] if options.proximity else None)
        return _ordered(_reranked(rows, query.terms, options.proximity)).limit(k)
    rows, tf = _matching(base, query.active, lambda has: any_of([has(t) for t in query.active]), False)
    rows = rows.withColumn("score", _score(base, query, "coverage", tf))
    # k rows; the least score spares hashing the chunks below it
    best = rows.groupBy("chunk_id").agg(F.max("score").alias("s")).orderBy(F.desc("s"), "chunk_id").limit(k).collect()
    least = min((r.s for r in best), default=0.0)
    rows = rows.where((F.col("score") >= least) & F.col("chunk_id").isin([r.chunk_id for r in best]))
    rows = _text_filters(_chunk_filters(rows, options), options, query.terms)
    rows = _resolved(_file_filters(rows, options), ["score"], ["content"] if options.proximity else None)
    return _ordered(_reranked(rows, query.terms, options.proximity)).limit(k)


def search_multi(corpus: Corpus, text: str, scorers: dict[str, str | Callable[..., Column]], k: int = 0, options: Options | None = None) -> DataFrame:
    """(strategy, path, location, score, file_id, chunk_id): the k best (0: all) of each scorer, from one set of
    candidates.  Filters of text apply to these k."""
    options = options or Options()
    query = Query.plan(corpus, text, options)
    if not query.active or not scorers:
        return _nothing(corpus).select(F.lit("").alias("strategy"), *RESULT)
    names = sorted(scorers)
    rows, tf = _matching(corpus, _all_trigrams(query), lambda has: query.condition(options.loose, has), True)
    rows = _file_filters(_chunk_filters(rows, options), options)
    rows = rows.withColumns({f"_s{i}": _score(corpus, query, scorers[n], tf).cast("double") for i, n in enumerate(names)})
    needs_text = options.verify or options.regex or options.except_regex or options.proximity
    rows = _resolved(rows, [f"_s{i}" for i in range(len(names))], ["content"] if needs_text else None)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"_s{i}").alias("score")) for i, n in enumerate(names)])).alias("e")
    rows = rows.select("chunk_id", "file_id", "path", "location", *(["content"] if needs_text else []), each).select("*", "e.*").drop("e").where("score > 0")
    order = Window.partitionBy("strategy").orderBy(F.desc("score"), "path", "location", "file_id")
    if k > 0:
        rows = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")
    if needs_text:
        rows = _text_filters(rows, options, query.terms)
        if options.proximity and len(query.terms) > 1:
            rank = F.row_number().over(order)
            span = min_span(F.col("content"), query.terms)
            rows = rows.withColumn("_rank", rank)
            rows = rows.withColumn("score", F.col("score") + F.when((F.col("_rank") <= options.proximity) & (span > 0), 1 / (1 + span)).otherwise(0.0))
    return rows.orderBy("strategy", F.desc("score"), "path", "location").select("strategy", *RESULT)


def score_file(corpus: Corpus, text: str, path: str, options: Options | None = None) -> DataFrame:
    """(pos, location, score) of every chunk of a file, in order, those without a match included."""
    options = options or Options()
    rows = corpus.occurrences.where(F.col("path") == path)
    if rows.isEmpty():
        raise KeyError(f"no file {path!r}")
    query = Query.plan(corpus, text, options)
    if not query.active:
        return rows.where("false").select("pos", "location", F.lit(0.0).alias("score"))
    scanned = Corpus(rows, corpus.encoding)
    every, tf = _matching(scanned, _all_trigrams(query), lambda has: F.lit(True), True)
    return every.withColumn("score", _score(corpus, query, options.scoring or "coverage", tf).cast("double")).orderBy("pos").select("pos", "location", "score")


def get_chunks(corpus: Corpus, path: str, location: str, before: int = 0, after: int = 0) -> DataFrame:
    """(path, location, content, index, attrs) of a chunk and its neighbours; the first chunk of that label is meant."""
    rows = corpus.occurrences.where(F.col("path") == path)
    target = rows.where(F.col("location") == location).agg(F.min("pos")).first()[0]
    if target is None:
        raise KeyError(f"no file {path!r}" if rows.isEmpty() else f"no chunk {location!r} in {path!r}")
    return chunks_between(corpus, path, target - max(before, 0), target + max(after, 0))


def chunks_between(corpus: Corpus, path: str, first: int, last: int) -> DataFrame:
    """As get_chunks, of those of the positions ``first`` to ``last`` that the file has; none of a file that is not there."""
    near = corpus.occurrences.where((F.col("path") == path) & F.col("pos").between(first, last))
    return near.orderBy("pos").select("path", "location", "content", F.col("pos").alias("index"), "attrs")


def neighbours(corpus: Corpus, targets: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """As get_chunks for many targets (path, location) at once: target_location is added."""
    found = targets.select("path", F.col("location").alias("target_location")).distinct()
    o = corpus.occurrences
    at = o.join(found, (o["path"] == found["path"]) & (o["location"] == found["target_location"])).groupBy("file_id", "target_location").agg(F.min("pos").alias("at"))
    # every target asks for so many positions: an equi-join, not a range join
    wanted = at.withColumn("pos", F.explode(F.sequence(F.col("at") - max(before, 0), F.col("at") + max(after, 0)))).drop("at")
    return o.join(wanted, ["file_id", "pos"]).select("path", "target_location", "location", "content", F.col("pos").alias("index"), "attrs")


def query_frequencies(corpus: Corpus, text: str) -> DataFrame:
    """(trigram, df) of the query taken as one text."""
    return corpus.frequencies(corpus.encoding.trigrams(text))
