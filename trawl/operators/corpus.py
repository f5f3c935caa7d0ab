"""Chunks of many files as DataFrames, and what can be counted over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import Encoding, chunk_hash, fnv1a_column, token_counts, tokens, trigram_bag

ATTRS = "array<struct<key:string,value:string>>"
COLUMNS = {"file_id": "long", "path": "string", "pos": "int", "location": "string", "content": "string", "attrs": ATTRS, "mod_time_ns": "long", "is_tmp": "boolean"}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


@dataclass(frozen=True)
class Corpus:
    """``occurrences``: one row for each chunk of each file, in the columns COLUMNS and chunk_id, the hash of the
    content.  ``postings`` (trigram, chunk_id, tf), where there are any, answer trigram conditions; without them the
    text is scanned, which is as fast for one query.  Stored postings go by a number of the chunk instead of its id."""

    occurrences: DataFrame
    encoding: Encoding = field(default_factory=Encoding)
    postings: DataFrame | None = None
    #: occurrences of candidates (chunk_id, ...), where there is a better way than joining them with ``occurrences``
    fetch: Callable[[DataFrame], DataFrame] | None = None
    #: column of ``postings`` that tells chunks apart, and if that is not chunk_id, (key, chunk_id)
    key: str = "chunk_id"
    names: DataFrame | None = None
    #: postings are not stored: those of a query are made for its trigrams only
    made: bool = False
    #: key of the chunks that postings still count for, if not all
    live: DataFrame | None = None
    #: (total_chunks, total_tokens), if stored
    stored_stats: DataFrame | None = None

    @staticmethod
    def of(occurrences: DataFrame, encoding: Encoding | None = None) -> Corpus:
        """Columns of COLUMNS that are missing are filled in: no attributes, time 0, not temporary, path by file_id."""
        missing = {
            "path": F.col("file_id").cast("string"), "attrs": F.array().cast(ATTRS), "mod_time_ns": F.lit(0).cast("long"), "is_tmp": F.lit(False),
        }
        chosen = [(F.col(c) if c in occurrences.columns else missing[c]).cast(kind).alias(c) for c, kind in COLUMNS.items()]
        ids = F.col("chunk_id") if "chunk_id" in occurrences.columns else chunk_hash(F.col("content"))
        return Corpus(occurrences.where("content is not null").select(*chosen, ids.alias("chunk_id")), encoding or Encoding())

    def union(self, other: Corpus) -> Corpus:
        if self.postings is None:
            return replace(self, occurrences=self.occurrences.unionByName(other.occurrences))
        columns = ["trigram", "chunk_id", "tf"]
        both = self.named(self.postings).select(columns).unionByName(other.with_postings().postings.select(columns))
        # a chunk of both has postings of both
        one = both.groupBy("trigram", "chunk_id").agg(F.max("tf").alias("tf"))
        live = None if self.live is None else self.named(self.live).unionByName(other.occurrences.select("chunk_id"))
        fetch = lambda candidates: self.occurrences_of(candidates).unionByName(other.occurrences_of(candidates))
        return replace(self, occurrences=self.occurrences.unionByName(other.occurrences), postings=one, key="chunk_id", names=None, made=False, live=live, fetch=fetch, stored_stats=None)

    def occurrences_of(self, candidates: DataFrame) -> DataFrame:
        return self.fetch(candidates) if self.fetch else self.occurrences.join(candidates, "chunk_id")

    @property
    def chunks(self) -> DataFrame:
        """(chunk_id, content, attrs, content_len, n_tokens_distinct, n_tokens_total) of distinct contents; attributes are
        those of the first file's."""
        first = F.min_by(F.struct("content", "attrs"), F.struct("file_id", "pos")).alias("c")
        one = self.occurrences.groupBy("chunk_id").agg(first).select("chunk_id", "c.*")
        words = tokens(F.col("content"))
        return one.withColumns(
            {
                "content_len": F.octet_length("content"),
                "n_tokens_distinct": F.size(F.array_distinct(words)),
                "n_tokens_total": F.size(words).cast("long"),
            }
        )

    def make_postings(self, asked: list[int] | None = None, condition: Callable[[Callable[[int], Column]], Column] | None = None) -> DataFrame:
        """(trigram, chunk_id, tf) of all trigrams, or of those asked for, then only of chunks that meet the condition
        on them.  Contents are made distinct first; for few trigrams only their counts are shuffled."""
        if asked is not None:
            has = dict(zip(asked, has_trigrams(self.encoding, F.col("content"), asked)))
            rows = self.occurrences.where(condition(has.__getitem__) if condition else any_of(list(has.values())))
            rows = rows.select("chunk_id", count_trigrams(self.encoding, F.col("content"), asked).alias("n"))
            one = rows.groupBy("chunk_id").agg(F.first("n").alias("n"))
            pairs = F.arrays_zip(F.array(*map(F.lit, asked)).alias("trigram"), F.col("n").alias("tf"))
            return one.select("chunk_id", F.inline(pairs)).where("tf > 0").select("trigram", "chunk_id", "tf")
        one = self.occurrences.groupBy("chunk_id").agg(F.first("content").alias("content"))
        bag = trigram_bag(self.encoding.column(F.col("content")))
        return one.select("chunk_id", F.inline(bag)).select("trigram", "chunk_id", "tf")

    def with_postings(self) -> Corpus:
        return self if self.postings is not None else replace(self, postings=self.make_postings(), made=True)

    def postings_of(self, trigrams: list[int], condition: Callable[[Callable[[int], Column]], Column] | None = None) -> DataFrame:
        """Postings of some trigrams; those of chunks that don't meet the condition may be left out."""
        asked = list(dict.fromkeys(trigrams))
        return self.make_postings(asked, condition) if self.made and asked else self.postings.where(F.col("trigram").isin(asked))

    def named(self, rows: DataFrame) -> DataFrame:
        """Rows with the key of postings, with chunk_id instead."""
        return rows if self.names is None else rows.join(self.names, self.key).drop(self.key)

    def token_postings(self) -> DataFrame:
        """(token, token_hash, chunk_id, cnt)."""
        one = self.occurrences.groupBy("chunk_id").agg(F.first("content").alias("content"))
        counted = one.select("chunk_id", F.inline(token_counts(F.col("content"))))
        return counted.select("token", fnv1a_column(F.col("token")).alias("token_hash"), "chunk_id", "cnt")

    def file_tokens(self) -> DataFrame:
        """(file_id, token, cnt): tokens of each file, a chunk counting as often as it occurs."""
        return self.occurrences.select("file_id", F.explode(tokens(F.col("content"))).alias("token")).groupBy("file_id", "token").agg(F.count("*").alias("cnt"))

    def references(self) -> DataFrame:
        """(chunk_id, file_id, refs)."""
        return self.occurrences.groupBy("chunk_id", "file_id").agg(F.count("*").alias("refs"))

    def stats(self) -> DataFrame:
        """(total_chunks, total_tokens) over distinct contents; only hashes and counts are shuffled."""
        if self.stored_stats is not None:
            return self.stored_stats
        one = self.occurrences.select("chunk_id", F.size(tokens(F.col("content"))).alias("n")).groupBy("chunk_id").agg(F.first("n").alias("n"))
        return one.agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_tokens"))

    def trigram_bitmaps(self) -> DataFrame:
        """(bucket, bitmap): the set of trigrams that occur, 32,768 to a bitmap."""
        # made distinct first: rows of a bitmap are sorted to be aggregated
        found = self.distinct_trigrams().select(F.col("trigram").cast("long").alias("trigram"))
        return found.groupBy(F.bitmap_bucket_number("trigram").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("trigram")).alias("bitmap"))

    def distinct_trigrams(self) -> DataFrame:
        """(trigram) of all that occur; a text's own are made distinct in place, and contents are not shuffled."""
        if self.postings is None or self.made:
            rows = self.occurrences.select(F.explode(trigram_bag(self.encoding.column(F.col("content")))["trigram"]).alias("trigram"))
        else:
            rows = self.still_live(self.postings).select("trigram")
        return rows.distinct()

    def still_live(self, rows: DataFrame) -> DataFrame:
        return rows if self.live is None else rows.join(self.live, self.key, "left_semi")

    def _found(self, trigrams: list[int]) -> DataFrame:
        rows = self.still_live(self.postings_of(trigrams))
        return rows.groupBy("trigram").agg(F.count("*").alias("df"))

    def counts(self, trigrams: list[int]) -> tuple[list[tuple[int, int]], int, int]:
        """(trigram, df) of each trigram, the number of chunks and of their tokens; text is scanned once."""
        asked = list(dict.fromkeys(trigrams))
        if self.postings is not None and not self.made:
            found = {r.trigram: r.df for r in self._found(asked).collect()}
            return [(t, found.get(t, 0)) for t in asked], *self.stats().first()
        hits = has_trigrams(self.encoding, F.col("content"), asked)
        rows = self.occurrences.select("chunk_id", F.size(tokens(F.col("content"))).alias("n"), *[h.cast("int").alias(f"h{i}") for i, h in enumerate(hits)])
        names = ["n", *(f"h{i}" for i in range(len(asked)))]
        one = rows.groupBy("chunk_id").agg(*[F.max(c).alias(c) for c in names])
        r = one.agg(F.count("*").alias("total"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
        return [(t, r[f"h{i}"]) for i, t in enumerate(asked)], r.total, r.n

    def frequencies(self, trigrams: list[int]) -> DataFrame:
        """(trigram, df) of each trigram asked for, 0 included."""
        spark = self.occurrences.sparkSession
        asked = spark.createDataFrame([(i, t) for i, t in enumerate(dict.fromkeys(trigrams))], "i int, trigram int")
        if self.postings is not None:
            found = self._found(trigrams)
        else:
            distinct = list(dict.fromkeys(trigrams))
            hits = F.array_compact(F.array(*[F.when(h, t) for t, h in zip(distinct, has_trigrams(self.encoding, F.col("content"), distinct))]))
            one = self.occurrences.select("chunk_id", hits.alias("hits")).where(F.size("hits") > 0).groupBy("chunk_id").agg(F.first("hits").alias("hits"))
            found = one.select(F.explode("hits").alias("trigram")).groupBy("trigram").agg(F.count("*").alias("df"))
        # as many rows as the query has trigrams
        return asked.join(found, "trigram", "left").orderBy("i").select("trigram", F.coalesce("df", F.lit(0)).alias("df"))


def any_of(parts: list[Column]) -> Column:
    out = parts[0] if parts else F.lit(False)
    for p in parts[1:]:
        out = out | p
    return out


def latin(trigram: int) -> str:
    return trigram.to_bytes(3, "big").decode("latin-1")


_BLANK = "[ \\t\\n\\r]"


def _direct_pattern(encoding: Encoding, trigram: int) -> tuple[str, str] | None:
    """("text", characters) or ("pattern", regular expression) that the trigram's places in the encoded bytes have in the
    text itself; None if there is no such simple form.  A zero byte stands for a run of blanks, or for a zero."""
    g = latin(trigram)
    if encoding.case_insensitive or encoding.aliases or not g.isascii() or "\0\0" in g:
        return None
    if "\0" not in g:
        return "text", g
    parts = []
    for i, c in enumerate(g):
        if c != "\0":
            parts.append(f"\\x{ord(c):02x}")
        elif i == 0:  # blanks at the start of a text are no byte
            parts.append(f"(?:(?<=[^ \\t\\n\\r]){_BLANK}+|\\x00)")
        elif i == 2:
            parts.append("[ \\t\\n\\r\\x00]")
        else:
            parts.append(f"(?:{_BLANK}+|\\x00)")
    return "pattern", "".join(parts)


def has_trigrams(encoding: Encoding, content: Column, trigrams: list[int]) -> list[Column]:
    """For each trigram, whether the content has it.  Most are looked for in the text as it is, in generated code; the
    rest in its bytes."""
    data = encoding.byte_string(content)
    out = []
    for t in trigrams:
        kind, what = _direct_pattern(encoding, t) or ("bytes", latin(t))
        out.append(content.rlike(what) if kind == "pattern" else F.contains(content if kind == "text" else data, F.lit(what)))
    return out


def count_trigrams(encoding: Encoding, content: Column, trigrams: list[int]) -> Column:
    """An array of how often the content has each trigram, overlaps included."""
    direct = [_direct_pattern(encoding, t) for t in trigrams]
    if any(d is None for d in direct):
        return let(encoding.byte_string(content), lambda b: F.array(*[occurrences_in(b, t) for t in trigrams]))
    return F.array(*[occurrences_in(content, t) if kind == "text" else F.regexp_count(content, F.lit(_overlapping(what))) for t, (kind, what) in zip(trigrams, direct)])


def _overlapping(pattern: str) -> str:
    """So that a match takes no characters: what is before the first blank may end another match."""
    head = f"(?:(?<=[^ \\t\\n\\r]){_BLANK}+|\\x00)"
    if not pattern.startswith(head):
        return f"(?={pattern})"
    rest = pattern[len(head) :]
    return f"(?<=[^ \\t\\n\\r])(?={_BLANK}+{rest})|(?=\\x00{rest})"


def occurrences_in(text: Column, trigram: int) -> Column:
    """How often a trigram occurs in a byte string, overlaps included."""
    g = latin(trigram)
    if g[0] == g[2]:  # it can overlap with itself
        escaped = "".join(f"\\x{ord(c):02x}" for c in g)
        return F.regexp_count(text, F.lit(f"(?={escaped})"))
    return ((F.length(text) - F.length(F.replace(text, F.lit(g), F.lit("")))) / 3).cast("int")
