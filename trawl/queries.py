"""Queries over the test tables, one for each operator, and DuckDB SQL for the same rows.

Documents are files of lines: path "doc/<doc_id>", one chunk a line.  Scores are rounded to 6 places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.database import Change, Database
from trawl.functions.text import Encoding, fnv1a_column, parse_terms, tokens, trigram_set, trigram_text_column
from trawl.operators import chunkers, search
from trawl.operators.corpus import Corpus
from trawl.plans.options import Options, keep_rare, keep_rarest
from trawl.sources.files import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text")


def corpus(spark: SparkSession, sf_dir: str, encoding: Encoding | None = None) -> Corpus:
    return Corpus.of(chunkers.chunked_lines(files(spark, sf_dir)), encoding)


# ---- SQL parts

LINES = """lines AS (
  SELECT file_id, 'doc/' || file_id AS path, pos, (pos + 1) || '-' || (pos + 1) AS location, content, sha256(content) AS chunk_id
  FROM (
    SELECT doc_id AS file_id, unnest(l) AS content, unnest(range(len(l))) AS pos
    FROM (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS l FROM documents)
  )
)"""
_HEX = "hex(encode(regexp_replace(regexp_replace(content, '^[ \\t\\n\\r]+', ''), '[ \\t\\n\\r]+', chr(0), 'g')))"
WINDOWS = f"""windows AS MATERIALIZED (
  SELECT *, list_filter([substring(h, i, 6) FOR i IN range(1, length(h) - 4, 2)],
    lambda w: NOT regexp_matches(w, '^[89ABEF].[89AB].[89AB].$')) AS w
  FROM (SELECT *, {_HEX} AS h FROM lines)
)"""
TOKENS = "regexp_extract_all(lower(content), '[^ \\t\\n\\r]+')"
BASE = f"WITH {LINES}, {WINDOWS}"


def _hex(t: int) -> str:
    return f"{t:06X}"


def _trigrams(text: str) -> list[list[int]]:
    return [list(dict.fromkeys(Encoding().trigrams(t))) for t in parse_terms(text)]


def _has(ts: list[int]) -> str:
    return "(" + " AND ".join(f"list_contains(w, '{_hex(t)}')" for t in ts) + ")"


def _tf(t: int) -> str:
    return f"len(list_filter(w, lambda x: x = '{_hex(t)}'))"


def _condition(text: str, loose: bool = False) -> str:
    return (" OR " if loose else " AND ").join(_has(ts) for ts in _trigrams(text) if ts)


def _resolve(score: str, where: str, source: str = "windows") -> str:
    """Results: one row for each chunk and file."""
    return f"""SELECT any_value(path) AS path, min_by(location, pos) AS location, CAST(round(any_value(score), 6) AS DOUBLE) AS score, file_id
FROM (SELECT *, {score} AS score FROM {source} WHERE {where}) WHERE score > 0 GROUP BY chunk_id, file_id"""


def _rows(found: DataFrame) -> DataFrame:
    return found.select("path", "location", F.round("score", 6).alias("score"), "file_id")


# ---- chunkers


@query(f"WITH {LINES} SELECT file_id, CAST(pos AS INTEGER) AS pos, location, content FROM lines")
def chunk_lines(spark, sf_dir):
    return chunkers.chunked_lines(files(spark, sf_dir)).select("file_id", "pos", "location", "content")


@query(f"WITH {LINES} SELECT chunk_id, count(*) AS n_occurrences, count(DISTINCT file_id) AS n_files, octet_length(encode(any_value(content))) AS content_len FROM lines GROUP BY chunk_id")
def chunk_dedup(spark, sf_dir):
    refs = corpus(spark, sf_dir).occurrences.select("chunk_id", "file_id", F.octet_length("content").alias("n"))
    per_file = refs.groupBy("chunk_id", "file_id").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    return per_file.groupBy("chunk_id").agg(F.sum("c").alias("n_occurrences"), F.count("*").alias("n_files"), F.first("n").alias("content_len"))


@query("""
WITH l AS (SELECT doc_id AS file_id, CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') END AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT file_id, l, unnest(range(0, len(l), 6)) AS a FROM l)
SELECT file_id, CAST(a / 6 AS INTEGER) AS pos, (a + 1) || '-' || least(a + 8, len(l)) AS location,
  replace(array_to_string(l[a + 1:a + 8], ''), chr(10), '\\n') AS content FROM w
""")
def chunk_lines_overlap(spark, sf_dir):
    return chunkers.line_windows(files(spark, sf_dir), 8, 2).select("file_id", "pos", "location", "content")


@query("""
WITH l AS (SELECT doc_id AS file_id, regexp_extract_all(text, '[^\\t\\n\\f\\r ]+[\\t\\n\\f\\r ]*') AS l FROM documents),
w AS (SELECT file_id, l, unnest(range(0, len(l), 30)) AS a FROM l)
SELECT file_id, CAST(a / 30 AS INTEGER) AS pos, 'w' || CAST(a / 30 + 1 AS INTEGER) AS location,
  replace(regexp_replace(array_to_string(l[a + 1:a + 40], ''), '[\\t\\n\\f\\r ]+$', ''), chr(10), '\\n') AS content FROM w
""")
def chunk_words_overlap(spark, sf_dir):
    return chunkers.word_window_rows(files(spark, sf_dir), 40, 10).select("file_id", "pos", "location", "content")


@query("""
SELECT doc_id AS file_id, array_to_string(l[2:4], '') AS content
FROM (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS l FROM documents) WHERE len(l) >= 4
""")
def chunk_random_access(spark, sf_dir):
    found = files(spark, sf_dir).select("file_id", chunkers.line_range(F.col("text"), F.lit("2-4")).alias("content"))
    return found.where("content is not null")


def _state_machine(name: str, source: str, key: str, text: str):
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, source).select(F.col(key).alias("file_id"), F.col(text).alias("text"))
        return chunkers.chunked(docs, name).drop("attrs")

    return run


QUERIES |= {
    "chunk_markdown": _state_machine("markdown", "documents", "doc_id", "text"),
    "chunk_bracket": _state_machine("bracket-js", "pages", "page_id", "html"),
    "chunk_indent": _state_machine("indent-js-4", "pages", "page_id", "html"),
}


_IN, _OUT = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


@query(f"""
WITH l AS (SELECT doc_id AS file_id, octet_length(encode(regexp_extract(text, '^{_OUT}*'))) AS p, regexp_extract_all(text, '{_IN}+{_OUT}*') AS l FROM documents),
w AS (SELECT file_id, p, l, unnest(range(0, len(l), 30)) AS a FROM l),
c AS (SELECT file_id, a // 30 AS n, p + octet_length(encode(array_to_string(l[1:a], ''))) AS b, regexp_replace(array_to_string(l[a + 1:a + 40], ''), '{_OUT}+$', '') AS content FROM w)
SELECT file_id, CAST(n AS INTEGER) AS pos, 'w' || (n + 1) AS location, CAST(b AS INTEGER) AS byte_start, CAST(b + octet_length(encode(content)) AS INTEGER) AS byte_end, content FROM c
""")
def chunk_word_pattern(spark, sf_dir):
    chunker = chunkers.Chunker(chunkers.word_windows(40, 10, r"\w+"), resumes=False)
    return chunkers.chunked(files(spark, sf_dir).select("file_id", "text"), chunker).drop("attrs")


# ---- trigrams, tokens, statistics


@query(f"{BASE} SELECT CAST('0x' || t AS INTEGER) AS trigram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM (SELECT chunk_id, t, count(*) AS tf FROM (SELECT DISTINCT ON (chunk_id) chunk_id, w FROM windows), unnest(w) AS u(t) GROUP BY chunk_id, t) GROUP BY t")
def trigram_df(spark, sf_dir):
    return corpus(spark, sf_dir).make_postings().groupBy("trigram").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query(f"{BASE} SELECT file_id, count(*) AS n_trigrams, CAST(sum(n) AS BIGINT) AS n_windows FROM (SELECT file_id, t, count(*) AS n FROM windows, unnest(w) AS u(t) GROUP BY file_id, t) GROUP BY file_id")
def trigram_counts_by_file(spark, sf_dir):
    lines = F.transform(chunkers.line_column(F.col("text")), Encoding().column)
    found = files(spark, sf_dir).select("file_id", trigram_set(lines).alias("t")).select("file_id", "t.*")
    # a file is a row, mostly; its trigrams are counted in place
    n = F.size(F.array_distinct(F.flatten(F.collect_list("trigrams")))).cast("long")
    return found.groupBy("file_id").agg(n.alias("n_trigrams"), F.sum("n").alias("n_windows")).where("n_windows > 0")


@query(f"{BASE} SELECT bucket, count(*) AS n FROM (SELECT DISTINCT t, 1 + (CAST('0x' || t AS BIGINT) - 1) // 32768 AS bucket FROM windows, unnest(w) AS u(t) WHERE t <> '000000') GROUP BY bucket")
def trigram_bitmaps(spark, sf_dir):
    return corpus(spark, sf_dir).trigram_bitmaps().select("bucket", F.bitmap_count("bitmap").alias("n"))


@query(f"WITH {LINES} SELECT file_id, token, count(*) AS cnt FROM (SELECT file_id, unnest({TOKENS}) AS token FROM lines) GROUP BY file_id, token")
def token_bag(spark, sf_dir):
    return corpus(spark, sf_dir).file_tokens()


@query(f"WITH {LINES} SELECT count(*) AS total_chunks, CAST(sum(n) AS BIGINT) AS total_tokens FROM (SELECT chunk_id, any_value(len({TOKENS})) AS n FROM lines GROUP BY chunk_id)")
def corpus_stats(spark, sf_dir):
    return corpus(spark, sf_dir).stats()


@query(f"WITH {LINES} SELECT chunk_id, any_value(octet_length(encode(content))) AS content_len, any_value(len(list_distinct({TOKENS}))) AS n_tokens_distinct, any_value(len({TOKENS})) AS n_tokens_total FROM lines GROUP BY chunk_id")
def chunk_records(spark, sf_dir):
    return corpus(spark, sf_dir).chunks.select("chunk_id", "content_len", "n_tokens_distinct", "n_tokens_total")


@query("""
SELECT p_name, list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(range(1, 2 * octet_length(encode(p_name)), 2),
  lambda i: CAST('0x' || substring(hex(encode(p_name)), CAST(i AS BIGINT), 2) AS HUGEINT))),
  lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS token_hash
FROM part GROUP BY p_name
""")
def token_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name").distinct().withColumn("token_hash", fnv1a_column(F.col("p_name")))


@query(f"WITH {LINES} SELECT token, chunk_id, count(*) AS cnt FROM (SELECT chunk_id, unnest({TOKENS}) AS token FROM (SELECT chunk_id, any_value(content) AS content FROM lines GROUP BY chunk_id)) GROUP BY token, chunk_id")
def token_postings(spark, sf_dir):
    return corpus(spark, sf_dir).token_postings().select("token", "chunk_id", "cnt")


@query(f"WITH {LINES} SELECT chunk_id, file_id, count(*) AS refs FROM lines GROUP BY chunk_id, file_id")
def references(spark, sf_dir):
    return corpus(spark, sf_dir).references()


@query(f"WITH {LINES} SELECT file_id, array_to_string(list(octet_length(encode(content)) ORDER BY pos), ',') AS lengths FROM lines GROUP BY file_id")
def chunk_content_lengths(spark, sf_dir):
    rows = corpus(spark, sf_dir).occurrences.select("file_id", F.struct("pos", F.octet_length("content").cast("string").alias("n")).alias("c"))
    return rows.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list("c"))["n"], ",").alias("lengths"))


_WHOLE = "License under"


@query(f"""{BASE}, asked AS (SELECT unnest([{", ".join(f"'{_hex(t)}'" for t in dict.fromkeys(Encoding().trigrams(_WHOLE)))}]) AS t)
SELECT CAST('0x' || asked.t AS INTEGER) AS trigram, CAST(count(c.chunk_id) AS BIGINT) AS df
FROM asked LEFT JOIN (SELECT DISTINCT chunk_id, t FROM windows, unnest(w) AS u(t)) c ON c.t = asked.t GROUP BY asked.t""")
def query_trigram_counts(spark, sf_dir):
    return search.query_frequencies(corpus(spark, sf_dir), _WHOLE)


@query(f"{BASE} SELECT DISTINCT CAST('0x' || t AS INTEGER) AS trigram, replace(chr(CAST('0x' || t[1:2] AS INTEGER)) || chr(CAST('0x' || t[3:4] AS INTEGER)) || chr(CAST('0x' || t[5:6] AS INTEGER)), chr(0), ' ') AS shown FROM windows, unnest(w) AS u(t) WHERE regexp_matches(t, '^[0-7].[0-7].[0-7].$')")
def trigram_shown(spark, sf_dir):
    found = corpus(spark, sf_dir).distinct_trigrams()
    ascii_only = (F.col("trigram").bitwiseAND(0x808080)) == 0
    return found.where(ascii_only).select("trigram", trigram_text_column(F.col("trigram")).alias("shown"))


# ---- search


def _search(name: str, text: str, options: Options, sql: str | None, indexed: bool = False):
    def run(spark, sf_dir):
        c = corpus(spark, sf_dir)
        return _rows(search.search(c.with_postings() if indexed else c, text, options))

    QUERIES[name] = run
    if sql:
        ORACLE[name] = f"{BASE} {sql}"


_AND = "Licensed License"
_PHRASE = '"under the" License'
_LOOSE = "License reserved ab xylophone"


def _sum_of(parts: list[str]) -> str:
    return "(" + " + ".join(parts) + ")"


def _flat(text: str) -> list[int]:
    return list(dict.fromkeys(t for ts in _trigrams(text) for t in ts))


_search("search_and", _AND, Options(), _resolve("1.0", _condition(_AND)))
_search("search_and_indexed", _AND, Options(), _resolve("1.0", _condition(_AND)), indexed=True)
_search("search_phrase", _PHRASE, Options(), _resolve("1.0", _condition(_PHRASE)))
_loose_score = _sum_of([f"CAST({_has(ts)} AS INTEGER)" for ts in _trigrams(_LOOSE) if ts]) + f" / {len(parse_terms(_LOOSE))}.0"
_search("search_loose", _LOOSE, Options(loose=True), _resolve(_loose_score, _condition(_LOOSE, True)))
_search(
    "search_loose_coverage", _LOOSE, Options(loose=True, scoring="coverage"),
    _resolve(_sum_of([f"CAST({_has([t])} AS INTEGER)" for t in _flat(_LOOSE)]) + f" / {len(_flat(_LOOSE))}.0", _condition(_LOOSE, True)),
)
_search("search_density", "the and", Options(scoring="density"), _resolve(_sum_of([_tf(t) for t in _flat("the and")]) + f" * 1.0 / len(list_distinct({TOKENS}))", _condition("the and")))
_search("search_overlap", "the and", Options(scoring="overlap"), _resolve(f"{len(_flat('the and'))}.0", _condition("the and")))
_search("search_overlap_indexed", "the and", Options(scoring="overlap"), _resolve(f"{len(_flat('the and'))}.0", _condition("the and")), indexed=True)
_search("search_verify", "licensed UNDER", Options(verify=True, loose=True), _resolve(
    _sum_of([f"CAST({_has(ts)} AS INTEGER)" for ts in _trigrams("licensed UNDER")]) + " / 2.0",
    f"({_condition('licensed UNDER', True)}) AND contains(lower(content), 'licensed') AND contains(lower(content), 'under')"))
_search("search_regex_filter", "License", Options(regex=(r"[Vv]ersion \d", "the")), _resolve("1.0", f"{_condition('License')} AND regexp_matches(content, '[Vv]ersion \\d') AND regexp_matches(content, 'the')"))
_search("search_except_regex", "License", Options(except_regex=(r"Apache|MIT",)), _resolve("1.0", f"{_condition('License')} AND NOT regexp_matches(content, 'Apache|MIT')"))


def _bm25_sql(text: str) -> str:
    ts = _flat(text)
    parts = [f"ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) * ({_tf(t)} * 2.2) / ({_tf(t)} + 1.2 * (0.25 + 0.75 * len(list_distinct({TOKENS})) / mean))" for i, t in enumerate(ts)]
    dfs = ", ".join(f"count(DISTINCT CASE WHEN {_has([t])} THEN chunk_id END) AS d{i}" for i, t in enumerate(ts))
    return f""", stats AS (SELECT count(*) AS n, sum(k) / count(*) AS mean FROM (SELECT chunk_id, any_value(len({TOKENS})) AS k FROM lines GROUP BY chunk_id)),
dfs AS (SELECT {dfs} FROM windows) {_resolve(_sum_of(parts), _condition(text), "windows CROSS JOIN stats CROSS JOIN dfs")}"""


_search("search_bm25", _PHRASE, Options(scoring="bm25"), _bm25_sql(_PHRASE))
_search("search_bm25_indexed", _PHRASE, Options(scoring="bm25"), _bm25_sql(_PHRASE), indexed=True)


def _chosen_sql(text: str, choose: str) -> str:
    """Search by coverage with a choice of trigrams by df: a term is met by having its chosen trigrams."""
    values = ", ".join(f"({i}, '{_hex(t)}')" for i, ts in enumerate(_trigrams(text)) for t in ts)
    return f""", q(term, t) AS (VALUES {values}), post AS (SELECT DISTINCT chunk_id, t FROM windows, unnest(w) AS u(t)),
df AS (SELECT t, count(chunk_id) AS n FROM (SELECT DISTINCT t FROM q) LEFT JOIN post USING (t) GROUP BY t),
chosen AS ({choose}), a AS (SELECT * FROM q JOIN chosen USING (t)),
met AS (SELECT chunk_id FROM a JOIN post USING (t) GROUP BY chunk_id HAVING count(*) = (SELECT count(*) FROM a))
{_resolve("1.0", "chunk_id IN (SELECT chunk_id FROM met)")}"""


_search("search_filter_ratio", _AND, Options(trigram_filter=keep_rare(0.05)), _chosen_sql(_AND, "SELECT t FROM df WHERE n <= floor((SELECT count(DISTINCT chunk_id) FROM lines) * 0.05)"))
_search("search_filter_bestn", _AND, Options(trigram_filter=keep_rarest(4)), _chosen_sql(_AND, "SELECT t FROM df ORDER BY n, t LIMIT 4"))


@query(f"WITH {LINES} {_resolve('1.0', "regexp_matches(content, '(Licen[sc]ed?|[Rr]eserved) .*[a-m]')", 'lines')}")
def search_regex(spark, sf_dir):
    return _rows(search.search_regex(corpus(spark, sf_dir), "(Licen[sc]ed?|[Rr]eserved) .*[a-m]"))


@query(ORACLE["search_regex"])
def search_regex_indexed(spark, sf_dir):
    return _rows(search.search_regex(corpus(spark, sf_dir).with_postings(), "(Licen[sc]ed?|[Rr]eserved) .*[a-m]"))


_FUZZY = "Lisenced undre teh Licence"
_fuzzy_score = _sum_of([f"CAST({_has([t])} AS INTEGER)" for t in _flat(_FUZZY)]) + f" / {len(_flat(_FUZZY))}.0"


def _fuzzy(spark, sf_dir, indexed):
    c = corpus(spark, sf_dir)
    return _rows(search.search_fuzzy(c.with_postings() if indexed else c, _FUZZY, 20))


ORACLE["search_fuzzy_topk"] = f"""{BASE}, s AS (SELECT *, {_fuzzy_score} AS s FROM windows),
best AS (SELECT chunk_id, any_value(s) AS s FROM s GROUP BY chunk_id ORDER BY s DESC, chunk_id LIMIT 20)
SELECT * FROM ({_resolve("s", "chunk_id IN (SELECT chunk_id FROM best)", "s")}) ORDER BY score DESC, path, location LIMIT 20"""
ORACLE["search_fuzzy_topk_indexed"] = ORACLE["search_fuzzy_topk"]
QUERIES["search_fuzzy_topk"] = lambda spark, sf_dir: _fuzzy(spark, sf_dir, False)
QUERIES["search_fuzzy_topk_indexed"] = lambda spark, sf_dir: _fuzzy(spark, sf_dir, True)


def _multi_part(name: str, score: str) -> str:
    return f"""SELECT '{name}' AS strategy, * FROM ({_resolve(score, _condition("the and"))}) ORDER BY score DESC, path, location LIMIT 50"""


@query(f"""{BASE} SELECT * FROM ({_multi_part("coverage", "1.0")}) UNION ALL SELECT * FROM ({_multi_part("overlap", f"{len(_flat('the and'))}.0")})
UNION ALL SELECT * FROM ({_multi_part("density", _sum_of([_tf(t) for t in _flat("the and")]) + f" * 1.0 / len(list_distinct({TOKENS}))")})""")
def search_multi(spark, sf_dir):
    found = search.search_multi(corpus(spark, sf_dir), "the and", {"coverage": "coverage", "overlap": "overlap", "density": "density"}, 50)
    return found.select("strategy", "path", "location", F.round("score", 6).alias("score"), "file_id")


@query(f"""{BASE} SELECT CAST(pos AS INTEGER) AS pos, location, CAST(round({_sum_of([f"CAST({_has([t])} AS INTEGER)" for t in _flat("the License")])} / {len(_flat("the License"))}.0, 6) AS DOUBLE) AS score
FROM windows WHERE path = 'doc/5'""")
def score_file(spark, sf_dir):
    return _scores_of_file(corpus(spark, sf_dir))


def _scores_of_file(c: Corpus) -> DataFrame:
    """No rows where the file is missing."""
    try:
        found = search.score_file(c, "the License", "doc/5")
    except KeyError:
        found = c.occurrences.where("false").select("pos", "location", F.lit(0.0).alias("score"))
    return found.withColumn("score", F.round("score", 6))


@query(f"WITH {LINES} SELECT path, location, content, CAST(pos AS INTEGER) AS \"index\" FROM lines WHERE path = 'doc/5' AND pos BETWEEN 0 AND 3")
def get_chunks(spark, sf_dir):
    return _around_second(corpus(spark, sf_dir))


def _around_second(c: Corpus) -> DataFrame:
    """The second line of a file with one before it and two after; of a file without a second line, what there is."""
    try:
        found = search.get_chunks(c, "doc/5", "2-2", 1, 2)
    except KeyError:
        found = search.chunks_between(c, "doc/5", 0, 3)
    return found.select("path", "location", "content", "index")


@query(f"WITH {LINES} SELECT a.path, a.location AS target_location, b.location, CAST(b.pos AS INTEGER) AS \"index\" FROM lines a JOIN lines b ON a.file_id = b.file_id AND abs(a.pos - b.pos) <= 1 WHERE contains(a.content, 'License')")
def neighbours_of_matches(spark, sf_dir):
    c = corpus(spark, sf_dir)
    targets = c.occurrences.where(F.contains("content", F.lit("License"))).select("path", "location")
    return search.neighbours(c, targets, 1, 1).select("path", "target_location", "location", "index")


_search("search_only", "License", Options(only=(frozenset(range(0, 400)), frozenset(range(200, 900)))), _resolve("1.0", f"{_condition('License')} AND file_id BETWEEN 200 AND 399"))
_search("search_except", "License", Options(except_files=frozenset(range(0, 300))), _resolve("1.0", f"{_condition('License')} AND NOT file_id BETWEEN 0 AND 299"))
_LONG = lambda content, attrs, n_tokens: n_tokens >= 12
_search("search_chunk_filter", "the", Options(chunk_filters=(_LONG,)), _resolve("1.0", f"{_condition('the')} AND len(list_distinct({TOKENS})) >= 12"))
_CASE = Encoding(case_insensitive=True, aliases={"-": " "})


@query(f"""WITH {LINES}, {WINDOWS.replace("replace(content", "replace(replace(lower(content), '-', ' ')").replace("regexp_replace(replace(", "regexp_replace(replace(")} {_resolve("1.0", " AND ".join(_has(list(dict.fromkeys(_CASE.trigrams(t)))) for t in parse_terms("LICENSE under-THE")))}""")
def search_case_insensitive_aliases(spark, sf_dir):
    return _rows(search.search(corpus(spark, sf_dir, _CASE), "LICENSE under-THE"))


@query(f"""{BASE}, cand AS (SELECT any_value(path) AS path, min_by(location, pos) AS location, file_id, any_value(regexp_extract_all(lower(content), '\\S+')) AS t FROM windows
  WHERE {_condition("the License")} GROUP BY chunk_id, file_id),
top AS (SELECT * FROM cand ORDER BY path, location LIMIT 200),
spots AS (SELECT path, location, file_id, len(t) AS n, [i FOR i IN range(len(t)) IF contains(t[i + 1], 'the')] AS p, [i FOR i IN range(len(t)) IF contains(t[i + 1], 'license')] AS q FROM top),
spans AS (SELECT path, location, file_id, CASE WHEN len(p) = 0 OR len(q) = 0 THEN 0 ELSE least(n, list_min([list_min([abs(x - y) FOR y IN q]) FOR x IN p])) END AS span FROM spots)
SELECT path, location, CAST(round(1.0 + CASE WHEN span > 0 THEN 1.0 / (1 + span) ELSE 0 END, 6) AS DOUBLE) AS score, file_id FROM spans
UNION ALL SELECT path, location, CAST(1.0 AS DOUBLE), file_id FROM cand WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.path = cand.path AND top.location = cand.location)""")
def proximity_rerank(spark, sf_dir):
    return _rows(search.search(corpus(spark, sf_dir), "the License", Options(proximity=200)))


@query("""
SELECT 'event/' || event_id AS path, 'all' AS location, CAST(1.0 AS DOUBLE) AS score, event_id AS file_id FROM events
WHERE contains(props, '"k"') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND NOT regexp_matches(props, '"k": ?1')
""")
def search_after_before(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    rows = events.select(
        F.col("event_id").alias("file_id"), F.concat(F.lit("event/"), F.col("event_id").cast("string")).alias("path"), F.lit(0).alias("pos"), F.lit("all").alias("location"),
        F.col("props").alias("content"), F.array(F.struct(F.lit("timestamp").alias("key"), ns.cast("string").alias("value"))).alias("attrs"),
        F.concat_ws("/", "props", F.col("event_id").cast("string")).alias("chunk_id"),
    )
    day = 86_400_000_000_000
    first = 1_704_067_200_000_000_000
    return _rows(search.search_regex(Corpus.of(rows), '"k"', Options(after=first + 4 * day, before=first + 19 * day, except_regex=('"k": ?1',))))


@query("""
SELECT 'conv/' || conv_id AS path, CAST(turn AS VARCHAR) AS location, role, text AS content FROM conversations
WHERE regexp_matches(text, '[Tt]he .*and')
""")
def conversation_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select(
        F.col("conv_id").alias("file_id"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").cast("int").alias("pos"),
        F.col("turn").cast("string").alias("location"), F.col("text").alias("content"), F.array(F.struct(F.lit("role").alias("key"), F.col("role").alias("value"))).alias("attrs"),
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"),
    )
    from trawl.functions.text import pair_get

    c = Corpus.of(rows)
    found = search.search_regex(c, "[Tt]he .*and").select("chunk_id")
    return c.occurrences.join(found, "chunk_id").select("path", "location", pair_get(F.col("attrs"), "role").alias("role"), "content")


# ---- a stored database of all documents.  Ids of its files go by path, so results name files by doc_id.

_databases: dict[tuple[str, str], Database] = {}


def database(spark: SparkSession, sf_dir: str) -> Database:
    """All documents, stored with their index; made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _databases:
        db = Database.create(spark, f"{scratch_folder(spark)}/database-{uuid.uuid4().hex}")
        db.add(stored_files(spark, sf_dir))
        _databases[key] = db
    return _databases[key]


def changed(spark: SparkSession, sf_dir: str) -> Database:
    """One that may be changed, on the same segments."""
    return database(spark, sf_dir).fork(f"{scratch_folder(spark)}/database-{uuid.uuid4().hex}")


def stored_files(spark: SparkSession, sf_dir: str, text=None) -> DataFrame:
    content = F.col("text") if text is None else text
    return files(spark, sf_dir).select("path", content.alias("content"), (F.col("file_id") * 1000).alias("mod_time_ns"))


_DOC = r"cast(regexp_extract(path, '(\\d+)$', 1) as long)"


def _by_doc(found: DataFrame, *more: str) -> DataFrame:
    return found.select(*more, "path", "location", F.round("score", 6).alias("score"), F.expr(_DOC).alias("file_id"))


def _db(name: str, like: str, run: Callable[[Database], DataFrame]):
    """The query ``like`` on the stored database."""
    QUERIES[name] = lambda spark, sf_dir: _by_doc(run(database(spark, sf_dir)))
    ORACLE[name] = ORACLE[like]


_db("db_search_and", "search_and", lambda db: db.search(_AND))
_db("db_search_phrase", "search_phrase", lambda db: db.search(_PHRASE))
_db("db_search_loose", "search_loose", lambda db: db.search(_LOOSE, Options(loose=True)))
_db("db_search_density", "search_density", lambda db: db.search("the and", Options(scoring="density")))
_db("db_search_bm25", "search_bm25", lambda db: db.search(_PHRASE, Options(scoring="bm25")))
_db("db_search_regex", "search_regex", lambda db: db.search_regex("(Licen[sc]ed?|[Rr]eserved) .*[a-m]"))
_db("db_search_fuzzy", "search_fuzzy_topk", lambda db: db.search_fuzzy(_FUZZY, 20))
_db("db_search_verify", "search_verify", lambda db: db.search("licensed UNDER", Options(verify=True, loose=True)))
_db("db_search_filter_ratio", "search_filter_ratio", lambda db: db.search(_AND, Options(trigram_filter=keep_rare(0.05))))


@query(ORACLE["search_multi"])
def db_search_multi(spark, sf_dir):
    return _by_doc(database(spark, sf_dir).search_multi("the and", {"coverage": "coverage", "overlap": "overlap", "density": "density"}, 50), "strategy")


@query(ORACLE["score_file"])
def db_score_file(spark, sf_dir):
    return _scores_of_file(database(spark, sf_dir).corpus())


@query(ORACLE["get_chunks"])
def db_get_chunks(spark, sf_dir):
    return _around_second(database(spark, sf_dir).corpus())


@query(ORACLE["corpus_stats"])
def db_stats(spark, sf_dir):
    return database(spark, sf_dir).stats()


@query(ORACLE["query_trigram_counts"])
def db_query_frequencies(spark, sf_dir):
    return database(spark, sf_dir).query_frequencies(_WHOLE)


@query("SELECT 'doc/' || doc_id AS path, doc_id * 1000 AS mod_time_ns, sha256(text) AS content_hash, octet_length(encode(text)) AS file_length, 'line' AS strategy FROM documents")
def db_files(spark, sf_dir):
    """What is known of each file, after the database was opened anew."""
    return Database.open(spark, database(spark, sf_dir).root).files.drop("file_id")


@query(f"WITH {LINES} SELECT path, CAST(pos AS INTEGER) AS pos, location, chunk_id FROM lines")
def db_occurrences(spark, sf_dir):
    db = database(spark, sf_dir)
    return db.occurrences.join(db.file_paths(), "file_id").select("path", "pos", "location", "chunk_id")


@query(f"WITH {LINES} SELECT DISTINCT chunk_id, content FROM lines")
def db_chunks(spark, sf_dir):
    return database(spark, sf_dir).chunks


@query(f"{BASE} SELECT CAST('0x' || t AS INTEGER) AS trigram, chunk_id, CAST(count(*) AS INTEGER) AS tf FROM (SELECT DISTINCT ON (chunk_id) chunk_id, w FROM windows), unnest(w) AS u(t) GROUP BY chunk_id, t")
def db_postings(spark, sf_dir):
    return database(spark, sf_dir).postings


@query(f"WITH {LINES} SELECT path, array_to_string(list(octet_length(encode(content)) ORDER BY pos), ',') AS lengths FROM lines GROUP BY path")
def db_chunk_lengths(spark, sf_dir):
    db = database(spark, sf_dir)
    lengths = db.chunk_lengths().withColumn("lengths", F.array_join(F.transform("lengths", lambda x: x.cast("string")), ","))
    return lengths.join(db.file_paths(), "file_id").select("path", "lengths")


@query(f"""{BASE}, c AS (SELECT DISTINCT ON (chunk_id) chunk_id, content, w FROM windows)
SELECT 'files' AS "table", count(*) AS n_rows, CAST(sum(octet_length(encode('doc/' || doc_id))) AS BIGINT) AS bytes FROM documents
UNION ALL SELECT 'occurrences', count(*), CAST(sum(octet_length(encode(location))) AS BIGINT) FROM lines
UNION ALL SELECT 'chunks', count(*), CAST(sum(octet_length(encode(content))) AS BIGINT) FROM c
UNION ALL SELECT 'postings', CAST(sum(len(list_distinct(w))) AS BIGINT), CAST(sum(len(list_distinct(w))) * 8 AS BIGINT) FROM c""")
def db_record_counts(spark, sf_dir):
    return database(spark, sf_dir).record_counts()


@query(f"WITH {LINES}, {WINDOWS} SELECT path, location, content FROM (SELECT any_value(path) AS path, min_by(location, pos) AS location, any_value(content) AS content FROM windows WHERE {_condition(_AND)} GROUP BY chunk_id, file_id)")
def db_contents_of_results(spark, sf_dir):
    """Results with their contents, through the cache of the files they are in."""
    db = database(spark, sf_dir)
    found = db.search(_AND)
    return db.chunk_cache(found.select("path")).contents(found).select("path", "location", "content")


# ---- changes: files of even doc_id are removed, reindexed or appended to; the others stay


def _orphans(change: Change) -> DataFrame:
    return change.orphaned_chunks.select("chunk_id", F.octet_length("content").alias("n_bytes"))


_EVEN = "file_id % 2 = 0"


@query(f"WITH {LINES} SELECT chunk_id, CAST(any_value(octet_length(encode(content))) AS INTEGER) AS n_bytes FROM lines WHERE file_id % 2 = 0 AND chunk_id NOT IN (SELECT chunk_id FROM lines WHERE file_id % 2 = 1) GROUP BY chunk_id")
def remove_orphans(spark, sf_dir):
    """Chunks that no file has any more once the even files are removed."""
    return _orphans(changed(spark, sf_dir).remove_all(files(spark, sf_dir).where(_EVEN).select("path")))


@query(f"""{BASE.replace("FROM documents)", "FROM documents WHERE doc_id % 2 = 1)")}{_bm25_sql(_PHRASE)}""")
def db_bm25_after_remove(spark, sf_dir):
    """Frequencies and totals are those of what is left."""
    db = changed(spark, sf_dir)
    db.remove_all(files(spark, sf_dir).where(_EVEN).select("path"))
    return _by_doc(db.search(_PHRASE, Options(scoring="bm25")))


_UPPER = "concat(upper(substring(text, 1, 1)), substring(text, 2))"
_NEW = LINES.replace("lines AS", "new_lines AS").replace("text, '[^", "upper(substring(text, 1, 1)) || substring(text, 2), '[^")


@query(f"WITH {LINES}, {_NEW} SELECT file_id, count(*) AS n_new FROM new_lines WHERE chunk_id NOT IN (SELECT chunk_id FROM lines) GROUP BY file_id")
def reindex_diff(spark, sf_dir):
    """New chunks when every document begins with a capital letter."""
    db = changed(spark, sf_dir)
    change = db.reindex(stored_files(spark, sf_dir, F.expr(_UPPER)))
    new = change.all_chunks.join(change.new_chunks.select("chunk_id"), "chunk_id", "left_semi").join(change.file_ids, "file_id")
    return new.groupBy(F.expr(_DOC).alias("file_id")).agg(F.count("*").alias("n_new"))


_LAST = "(SELECT * FROM lines WHERE path = 'doc/7' ORDER BY pos DESC LIMIT 1)"


@query(f"""WITH {LINES}, last AS {_LAST}, rest AS (
  SELECT unnest(regexp_extract_all(content || 'and more' || chr(10) || 'License at the end', '[^\n]*\n|[^\n]+')) AS content, unnest(range(100)) AS i, pos AS p FROM last WHERE NOT suffix(content, chr(10))
  UNION ALL SELECT unnest(regexp_extract_all('and more' || chr(10) || 'License at the end', '[^\n]*\n|[^\n]+')), unnest(range(100)), pos + 1 FROM last WHERE suffix(content, chr(10)))
SELECT CAST(pos AS INTEGER) AS pos, location, content FROM lines WHERE path = 'doc/7' AND (pos < (SELECT pos FROM last) OR (SELECT suffix(content, chr(10)) FROM last))
UNION ALL SELECT CAST(p + i AS INTEGER), (p + i + 1) || '-' || (p + i + 1), content FROM rest WHERE content IS NOT NULL""")
def db_append(spark, sf_dir):
    """A file after text was appended; its id is the one it had."""
    db = changed(spark, sf_dir)
    before = db.file("doc/7").first()
    if before is None:
        return db.corpus().occurrences.where("false").select("pos", "location", "content")
    db.append("doc/7", "and more\nLicense at the end")
    same = db.file("doc/7").where((F.col("file_id") == before.file_id) & (F.col("content_hash") == before.content_hash))
    return db.corpus().occurrences.join(same.select("file_id"), "file_id", "left_semi").select("pos", "location", "content")


@query("""
SELECT a.doc_id AS file_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN sha256(a.text) = sha256(b.text) THEN 'fresh' ELSE 'stale' END AS status
FROM documents a LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN text || 'x' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0) b ON a.doc_id = b.doc_id
""")
def staleness(spark, sf_dir):
    text = F.when(F.col("file_id") % 3 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    now = files(spark, sf_dir).where("file_id % 5 <> 0").select("path", F.lit(-1).cast("long").alias("mod_time_ns"), F.sha2(text, 256).alias("content_hash"))
    return database(spark, sf_dir).staleness(now).select(F.expr(_DOC).alias("file_id"), "status")


@query(f"WITH {LINES} SELECT path, location FROM lines WHERE file_id % 5 <> 0 AND regexp_matches(content, '^[A-Z].*License') UNION ALL SELECT 'doc/' || doc_id, '1-1' FROM documents WHERE doc_id % 5 = 0")
def db_refresh(spark, sf_dir):
    """Every fifth file has become one line; after a refresh it is found by it."""
    db = changed(spark, sf_dir)
    is_new = F.col("file_id") % 5 == 0
    now = files(spark, sf_dir).select("path", F.when(is_new, F.lit("A new License")).otherwise(F.col("text")).alias("content"), F.when(is_new, -1).otherwise(F.col("file_id") * 1000).cast("long").alias("mod_time_ns"))
    db.refresh(now.withColumn("content_hash", F.sha2("content", 256)))
    found = db.search_regex("^[A-Z].*License")
    return db.corpus().occurrences.join(found.select("chunk_id", "file_id"), ["chunk_id", "file_id"], "left_semi").select("path", "location")


@query(f"""{BASE}, tmp AS (SELECT path, pos, (pos + 1) || '-' || (pos + 1) AS location, content, sha256(content) AS chunk_id FROM (
  SELECT 'tmp://' || item_id AS path, unnest(l) AS content, unnest(range(len(l))) AS pos FROM (SELECT item_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l FROM benchmark))),
both_ AS (SELECT path, pos, location, content, chunk_id FROM lines UNION ALL SELECT path, pos, location, content, chunk_id FROM tmp)
SELECT path, min_by(location, pos) AS location FROM both_ WHERE regexp_matches(content, 'the .* and') GROUP BY chunk_id, path""")
def db_overlay(spark, sf_dir):
    """The database with the passages of the benchmark as temporary files."""
    db = changed(spark, sf_dir)
    for r in table(spark, sf_dir, "benchmark").collect():  # temporary files are held by the driver
        db.add_tmp(f"tmp://{r.item_id}", r.text)
    return db.search_regex("the .* and").select("path", "location")


@query(f"WITH {LINES} SELECT count(*) AS n_occurrences, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT file_id) AS n_files FROM lines WHERE file_id % 2 = 1")
def db_compact(spark, sf_dir):
    db = changed(spark, sf_dir)
    db.remove_all(files(spark, sf_dir).where(_EVEN).select("path"))
    db.compact()
    counts = {t: df.agg(F.count("*").alias(n)) for t, n, df in (("o", "n_occurrences", db.occurrences), ("c", "n_chunks", db.chunks), ("f", "n_files", db.files))}
    one = [df.withColumn("_one", F.lit(1)) for df in counts.values()]
    return one[0].join(one[1], "_one").join(one[2], "_one").drop("_one")


@query(f"""{BASE}, tmp AS (SELECT -1 - item_id AS file_id, 'tmp://' || item_id AS path, 0 AS pos, '1-1' AS location, text AS content, sha256(text) AS chunk_id FROM benchmark),
both_ AS (SELECT file_id, path, pos, location, content, chunk_id FROM lines UNION ALL SELECT file_id, path, pos, location, content, chunk_id FROM tmp)
{_resolve("1.0", "regexp_matches(content, 'the .* and')", "both_")}""")
def overlay_union(spark, sf_dir):
    """Documents and, as temporary files, the passages of the benchmark."""
    tmp = table(spark, sf_dir, "benchmark").select(
        (-1 - F.col("item_id")).alias("file_id"), F.concat(F.lit("tmp://"), F.col("item_id").cast("string")).alias("path"), F.lit(0).alias("pos"), F.lit("1-1").alias("location"),
        F.col("text").alias("content"), F.lit(True).alias("is_tmp"),
    )
    return _rows(search.search_regex(corpus(spark, sf_dir).union(Corpus.of(tmp)), "the .* and"))


@query("SELECT doc_id AS file_id, len(list_distinct(t)) AS n_distinct, len(t) AS n_total FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^ \\t\\n\\r]+') AS t FROM documents)")
def document_tokens(spark, sf_dir):
    words = tokens(F.col("text"))
    return files(spark, sf_dir).select("file_id", F.size(F.array_distinct(words)).alias("n_distinct"), F.size(words).alias("n_total"))
