import pytest
from pyspark.sql import functions as F

from trawl.operators import search as S
from trawl.operators.corpus import Corpus
from trawl.plans.options import Options, keep_all, keep_rare, keep_rarest

FILES = {
    "a": ["alpha beta gamma\n", "beta delta\n", "nothing here\n", "beta delta\n"],
    "b": ["alpha x x x x x x x x x x beta\n", "beta delta\n"],
    "c": ["ALPHA Beta\n", "betalphabet\n", "line with 2024 in it\r\n"],
}


@pytest.fixture(scope="module", params=["scan", "index"])
def corpus(request, spark):
    rows = [(i, p, n, f"{n + 1}-{n + 1}", c, [("timestamp", str(1000 * i))] if p == "b" else [], 10 * i, False) for i, (p, cs) in enumerate(FILES.items(), 1) for n, c in enumerate(cs)]
    schema = "file_id long, path string, pos int, location string, content string, attrs array<struct<key:string,value:string>>, mod_time_ns long, is_tmp boolean"
    c = Corpus.of(spark.createDataFrame(rows, schema))
    return c.with_postings() if request.param == "index" else c


def got(df):
    return [(r.path, r.location) for r in df.collect()]


def test_all_terms(corpus):
    assert got(S.search(corpus, "alpha beta")) == [("a", "1-1"), ("b", "1-1"), ("c", "2-2")]
    assert got(S.search(corpus, "alpha be")) == got(S.search(corpus, "alpha"))  # a short term asks nothing
    assert got(S.search(corpus, "")) == got(S.search(corpus, "al be")) == got(S.search(corpus, "zzzz")) == []


def test_one_result_for_a_chunk_in_a_file(corpus):
    assert got(S.search(corpus, '"beta delta"')) == [("a", "2-2"), ("b", "2-2")]


def test_loose_and_scores(corpus):
    rows = S.search(corpus, "alpha delta zz", Options(loose=True)).collect()
    assert {(r.path, r.location): round(r.score, 3) for r in rows} == {k: round(1 / 3, 3) for k in [("a", "1-1"), ("a", "2-2"), ("b", "1-1"), ("b", "2-2"), ("c", "2-2")]}
    overlap = S.search(corpus, "beta", Options(scoring="overlap")).collect()
    assert {r.score for r in overlap} == {2.0}
    density = {(r.path, r.location): r.score for r in S.search(corpus, "beta", Options(scoring="density")).collect()}
    assert density["a", "2-2"] == 1.0 and density["c", "2-2"] == 3.0 and density["b", "1-1"] == pytest.approx(2 / 3)
    own = S.search(corpus, "beta", Options(scoring=lambda tf, n: tf[0] * 10)).collect()
    assert {r.score for r in own} == {10.0, 20.0}
    with pytest.raises(ValueError):
        S.search(corpus, "beta", Options(scoring="odd"))


def test_bm25(corpus):
    import math

    rows = {(r.path, r.location): r.score for r in S.search(corpus, "alpha", Options(scoring="bm25")).collect()}
    n, df = 7, 3
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    mean = (3 + 2 + 2 + 12 + 2 + 1 + 5) / 7
    assert rows["a", "1-1"] == pytest.approx(3 * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / mean)))
    assert rows["b", "1-1"] == pytest.approx(3 * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / mean)))  # three distinct tokens


def test_choice_of_trigrams(corpus):
    assert got(S.search(corpus, "alpha beta", Options(trigram_filter=keep_all))) == got(S.search(corpus, "alpha beta"))
    assert got(S.search(corpus, "alpha delta", Options(trigram_filter=keep_rare(0.0)))) == []
    assert set(got(S.search(corpus, "alpha delta", Options(trigram_filter=keep_rarest(1))))) == {("a", "2-2"), ("b", "2-2")}
    assert keep_rare(0.1)([(1, 5)], 1) == [(1, 5)] and keep_rare(0.5)([(1, 2), (2, 3)], 5) == [(1, 2)]


def test_filters(corpus):
    assert got(S.search(corpus, "Beta", Options(verify=True))) == [("c", "1-1")]
    assert got(S.search(corpus, "beta", Options(regex=("^alp", "x")))) == [("b", "1-1")]
    assert got(S.search(corpus, "beta", Options(except_regex=("delta", "^alpha")))) == [("c", "2-2")]
    assert {p for p, _ in got(S.search(corpus, "beta", Options(only=(frozenset({1, 2}), frozenset({2, 3})))))} == {"b"}
    assert got(S.search(corpus, "beta", Options(only=(frozenset({1}), frozenset({2}))))) == []
    assert {p for p, _ in got(S.search(corpus, "beta", Options(except_files=frozenset({1, 2}))))} == {"c"}
    # times: 10 and 30 by file, 2000 by attribute; a shared chunk has the time of its first file
    assert got(S.search(corpus, "beta", Options(after=2000))) == [("b", "1-1")]
    assert got(S.search(corpus, "beta", Options(before=30))) == [("a", "1-1"), ("a", "2-2"), ("b", "2-2")]
    assert got(S.search(corpus, "beta", Options(chunk_filters=(lambda content, attrs, n: n == 2,)))) == [("a", "2-2"), ("b", "2-2")]


def test_regex(corpus):
    assert got(S.search_regex(corpus, "be.a$")) == [] and got(S.search_regex(corpus, "delta\n$")) == [("a", "2-2"), ("b", "2-2")]
    assert got(S.search_regex(corpus, r"\d{4} in it.\n")) == [("c", "3-3")]  # . matches a carriage return
    assert len(got(S.search_regex(corpus, ".*"))) == 8 and got(S.search_regex(corpus, "gamma|2024")) == [("a", "1-1"), ("c", "3-3")]
    with pytest.raises(ValueError):
        S.search_regex(corpus, "(")
    with pytest.raises(ValueError):
        S.search(corpus, "beta", Options(regex=("[",)))


def test_fuzzy(corpus):
    rows = S.search_fuzzy(corpus, "alpho bet gamma", 2).collect()
    assert (rows[0].path, rows[0].location) == ("a", "1-1") and len(rows) == 2 and rows[0].score > rows[1].score
    assert got(S.search_fuzzy(corpus, "zz")) == []


def test_multi(corpus):
    rows = S.search_multi(corpus, "beta", {"z": "coverage", "d": "density"}, 2).collect()
    assert [(r.strategy, r.path, r.location) for r in rows] == [("d", "c", "2-2"), ("d", "a", "2-2"), ("z", "a", "1-1"), ("z", "a", "2-2")]
    rows = S.search_multi(corpus, "beta", {"z": "coverage"}, 3, Options(except_regex=("delta",))).collect()
    assert [(r.path, r.location) for r in rows] == [("a", "1-1"), ("b", "1-1")]


def test_proximity(corpus):
    rows = S.search(corpus, "alpha beta", Options(proximity=10)).collect()
    assert [(r.path, round(r.score, 4)) for r in rows] == [("a", 1.5), ("b", round(1 + 1 / 12, 4)), ("c", 1.0)]
    assert [r.score for r in S.search(corpus, "alpha beta", Options(proximity=1)).collect()] == [1.5, 1.0, 1.0]
    assert [r.score for r in S.search(corpus, "alpha", Options(proximity=9)).collect()] == [1.0, 1.0, 1.0]


def test_file_scores_and_neighbours(corpus):
    rows = S.score_file(corpus, "delta zeta", "a").collect()
    assert [(r.location, round(r.score, 2)) for r in rows] == [("1-1", 0.2), ("2-2", 0.8), ("3-3", 0.0), ("4-4", 0.8)]
    with pytest.raises(KeyError):
        S.score_file(corpus, "delta", "none")
    assert [r.location for r in S.get_chunks(corpus, "a", "2-2", 5, 1).collect()] == ["1-1", "2-2", "3-3"]
    for path, place in (("a", "9-9"), ("none", "1-1")):
        with pytest.raises(KeyError):
            S.get_chunks(corpus, path, place)
    many = S.neighbours(corpus, corpus.occurrences.where("location = '2-2'").select("path", "location"), 1, 0)
    assert sorted((r.path, r.location) for r in many.collect()) == [(p, x) for p in "abc" for x in ("1-1", "2-2")]


def test_statistics(corpus):
    assert tuple(corpus.stats().first()) == (7, 27)
    # del, elt and lta are in one distinct chunk; a trigram that is nowhere has 0
    assert [r.df for r in S.query_frequencies(corpus, "delta").collect()] == [1, 1, 1]
    assert [r.df for r in S.query_frequencies(corpus, "qqqq").collect()] == [0]
    assert corpus.references().agg(F.max("refs")).first()[0] == 2
    assert corpus.chunks.count() == 7
