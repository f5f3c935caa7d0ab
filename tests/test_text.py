from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.functions.patterns import ANY, PatternError, needed_trigrams, to_java


def grams(*texts):
    return [int.from_bytes(t.encode(), "big") for t in texts]


def test_trigrams():
    e = T.Encoding()
    assert e.trigrams("abcd") == grams("abc", "bcd") and e.trigrams("ab") == []
    assert e.trigrams("  a \t\n b") == grams("a\0b")
    assert e.trigrams("ab \n") == grams("ab\0")
    assert e.trigrams("aaaa") == grams("aaa") * 2
    assert T.Encoding(case_insensitive=True).trigrams("ABC") == grams("abc")
    assert T.Encoding(aliases={"-": " "}).trigrams("a-b") == grams("a\0b")
    # a window within one character is left out
    assert e.trigrams("漢") == [] and len(e.trigrams("漢字")) == 2 and e.trigrams("😀") == [] and len(e.trigrams("éa")) == 1
    with pytest.raises(ValueError):
        T.Encoding(aliases={"é": "e"})


def test_trigram_of_three_bytes():
    e = T.Encoding(case_insensitive=True)
    assert e.trigram_of(b"A b") == grams("a\0b")[0] and e.trigram_of(b"a  ") is None and e.trigram_of("漢".encode()) is None and e.trigram_of(b"ab") is None
    assert T.trigram_text(grams("a\0b")[0]) == "a b"


@pytest.mark.parametrize("query,terms", [
    ("one two", ["one", "two"]), ('"one two" three', ["one two", "three"]), ('a "b c" d', ["a", "b c", "d"]), ('"only"', ["only"]), ("  padded  ", ["padded"]), ("", []),
    ('open "quote', ["open", '"quote']), ('""', [""]), ('"a"b', ["a", "b"]), ('x"y z"', ['x"y', 'z"']),
])
def test_terms(query, terms):
    assert T.parse_terms(query) == terms


def test_token_hash():
    assert T.fnv1a("") == 0x811C9DC5 and T.fnv1a("a") == 0xE40C292C and T.fnv1a("foobar") == 0xBF9CF968


def test_columns_agree_with_python(spark):
    texts = ["abc abd  x", "ÀÉÎ où ça\nva", "漢字 kanji 😀😀", "", "aaaa\r\n\tbbb", " lead", "a-b-C ΑΣ İx", "ab"]
    for e in (T.Encoding(), T.Encoding(True, {"-": " "})):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        rows = df.select("i", "t", T.trigram_bag(e.column(F.col("t"))).alias("bag"), e.byte_string(F.col("t")).alias("b"), T.tokens(F.col("t")).alias("w"), T.fnv1a_column(F.col("t")).alias("h")).collect()
        for r in rows:
            assert {x.trigram: x.tf for x in r.bag} == e.trigram_counts(r.t)
            assert r.b.encode("latin-1") == e.encode(r.t)
            assert Counter(r.w) == T.token_bag(r.t) and r.h == T.fnv1a(r.t)


@pytest.mark.parametrize("pattern,java", [("a.b", "(?d)a.b"), ("x$", r"(?d)x\z"), (r"\s", r"(?d)[\t\n\f\r ]"), (r"[\s\d]", r"(?d)[\t\n\f\r 0-9]"), ("[[:alpha:]]", r"(?d)[\p{Alpha}]"), ("(?P<n>a)", "(?d)(a)"), ("(?i)a", "(?d)(?i)a"), (r"\x{41}", r"(?d)\x{41}"), (r"\Q(a\E+", r"(?d)\x28a+"), ("a{,2}", r"(?d)a\{,2}"), ("(?m:^a)$", r"(?d)(?m:^a)\z"), ("((?m)a$)$", r"(?d)((?m)a$)\z"), ("a{2,}", "(?d)a{2,}")])
def test_patterns(pattern, java):
    assert to_java(pattern) == java


@pytest.mark.parametrize("pattern", ["(", "a**", "(?=a)", r"(a)\1", "(?U)a", "a++", "a{1001}", "[a", "\\", "(?<!a)b"])
def test_bad_patterns(pattern):
    with pytest.raises(PatternError):
        to_java(pattern)


def test_needed_trigrams():
    e = T.Encoding()
    assert needed_trigrams("hello", e).trigrams == set(e.trigrams("hello"))
    assert needed_trigrams("a.*b", e) == ANY == needed_trigrams("(hello)?", e) == needed_trigrams("(?i)hello", e) == needed_trigrams("abc|x", e)
    either = needed_trigrams("abc|xyz", e)
    assert not either.all and {frozenset(p.trigrams) for p in either.parts} == {frozenset(grams("abc")), frozenset(grams("xyz"))}
    assert needed_trigrams("(abc)+ def", e).trigrams == set(grams("abc", "def"))


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_trigrams_lie_across_characters(text):
    e = T.Encoding()
    data = e.encode(text)
    starts = [i for i, b in enumerate(data) if b & 0xC0 != 0x80] + [len(data)]
    expected = [int.from_bytes(data[i : i + 3], "big") for i in range(len(data) - 2) if not any(a <= i and i + 3 <= b for a, b in zip(starts, starts[1:]))]
    assert e.trigrams(text) == expected


def test_direct_conditions_equal_those_on_bytes(spark):
    from trawl.operators.corpus import count_trigrams, has_trigrams

    texts = ["", " ab", "ab ", "a b", "  a  b  ab", "ab\n\tcd ab", "\0ab\0 ab", "aaaa", "a a a a", "x ab", "x  ab ab ab", "é ab", "ab\0", "a\0\0b"]
    asked = [int.from_bytes(t, "big") for t in (b"ab\0", b"\0ab", b"a\0b", b"aaa", b"\0a\0", b"b\0a", b"\0\0b", b"a\0\0")]
    encoding = T.Encoding()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    has = has_trigrams(encoding, F.col("content"), asked)
    rows = df.select("content", F.array(*has).alias("has"), count_trigrams(encoding, F.col("content"), asked[:6]).alias("n")).collect()
    for r in rows:
        data = encoding.encode(r.content)
        windows = [data[i : i + 3] for i in range(len(data) - 2)]
        expected = [windows.count(t.to_bytes(3, "big")) for t in asked]
        assert list(r.has) == [n > 0 for n in expected], r.content
        assert list(r.n) == expected[:6], r.content
