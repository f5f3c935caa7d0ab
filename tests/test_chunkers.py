import pytest
from pyspark.sql import functions as F

from trawl.operators import chunkers as C


def places(name, text):
    chunks = C.named(name).chunks(text.encode())
    for c in chunks:
        assert text.encode()[c["byte_start"] : c["byte_end"]].decode() == c["content"]
    return [c["location"] for c in chunks]


def test_lines():
    assert places("line", "a\nb\n\nc") == ["1-1", "2-2", "3-3", "4-4"] and places("line", "") == []


@pytest.mark.parametrize("text,expected", [
    ("# Title\n\ntext\nmore\n\nnext\n", ["1-4", "6-6"]),
    ("# A\n# B\n# C\n", ["1-1", "2-2", "3-3"]),
    ("one\n\n\ntwo\n", ["1-1", "4-4"]),
    ("start\n```\ncode\n\nmore\n```\nend\n", ["1-7"]),
    ("````\na\n\n```\nb\n````\nc\n\nd", ["1-7", "9-9"]),
    ("~~~ info\na\n\nb", ["1-4"]),
    ("``` a`b\n\nx", ["1-1", "3-3"]),
    ("# H\n\n@tag\n\n@more\n\npara\n\nlast\n", ["1-7", "9-9"]),
    ("@tag\n\n# H\n\npara", ["1-1", "3-5"]),
    ("# H\nright after\n\nown\n", ["1-4"]),
    ("# H\n", ["1-1"]),
])
def test_markdown(text, expected):
    assert places("markdown", text) == expected


@pytest.mark.parametrize("name,text,expected", [
    ("bracket-go", "package p\n\n// about f\nfunc f() {\n\tx()\n}\n\nvar a = 1\n", ["1-1", "3-6", "8-8"]),
    ("bracket-go", "func f(\n\ta int,\n) {\n\tg()\n}\n", ["1-5"]),
    ("bracket-go", 'var s = "{"\nvar t = "}"\n', ["1-2"]),
    ("bracket-go", "x := `{\n`\ny\n", ["1-3"]),
    ("bracket-c", "/* { */\nint a;\n", ["1-2"]),
    ("bracket-js", "f(`a ${ {\n b }\n } c`)\n", ["1-3"]),
    ("bracket-shell", "if a; then\n b\nfi\necho notif\n", ["1-3", "4-4"]),
    ("bracket-pascal", "begin\n x\nend;\nbeginner\n", ["1-3", "4-4"]),
    ("bracket-lisp", "(a\n (b))\n\n; note\nc\n", ["1-2", "4-5"]),
    ("bracket-nginx", "server {\n a;\n}\n", ["1-3"]),
    ("bracket-go", "}\nfunc f() {\n}\n", ["1-3"]),
    # a blank line on which no token ends closes a group
    ("bracket-go", "{\n a\n\n b\n}\n", ["1-3", "4-5"]),
])
def test_brackets(name, text, expected):
    assert places(name, text) == expected


@pytest.mark.parametrize("name,text,expected", [
    ("indent-shell", "a:\n  b\n  c:\n    d\ne\n", ["1-4", "5-5"]),
    ("indent-shell", "# about\na:\n  b\n\nx\ny\n", ["1-3", "5-6"]),
    ("indent-c", "f\n  /* long\nnote\n  */\n  g\nh\n", ["1-5", "6-6"]),
    ("indent-shell-4", "a\n\tb\n    c\nd\n", ["1-3", "4-4"]),
    ("indent-shell", "k: 1\n\nj: 2\n\ni: 3\n", ["1-1", "3-3", "5-5"]),
    ("indent-shell", "", []),
])
def test_indents(name, text, expected):
    assert places(name, text) == expected


def test_every_line_is_in_at_most_one_chunk():
    text = "x {\n\n y (\n z\n)\n}\n\n# c\n\tq\n" * 5
    for name in ("markdown", "bracket-c", "bracket-js", "indent-c-4", "indent-shell"):
        ends = [(c["byte_start"], c["byte_end"]) for c in C.named(name).chunks(text.encode())]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_languages_and_names():
    assert set(C.LANGUAGES) == {"go", "c", "cpp", "java", "js", "lisp", "nginx", "pascal", "shell", "bash"}
    assert C.language("GO") is C.LANGUAGES["go"] and C.named("bracket-lisp").comment_syntax == ";" and C.named("bracket-pascal").comment_syntax == ""
    for bad in ("nothing", "bracket-cobol", "indent-"):
        with pytest.raises(ValueError):
            C.named(bad)


def test_resume():
    line = C.named("line")
    replaced, new = C.resumed(line, b"a\nbc\nd\n", (2, 3))
    assert replaced and [(c["location"], c["byte_start"], c["byte_end"]) for c in new] == [("2-2", 2, 5), ("3-3", 5, 7)]
    replaced, new = C.resumed(line, b"a\nb\nc\n", (2, 4))
    assert not replaced and [c["location"] for c in new] == ["3-3"]
    assert C.resumed(line, b"x\n", None)[1][0]["location"] == "1-1"
    with pytest.raises(ValueError):
        C.resumed(line, b"x", (3, 9))


def test_command(tmp_path):
    f = tmp_path / "f"
    f.write_text("one\ntwo\n")
    assert C.run_command("awk '{print NR\"\\t\"$0}'", str(f)) == [("1", "one"), ("2", "two")]
    with pytest.raises(ValueError):
        C.run_command("cat", str(f))


def test_spark_forms_agree(spark):
    texts = ["a\nb\n\nc", "", "one", "x\n" * 25, "w1 w2\tw3\n" * 9 + "é  end \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").union(spark.createDataFrame([(9, None)], "i int, text string"))
    jvm = C.chunked_lines(df).orderBy("i", "pos").collect()
    plain = C.chunked(df, "line").orderBy("i", "pos").collect()
    assert [tuple(r) for r in jvm] == [(r.i, r.pos, r.location, r.content) for r in plain]
    windows = C.word_window_rows(df, 5, 2).orderBy("i", "pos").collect()
    chunker = C.Chunker(C.word_windows(5, 2))
    expected = [(i, n, c["location"], c["content"].replace("\n", "\\n")) for i, t in enumerate(texts) for n, c in enumerate(chunker.chunks(t.encode()))]
    assert [tuple(r) for r in windows] == expected
    lines = C.line_windows(df, 10, 4).where("i = 3").orderBy("pos").collect()
    assert [r.location for r in lines] == ["1-10", "7-16", "13-22", "19-25", "25-25"]
    assert C.line_windows(df, 10, 4).where("i = 1").collect()[0][1:] == (0, "1-1", "")
    picked = df.select("i", C.line_range(F.col("text"), F.lit("2-3")).alias("c")).where("i in (0, 2)").orderBy("i").collect()
    assert [r.c for r in picked] == ["b\n\n", None]
    assert [c["location"] for c in C.Chunker(C.byte_blocks(4)).chunks(b"123456789")] == ["b0", "b1", "b2"]
