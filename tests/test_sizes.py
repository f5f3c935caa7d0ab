"""What is stored and shuffled stays small for each posting, chunk and token."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl.database import Database
from trawl.functions.text import Encoding, token_counts, trigram_blocks, trigram_set
from trawl.operators import chunkers
from trawl.operators.corpus import Corpus


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    return [" ".join(rng.choice(words, 30)) + "\n" for _ in range(5000)]


def test_stored_postings_are_blocks(spark, tmp_path, lines):
    db = Database.create(spark, f"file://{tmp_path}/db")
    db.add(spark.createDataFrame([(f"f{i}", "".join(lines[i::50])) for i in range(50)], "path string, content string"))
    stored = sum(p.stat().st_size for p in (tmp_path / "db" / "postings").rglob("*.parquet"))
    n = db.postings.count()
    assert n == Corpus.of(db.corpus().occurrences).make_postings().count() and stored < 8 * n
    other = db.fork(f"file://{tmp_path}/other")
    other.remove("f1")
    other.append("f2", "w1 w2 zzzz\n")
    other.compact()
    for d in (db, other):
        made = Corpus.of(d.corpus().occurrences).make_postings()
        both = d.postings.select("trigram", "chunk_id", "tf").exceptAll(made), made.exceptAll(d.postings)
        assert all(x.isEmpty() for x in both)


def test_blocks_of_long_texts():
    texts = ["ab" * 3_000_000, "abc", "", "xabc"]
    batches = [pa.RecordBatch.from_arrays([pa.array([i + 4095 for i in range(4)]), pa.array(texts)], ["chunk_no", "encoded"])]
    rows = [r for b in trigram_blocks(batches) for r in b.to_pylist()]
    found = {(r["trigram"], r["part"] << 12 | p): t for r in rows for p, t in zip(r["places"], r["tfs"])}
    assert found == {(t, i + 4095): n for i, x in enumerate(texts) for t, n in Encoding().trigram_counts(x).items()}


def test_tokens_are_counted_in_place(spark):
    df = spark.createDataFrame([(1, "a B b\tΣ a"), (2, ""), (3, None)], "i int, c string").select("i", F.inline(token_counts(F.col("c"))))
    assert sorted(map(tuple, df.collect())) == [(1, "a", 2), (1, "b", 2), (1, "σ", 1)]
    c = Corpus.of(spark.createDataFrame([(1, 0, "1-1", "a b a\n")], "file_id long, pos int, location string, content string"))
    # one shuffle, of distinct contents
    assert plan(c.token_postings()).count("Exchange hashpartitioning") == 1


def test_bitmaps_are_of_distinct_trigrams(spark):
    c = Corpus.of(spark.createDataFrame([(1, 0, "1-1", "abc abd\n"), (1, 1, "2-2", "abc\n")], "file_id long, pos int, location string, content string"))
    text = plan(c.trigram_bitmaps())
    assert "chunk_id" not in text and "keys=[trigram" in text
    assert c.trigram_bitmaps().select(F.bitmap_count("bitmap").alias("n")).agg(F.sum("n")).first()[0] == 6


def test_trigrams_of_lists(spark):
    df = spark.createDataFrame([(["abcd", "abc"],), ([],), (None,), (["é", "aéb"],)], "c array<string>").select(trigram_set(F.col("c")).alias("t"))
    assert [(sorted(r.t.trigrams), r.t.n) for r in df.collect()] == [
        (sorted({*Encoding().trigrams("abcd")}), 3), ([], 0), ([], 0), (sorted(Encoding().trigrams("aéb")), 2),
    ]


def test_chunks_are_not_objects_all_at_once(monkeypatch):
    most = []

    def cut(data):
        yield "all", 0, len(data)

    original = chunkers.slices
    monkeypatch.setattr(chunkers, "slices", lambda sizes: (most.append(int(sizes[a:b].sum())) or (a, b) for a, b in original(sizes)))
    texts = pa.array(["x" * 100_000] * 100 + [None, "", "end"])
    found = chunkers._chunk_lists(texts, chunkers.Chunker(cut))
    assert max(most) <= 1 << 20 and [len(x) for x in found.to_pylist()] == [1] * 100 + [0, 0, 1]
    assert found[102].as_py() == [{"location": "all", "byte_start": 0, "byte_end": 3, "content": "end", "attrs": []}]


def test_postings_that_are_not_stored_are_of_the_query(spark):
    c = Corpus.of(spark.createDataFrame([(1, 0, "1-1", "abc abd abc\n"), (1, 1, "2-2", "xyz\n")], "file_id long, pos int, location string, content string")).with_postings()
    asked = Encoding().trigrams("abc")
    assert [(r.trigram, r.tf) for r in c.postings_of(asked).collect()] == [(asked[0], 2)]
    assert "ArrowEvalPython" not in plan(c.postings_of(asked))
