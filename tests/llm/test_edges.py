"""Nulls in any column, empty and very long texts, repeated rows, empty tables and clashing column names."""

import pytest

from trawl.llm import bpe, caps, chat, jaccard, kneser_ney, licences, packing, pitman_yor, repeats, topk

#: Names that operators use for columns of their own.
CLASHING = ["entity", "group", "part", "keep", "threshold", "n_words", "perplexity", "key", "bucket", "text_hash", "spans", "seeds", "c0", "g", "first", "count", "node", "dim", "filter", "version", "chunk", "rank"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
LONG = " ".join(f"w{i}" for i in range(60_000))
ALIKE = "the river runs past the old mill and under the stone bridge to the sea every single day"


def _row(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), *["x"] * len(CLASHING))


ROWS = [
    _row(1, ALIKE), _row(2, ALIKE), _row(2, ALIKE), _row(2, "another text under one id that two rows have"), _row(3, ALIKE + " again"), _row(4, ""), _row(5, None), _row(None, ALIKE),
    _row(None, None, None), _row(6, LONG), _row(7, " \n\t "), _row(8, "one"), _row(9, "éàü ß 漢字 😀 \x00 end"), _row(10, ALIKE, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (3, 1, None), (3, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_classifier(docs, labels):
    rows = kneser_ney.score(docs, labels, min_docs=1).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if not (r.text or "").split():
            assert r.perplexity is None and not r.keep and r.n_words == 0
        else:
            assert r.perplexity > 0 and r.n_words == len(r.text.encode().split())
    kept = kneser_ney.kept(docs, labels, min_docs=1)
    assert kept.columns == docs.columns and all(r.keep == "x" for r in kept.collect())
    assert kneser_ney.score(docs, labels.where("false")).where("keep").count() == sum(bool((r[1] or "").split()) for r in ROWS)


def test_jaccard(docs):
    found = sorted((r.doc_id, r.class_id, r.links) for r in jaccard.classes(docs).collect())
    # the other text of 2 is a document of its own
    assert found == [(1, 1, 3), (2, 1, 3), (2, 2, 0), (3, 1, 3), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0), (10, 1, 3)]
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    # of the group 1, 2, 2, 3, 10 the first stays; so does the other text of 2, and all without doc_id or words
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        (r[0] or 0, r[1] or "") for r in ROWS if not (r[0] in (2, 3, 10) and (r[1] or "").startswith(ALIKE))
    )


def test_jaccard_repeated_rows(spark):
    df = spark.createDataFrame([_row(1, ALIKE), _row(1, ALIKE)], COLUMNS)
    assert jaccard.deduplicate(df).count() == 1 and [tuple(r) for r in jaccard.classes(df).collect()] == [(1, 1, 0)]


def test_repeats(docs):
    found = repeats.occurrences(docs, window=10).collect()
    assert {r.doc_id for r in found} == {2, 3, 10} and all(r.first_doc_id == 1 for r in found)
    out = repeats.remove(docs, window=10)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    texts = {(r.doc_id, r.text) for r in out.collect()}
    # document 3 is left with the word that is new, copies are gone, the rest is as it was
    assert (3, "again") in texts and (1, ALIKE) in texts and (None, ALIKE) in texts and (6, LONG) in texts and (4, "") in texts and (5, None) in texts
    assert not {i for i, t in texts if t == ALIKE} & {2, 10}


def test_packing(docs):
    packs = packing.pack(docs, capacity=100).collect()
    packed = {}
    for p in packs:
        for d, n in zip(p.doc_ids, p.lengths):
            packed[d] = packed.get(d, 0) + n
    assert packed[6] == 60_000 and packed[2] == 18 * 2 + 9 and 4 not in packed and 5 not in packed and packed[None] == 18
    assert all(p.n_words == 100 for p in sorted(packs)[:-1])


def test_bpe(docs):
    rows = bpe.encode(docs, check=True).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r.token_ids is None) == (r.doc_id == 5 or (r.doc_id is None and r.token_ids is None))
        assert r.round_trip is None if r.token_ids is None else r.round_trip and r.n_tokens == len(r.token_ids)
    assert next(r for r in rows if r.doc_id == 4).token_ids == []


def test_licences(docs, spark):
    assert licences.scan(docs).count() == 0
    text = "x " * 20_000 + "Released under the MIT License. " + LONG
    df = spark.createDataFrame([_row(1, text), _row(1, text), _row(None, text)], COLUMNS)
    rows = licences.scan(df).collect()
    assert [(r.licence, r.start_token, r.coverage) for r in rows] == [("mit-notice", 20_000, 1.0)] * 3
    assert licences.scan(df, templates={}).count() == 0


def test_pitman_yor(docs):
    rows = pitman_yor.score(docs, burn_in=2, samples=2).collect()
    assert len(rows) == len(ROWS)
    assert all((r.perplexity is None) == (r.n_words == 0) for r in rows) and max(r.n_words for r in rows) == 60_000
    assert len({r.perplexity for r in rows if r.doc_id in (1, 10)}) == 1


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, key string, ids string, n_turns int"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, None, "x"), (None, None, None, None), (2, 0, "assistant", LONG), (2, 0, "assistant", LONG), (3, 0, "user", "")]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame([(*r, "k", "i", 9) for r in rows], schema)).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {1: 3, None: 1, 2: 2, 3: 1}
    assert sum(out[3].loss_mask) == sum(out[None].loss_mask) == 0 and sum(out[1].loss_mask) == 1
    assert sum(out[2].loss_mask) > 60_000 and all(len(r.token_ids) == len(r.loss_mask) == r.n_tokens for r in out.values())


VECTORS = "vec_id long, embedding array<float>, label int, dim string, filter string, q string, version string, chunk string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "d", "f", "q", "v", "c") for i, v in rows], VECTORS)


def test_caps(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, nan, 0.0]), (4, [0.0, 0.0, 0.0]), (5, None), (6, [1.0, None, 0.0]),
            (7, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (8, []), (9, [1e30, 0.0, 0.0]), (10, [float("inf"), 0.0, 0.0])]
    df = _vectors(spark, rows)
    found = {(r.vec_a, r.vec_b): r.cosine for r in caps.near_pairs(df).collect()}
    assert found == {(1, 2): 1.0, (1, 9): 1.0, (2, 9): 1.0}
    kept = caps.deduplicate(df)
    # the other vector of 2 is none of its class
    assert kept.columns == df.columns and sorted(r.vec_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10]
    found = sorted((r.vec_id, r.class_id, r.links) for r in caps.classes(df).collect())
    assert found == [(1, 1, 2), (2, 1, 2), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0), (9, 1, 2), (10, 10, 0)]


def test_topk(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [5.0, 0.0]), (4, [nan, 0.0]), (5, None), (None, [0.0, 0.0]), (6, [0.0]), (7, [1.0, None]), (8, [])]
    out = sorted((r.query_id, r.query_row, r.rank, r.neighbour_id, r.distance) for r in topk.neighbours(_vectors(spark, rows), k=2).collect())
    assert [r for r in out if r[0] < 3] == [(1, 0, 1, 2, 1.0), (1, 0, 2, 3, 1.0), (2, 0, 1, 3, 0.0), (2, 0, 2, 1, 1.0)]
    # both vectors of 3 are queries; neither is a neighbour of the other
    assert sorted(r[2:] for r in out if r[0] == 3) == [(1, 2, 0.0), (1, 2, 4.0), (2, 1, 1.0), (2, 1, 5.0)]


def test_empty_tables(docs, labels, spark):
    none = docs.where("false")
    assert kneser_ney.score(none, labels).count() == 0
    assert jaccard.classes(none).count() == 0 and jaccard.deduplicate(none).count() == 0
    assert repeats.occurrences(none).count() == 0 and repeats.remove(none).count() == 0
    assert packing.pack(none).count() == 0 and bpe.encode(none).count() == 0 and licences.scan(none).count() == 0
    assert pitman_yor.score(none).count() == 0
    vectors = _vectors(spark, [(1, [1.0])]).where("false")
    assert caps.near_pairs(vectors).count() == 0 and caps.classes(vectors).count() == 0 and topk.neighbours(vectors).count() == 0 and caps.deduplicate(vectors).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
