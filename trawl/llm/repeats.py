"""Substring dedup with repeated-phrase automata.

A passage recurs where a window of ``window`` words (50) has been seen before, in the order of (doc_id, text,
position).  Every window that recurs is found:

1. Each window is represented by its least-hashed phrase of ``window // 2`` words.  Equal windows have the same
   one, so it is enough to count these phrases (about 7 in 100 words begin one) over all documents; a recurring
   phrase belongs to the first document that has it.
2. The surroundings of recurring phrases are cut from the texts, as word numbers, and sent to the shard of that
   first document.  There its phrases are compiled to an Aho-Corasick automaton, which is run over the excerpts
   of every document to locate each occurrence; the windows around a hit are compared with those seen before.

Excerpts arrive in order, first document first, so a shard is a stream: it holds an automaton and the windows of
one document's passages, however many documents share them.

Defined results: words are taken between ASCII white space, in lower case; a text of fewer than ``window``
words, null or empty has no passage; rows equal in doc_id and text are one document; rows without doc_id are not
searched and stay as they are; of equal passages in one document the first counts; text that repeats itself
recurs from its second period on; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm._store import broadcast_if_small, written
from trawl.llm._text import Words, encoded_chunks, input_parts, pack_sorted, release, text_chunks, unpack_sorted, window_hashes

OCCURRENCE = "doc_id long, text_hash long, start_word long, end_word long, first_doc_id long, first_start_word long"


def _sliding(f, a: np.ndarray, width: int) -> np.ndarray:
    """f over each run of ``width`` values, f being np.minimum or np.maximum."""
    done = 1
    out = a
    while done < width:
        step = min(done, width - done)
        out = f(out[: len(out) - step], out[step:])
        done += step
    return out


def phrase_starts(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the phrases that represent a window of some text."""
    k = window // 2
    if len(words.hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    phrase = window_hashes(words.hashes, k)
    width = window - k + 1
    least = _sliding(np.minimum, phrase, width)
    # a window must not cross into the next text
    end = np.repeat(words.bounds[1:], np.diff(words.bounds))
    ok = np.arange(len(least)) + window <= end[: len(least)]
    least = np.where(ok, least, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero((_sliding(np.maximum, padded, width) == phrase) & (phrase > 0))
    return at, phrase[at]


def _send_phrases(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """Blocks of (phrase, doc_id, text_hash, at), by range of the phrase's hash."""

    def run(batches):
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            phrases, rows, places = [], [], []
            for a, _, texts in encoded_chunks(batch.column(2)):
                words = Words(texts)
                at, phrase = phrase_starts(words, window)
                i = np.searchsorted(words.bounds, at, side="right") - 1
                phrases.append(phrase >> np.uint64(16))
                rows.append(a + i)
                places.append((at - words.bounds[i]).astype(np.int32))
            if not phrases:
                continue
            phrase, row, place = (np.concatenate(x) for x in (phrases, rows, places))
            order = np.argsort(phrase, kind="stable")
            phrase, row, place = phrase[order], row[order], place[order]
            edges = (np.arange(1, parts, dtype=np.uint64) << np.uint64(48)) // np.uint64(parts)
            cut = np.concatenate([[0], np.searchsorted(phrase, edges), [len(phrase)]])
            full = np.flatnonzero(np.diff(cut)).tolist()
            blocks = [[f(x[cut[p] : cut[p + 1]]) for p in full] for f, x in ((pack_sorted, phrase), (_raw, ids[row]), (_raw, hashes[row]), (_raw, place))]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(b, pa.binary()) for b in blocks)], ["part", "phrase", "doc_id", "text_hash", "at"])

    return docs.mapInArrow(run, "part int, phrase binary, doc_id binary, text_hash binary, at binary")


def _raw(a: np.ndarray) -> bytes:
    return a.tobytes()


def _recurring(table: pa.Table) -> pa.Table:
    """For each document, its phrases of one range that recur, and the first document of each."""

    def column(name: str, kind) -> np.ndarray:
        return np.concatenate([np.frombuffer(b.as_py(), kind) for b in table.column(name)])

    phrase = np.concatenate([unpack_sorted(b.as_py()) for b in table.column("phrase")])
    all_of = [phrase, column("doc_id", np.int64), column("text_hash", np.int64), column("at", np.int32)]
    order = np.lexsort(all_of[::-1])
    all_of = [x[order] for x in all_of]
    new = np.ones(len(phrase), bool)  # repeated rows count once
    new[1:] = np.any([x[1:] != x[:-1] for x in all_of], axis=0)
    phrase, doc, text, at = (x[new] for x in all_of)
    first = np.flatnonzero(np.concatenate([[True], phrase[1:] != phrase[:-1]])) if len(phrase) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(phrase)]]))
    again = np.repeat(size > 1, size)
    owner = np.repeat(first, size)[again]
    doc_owner, text_owner = doc[owner], text[owner]
    doc, text, at = doc[again], text[again], at[again]
    order = np.lexsort([at, text, doc])
    doc, text, at, doc_owner, text_owner = (x[order] for x in (doc, text, at, doc_owner, text_owner))
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (text[1:] != text[:-1])) + 1 if len(doc) else np.zeros(0, np.int64)
    cut = np.concatenate([[0], cut, [len(doc)]]) if len(doc) else np.zeros(1, np.int64)
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
    release()
    return pa.table(
        {
            "doc_id": pa.array(doc[cut[:-1]]),
            "text_hash": pa.array(text[cut[:-1]]),
            "owner_ids": pa.array([doc_owner[a:b].tobytes() for a, b in spans], pa.binary()),
            "owner_hashes": pa.array([text_owner[a:b].tobytes() for a, b in spans], pa.binary()),
            "at": pa.array([at[a:b].tobytes() for a, b in spans], pa.binary()),
        }
    )


def _by_owner(seeds: list[dict]) -> list[tuple[tuple[int, int], np.ndarray]]:
    """A document's recurring phrases, by the first document that has them, in order."""
    ids, hashes, at = (np.concatenate([np.frombuffer(s[k], kind) for s in seeds]) for k, kind in (("owner_ids", np.int64), ("owner_hashes", np.int64), ("at", np.int32)))
    order = np.lexsort([at, hashes, ids])
    ids, hashes, at = ids[order], hashes[order], at[order].astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])) + 1, [len(ids)]])
    return [((int(ids[a]), int(hashes[a])), at[a:b]) for a, b in zip(cut, cut[1:])]


class _Shard:
    """The passages of one first document."""

    def __init__(self, window: int):
        import ahocorasick

        self.window, self.k = window, window // 2
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.made = False
        self.seen: dict[int, int] = {}
        self.docs: list[tuple[int, int]] = []

    def compile(self, excerpts: list[tuple[int, np.ndarray, list[int]]]) -> None:
        for start, ids, phrases in excerpts:
            for p in phrases:
                self.automaton.add_word(tuple(ids[p - start : p - start + self.k].tolist()), 1)
        self.automaton.make_automaton()
        self.made = True

    def occurrences(self, doc: tuple[int, int], start: int, ids: np.ndarray) -> list[tuple]:
        n = len(ids) - self.window + 1
        if n < 1 or not len(self.automaton):
            return []
        around = np.zeros(n + 1, np.int64)
        back = self.window - self.k
        hits = np.array([e for e, _ in self.automaton.iter(tuple(ids.tolist()))], np.int64) - self.k + 1
        lo, hi = np.maximum(hits - back, 0), np.minimum(hits + 1, n)
        ok = lo < hi
        np.add.at(around, lo[ok], 1)
        np.add.at(around, hi[ok], -1)
        at = np.flatnonzero(np.cumsum(around[:-1]) > 0)
        if not len(at):
            return []
        if not self.docs or self.docs[-1] != doc:
            self.docs.append(doc)
        windows = window_hashes(ids.astype(np.uint64), self.window)[at]
        own = (len(self.docs) - 1 << 32) + at + start
        first = np.fromiter(map(self.seen.setdefault, windows.tolist(), own.tolist()), np.int64, len(at))
        again = np.flatnonzero(first != own)
        if not len(again):
            return []
        at, first = at[again], first[again]
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(first >> 32) != 0)) + 1
        out = []
        for a, b in zip([0, *cut], [*cut, len(at)]):
            d, p = self.docs[int(first[a]) >> 32], int(first[a]) & 0xFFFFFFFF
            out.append((*doc, start + int(at[a]), start + int(at[b - 1]) + self.window, d[0], p))
        return out


def occurrences(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, text_hash, start_word, end_word, first_doc_id, first_start_word) of each stretch of words that
    recurs, with the document that had it first and where its beginning was there; stretches of one document may
    overlap."""
    base = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    k = window // 2
    parts = input_parts(docs)
    seeds = _send_phrases(base, window, parts).groupBy("part").applyInArrow(_recurring, "doc_id long, text_hash long, owner_ids binary, owner_hashes binary, at binary")
    per_doc = written(seeds.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("owner_ids", "owner_hashes", "at")).alias("seeds")), "seeds")

    def cut(batches):
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3)]
            for a, _, texts in encoded_chunks(batch.column(2)):
                words = Words(texts)
                numbers = (words.hashes >> np.uint64(32)).astype(np.uint32)
                rows = []
                for i in range(len(texts)):
                    doc_id, text_hash, owners = (c[a + i] for c in columns)
                    first, n = int(words.bounds[i]), int(words.bounds[i + 1] - words.bounds[i])
                    for owner, at in _by_owner(owners):
                        lo, hi = np.maximum(at - (window - k), 0), np.minimum(at + window, n)
                        gap = np.flatnonzero(lo[1:] > hi[:-1]) + 1
                        for x, y in zip([0, *gap], [*gap, len(at)]):
                            own = owner == (doc_id, text_hash)
                            part = numbers[first + lo[x] : first + hi[y - 1]].tobytes()
                            rows.append((*owner, doc_id, text_hash, int(lo[x]), part, at[x:y].astype(np.int32).tobytes() if own else None))
                schema = pa.schema([(c, pa.int64()) for c in ("owner_id", "owner_hash", "doc_id", "text_hash", "start")] + [("words", pa.binary()), ("phrases", pa.binary())])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 7, schema)], schema=schema)

    # texts of documents without recurring phrases stay where they are
    ids = written(per_doc.select("doc_id", "text_hash"), "seeded")
    seeded = base.join(broadcast_if_small(ids), ["doc_id", "text_hash"], "left_semi")
    with_seeds = seeded.join(per_doc, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "seeds")
    excerpts = with_seeds.mapInArrow(cut, "owner_id long, owner_hash long, doc_id long, text_hash long, start long, words binary, phrases binary")
    excerpts = excerpts.repartition("owner_id", "owner_hash").sortWithinPartitions("owner_id", "owner_hash", "doc_id", "text_hash", "start")

    def locate(batches):
        owner, shard, waiting, last = None, None, [], None
        for batch in batches:
            out = []
            oi, oh, di, th, st = (batch.column(i).to_pylist() for i in range(5))
            parts, phrases = batch.column(5), batch.column(6)
            for i in range(batch.num_rows):
                if last == (last := (oi[i], oh[i], di[i], th[i], st[i])):
                    continue  # of a repeated row
                if (oi[i], oh[i]) != owner:
                    if waiting:
                        out += _first(shard, owner, waiting)
                    owner, shard, waiting = (oi[i], oh[i]), _Shard(window), []
                doc, ids = (di[i], th[i]), np.frombuffer(parts[i].as_py(), np.uint32)
                if doc == owner:
                    waiting.append((st[i], ids, np.frombuffer(phrases[i].as_py(), np.int32).tolist()))
                    continue
                if waiting:
                    out += _first(shard, owner, waiting)
                    waiting = []
                out += shard.occurrences(doc, st[i], ids)
            yield _table(out)
        if waiting:
            yield _table(_first(shard, owner, waiting))

    def _first(shard, owner, waiting):
        shard.compile(waiting)
        return [o for start, ids, _ in waiting for o in shard.occurrences(owner, start, ids)]

    def _table(rows):
        names = [f.split()[0] for f in OCCURRENCE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 6)], names)

    return excerpts.mapInArrow(locate, OCCURRENCE).distinct()


def remove(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` without the passages that occur earlier; what stands first stays.  Removed words go with the white
    space after them, n_chars (if there is such a column) is counted anew, and a document of which no word is left
    is dropped."""
    spans = occurrences(docs, window).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    spans = written(spans, "spans")
    names = docs.columns
    keyed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    ids = broadcast_if_small(written(spans.select("doc_id", "text_hash"), "marked"))
    # documents without such passages pass by
    others = keyed.join(ids, ["doc_id", "text_hash"], "left_anti").select(*[f"c{i}" for i in range(len(names))])
    marked = keyed.join(ids, ["doc_id", "text_hash"], "left_semi").join(spans, ["doc_id", "text_hash"])
    joined = marked.select(*[f"c{i}" for i in range(len(names))], "spans")
    text_at = names.index("text")

    def clean(batches):
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(text_at)):
                spans = batch.column(len(names)).slice(a, b - a).to_pylist()
                marked = [i for i, s in enumerate(spans) if s]
                words = Words([texts[i].encode() for i in marked])
                keep = np.ones(b - a, bool)
                for j, i in enumerate(marked):
                    n = int(words.bounds[j + 1] - words.bounds[j])
                    gone = np.zeros(n + 1, np.int64)
                    for s in spans[i]:
                        gone[s["start_word"]] += 1
                        gone[s["end_word"]] -= 1
                    gone = np.cumsum(gone[:-1]) > 0
                    if gone.all():
                        keep[i] = False
                        continue
                    origin = words.text_starts[j]
                    begin = words.starts[words.bounds[j] : words.bounds[j + 1]] - origin
                    following = np.concatenate([begin[1:], [words.text_starts[j + 1] - 1 - origin]])
                    raw = texts[i].encode()
                    edge = np.flatnonzero(np.diff(np.concatenate([[1], gone, [1]]))).reshape(-1, 2)  # runs that stay
                    texts[i] = (raw[: begin[0]] + b"".join(raw[begin[x] : following[y - 1]] for x, y in edge)).decode()
                columns = [c.slice(a, b - a) for c in batch.columns[: len(names)]]
                columns[text_at] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    counted = [len(t) if s and t is not None else old for t, s, old in zip(texts, spans, columns[names.index("n_chars")].to_pylist())]
                    columns[names.index("n_chars")] = pa.array(counted, columns[names.index("n_chars")].type)
                yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(names))]).filter(pa.array(keep))

    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    return joined.mapInArrow(clean, schema).unionByName(others).toDF(*names)
