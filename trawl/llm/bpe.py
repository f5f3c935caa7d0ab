"""Byte-level BPE through a sentencepiece model that is written straight from the vocabulary.

The vocabulary file lists byte strings by rank.  Each becomes a sentencepiece piece, its bytes mapped to
printable characters, with minus its rank as score, under an identity normaliser; merging by best score is then
merging by lowest rank.  A text is cut into pre-tokens, each distinct pre-token of a task is encoded once, and
the ids of a text are gathered in numpy.  Decoding maps ids to bytes and needs no model.

Defined results: a null text has null ids and an empty text none; a text of any length is encoded whole; repeated
rows get equal ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm._text import ragged_take, text_chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HELD_WORDS = 300_000  #: distinct pre-tokens that a task remembers; beyond that it starts afresh


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Byte strings by rank, of a file with a base64 string and a rank a line."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"the ranks of {path} are not 0..{len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


def byte_characters() -> str:
    """One printable character for each byte value."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(extra)) for b in range(256))


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(payload)) if kind == 2 else b"") + payload


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def model_bytes(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece model: ids are ranks, and one more for the unknown piece."""
    table = byte_characters()
    out = []
    for rank, token in enumerate(vocabulary):
        piece = "".join(table[b] for b in token).encode()
        out.append(_field(1, 2, _field(1, 2, piece) + _field(2, 5, struct.pack("<f", -float(rank))) + _field(3, 0, _varint(1))))
    out.append(_field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", -1e9)) + _field(3, 0, _varint(2))))
    unknown = len(vocabulary)
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(unknown + 1)) + _field(40, 0, _varint(unknown))
    trainer += b"".join(_field(n, 0, _varint(-1)) for n in (41, 42, 43))
    normalizer = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return b"".join(out) + _field(2, 2, trainer) + _field(3, 2, normalizer)


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes lists of texts; one per task."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor()
        self.processor.LoadFromSerializedProto(model)
        self.findall = regex.compile(PRE_TOKENS).findall
        self.table = dict(enumerate(byte_characters()))
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.values: np.ndarray = np.zeros(0, np.int32)
        self.offsets: np.ndarray = np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        if len(self.numbers) > HELD_WORDS:
            self.forget()
        codes: list[int] = []
        counts = [0]
        number = self.numbers.__getitem__
        for text in texts:
            codes += map(number, self.findall(text))
            counts.append(len(codes))
        new = self.numbers.new
        if new:
            ids = self.processor.encode([w.encode().decode("latin-1").translate(self.table) for w in new], num_threads=1)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum()))
            self.values = np.concatenate([self.values, flat])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
            self.numbers.new = []
        values, at = ragged_take(self.values, self.offsets, np.array(codes, np.int64))
        return values, at[counts]


@cache
def _piece_table(vocabulary: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(vocabulary), np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in vocabulary])])


def decode(vocabulary: tuple[bytes, ...], values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Bytes of each row of ids."""
    data, ends = ragged_take(*_piece_table(vocabulary), values)
    raw, cut = data.tobytes(), ends[offsets]
    return [raw[a:b] for a, b in zip(cut, cut[1:])]


def _texts(batches, encoder: Encoder):
    for batch in batches:
        for a, b, part in text_chunks(batch.column(1)):
            values, offsets = encoder.encode([t or "" for t in part])
            yield batch.column(0).slice(a, b - a), part, values, offsets


def encode(docs: DataFrame, vocabulary_path: str = VOCABULARY, check: bool = False) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of each row; with ``check`` also round_trip: whether the ids decode to the text."""
    vocabulary = read_vocabulary(vocabulary_path)
    model = model_bytes(vocabulary)

    def run(batches):
        encoder, pieces = Encoder(model), tuple(vocabulary)
        for ids, part, values, offsets in _texts(batches, encoder):
            null = np.array([t is None for t in part])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=pa.array(null))
            columns = [ids, pa.array(np.diff(offsets).astype(np.int32), mask=null), lists]
            if check:
                same = [t is None or t.encode() == d for t, d in zip(part, decode(pieces, values, offsets))]
                columns.append(pa.array(same, mask=null))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "token_ids", "round_trip"][: len(columns)])

    schema = "doc_id long, n_tokens int, token_ids array<int>" + ", round_trip boolean" * check
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode_ids(tokens: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows with doc_id and token_ids, the inverse of encode().  Bytes that are no UTF-8 (ids
    that did not come from a text) become replacement characters; an id outside the vocabulary is an error."""
    vocabulary = tuple(read_vocabulary(vocabulary_path))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            values, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in lists])])
            if len(values) and not (0 <= values.min() and values.max() < len(vocabulary)):
                raise ValueError("an id is outside the vocabulary")
            texts = [d.decode("utf-8", "replace") if ok else None for d, ok in zip(decode(vocabulary, values, offsets), lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
