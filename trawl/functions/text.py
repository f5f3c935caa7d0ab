"""Encoding of text for trigram matching, the trigrams themselves, tokens and query terms.

Every rule exists twice with equal results: as plain Python for query strings at planning time, and as Spark
columns for data.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "[ \t\n\r]+"
_INSIDE = re.compile(rb"[\x80-\xbf\xe0-\xff][\x80-\xbf]{2}\Z")


def simple_lower(text: str) -> str:
    """Lower case character by character: no final sigma, no character becomes two."""
    return text.translate({0x130: "i", 0x3A3: "σ"}).lower()


def lowered(c: Column) -> Column:
    return F.lower(F.translate(c, "İΣ", "iσ"))


@dataclass(frozen=True)
class Encoding:
    """How text becomes the bytes whose trigrams are matched.

    Case is folded if wanted, ``aliases`` replace single ASCII characters, white space at the start goes, and each
    other run of it is one zero byte."""

    case_insensitive: bool = False
    aliases: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for pair in self.aliases.items():
            if any(len(c) != 1 or ord(c) > 127 for c in pair):
                raise ValueError(f"an alias must map one ASCII character to another: {pair}")

    def encode(self, text: str) -> bytes:
        if self.case_insensitive:
            text = simple_lower(text)
        text = text.translate(str.maketrans(dict(self.aliases)))
        return re.sub(SPACES, "\0", text.lstrip(" \t\n\r")).encode()

    def column(self, c: Column) -> Column:
        if self.case_insensitive:
            c = lowered(c)
        if self.aliases:
            c = F.translate(c, "".join(self.aliases), "".join(self.aliases.values()))
        return F.regexp_replace(F.regexp_replace(c, "^" + SPACES, ""), SPACES, "\0")

    def byte_string(self, c: Column) -> Column:
        """The encoded bytes as a string of one character a byte, so that string functions work on bytes."""
        return F.decode(F.encode(self.column(c), "UTF-8"), "ISO-8859-1")

    def trigrams(self, text: str) -> list[int]:
        """Three-byte windows in order, repeats included, without those that lie within one character."""
        data = self.encode(text)
        windows = (data[i : i + 3] for i in range(len(data) - 2))
        return [int.from_bytes(w, "big") for w in windows if not _INSIDE.match(w)]

    def trigram_counts(self, text: str) -> Counter[int]:
        return Counter(self.trigrams(text))

    def trigram_of(self, three: bytes) -> int | None:
        """Number of a three-byte string; None for one that the index can't hold."""
        if len(three) != 3:
            return None
        if self.case_insensitive:
            three = three.lower()
        table = {ord(a): ord(b) for a, b in self.aliases.items()}
        coded = bytes(0 if b in b" \t\n\r" else b for b in (table.get(b, b) for b in three))
        return None if b"\0\0" in coded or _INSIDE.match(coded) else int.from_bytes(coded, "big")


def trigram_bytes(trigram: int) -> bytes:
    return trigram.to_bytes(3, "big")


def trigram_text(trigram: int) -> str:
    """For people: white space as a blank."""
    return trigram_bytes(trigram).replace(b"\0", b" ").decode("latin-1")


def trigram_text_column(c: Column) -> Column:
    byte = lambda shift: F.chr(F.when(F.shiftright(c, shift).bitwiseAND(255) == 0, 32).otherwise(F.shiftright(c, shift).bitwiseAND(255)))
    return F.concat(byte(16), byte(8), byte(0))


def slices(lengths: np.ndarray, rows: int = 512, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and about ``size`` bytes together, one row at least."""
    total, a = np.concatenate([[0], np.cumsum(lengths)]), 0
    while a < len(lengths):
        b = max(a + 1, min(a + rows, int(np.searchsorted(total, total[a] + size, side="right")) - 1))
        yield a, b
        a = b


def _byte_lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _encoded(texts: pa.Array) -> list[bytes]:
    return [t.encode() if t is not None else b"" for t in texts.to_pylist()]


def _windows(part: list[bytes], owner: np.ndarray | None = None) -> np.ndarray:
    """owner << 24 | trigram of each three-byte window within a text, an owner being the text's number if not given."""
    sizes = np.fromiter(map(len, part), np.int64, len(part))
    data = np.frombuffer(b"".join(part) + b"\0\0", np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(part)) if owner is None else owner, sizes)
    ok = np.arange(len(row)) + 3 <= np.repeat(np.cumsum(sizes), sizes)
    x, y, z = data[:-2], data[1:-1], data[2:]
    follows = (y & 0xC0) == 0x80
    follows &= (z & 0xC0) == 0x80
    ok &= ~(follows & (x >= 0x80) & ((x & 0xE0) != 0xC0))[: len(row)]
    return ((row << 24) | (x << 16 | y << 8 | z)[: len(row)])[ok]


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)


def _counted_trigrams(encoded: pa.Array) -> pa.Array:
    """A list of (trigram, tf) for each text, made without an object for each trigram."""
    empty = [np.zeros(0, np.int32)]
    trigrams, counts, lengths = [], [], []
    for a, b in slices(_byte_lengths(encoded)):
        keys, count = np.unique(_windows(_encoded(encoded.slice(a, b - a))), return_counts=True)
        lengths.append(np.diff(np.searchsorted(keys >> 24, np.arange(b - a + 1))))
        trigrams.append((keys & 0xFFFFFF).astype(np.int32))
        counts.append(count.astype(np.int32))
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(trigrams or empty)), pa.array(np.concatenate(counts or empty))], ["trigram", "tf"])
    return _lists(np.concatenate(lengths or empty), pairs)


def _trigram_sets(encoded: pa.Array) -> pa.Array:
    """From lists of texts to the distinct trigrams of each list, and the number of windows."""
    empty = [np.zeros(0, np.int32)]
    of_row = pc.fill_null(pc.list_value_length(encoded), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    texts = encoded.flatten()
    first = np.concatenate([[0], np.cumsum(of_row)])
    size = np.concatenate([[0], np.cumsum(_byte_lengths(texts))])
    trigrams, lengths, windows = [], [], []
    for a, b in slices(np.diff(size[first])):
        found = _windows(_encoded(texts.slice(first[a], first[b] - first[a])), np.repeat(np.arange(b - a), of_row[a:b]))
        windows.append(np.bincount(found >> 24, minlength=b - a))
        keys = np.unique(found)
        lengths.append(np.diff(np.searchsorted(keys >> 24, np.arange(b - a + 1))))
        trigrams.append((keys & 0xFFFFFF).astype(np.int32))
    sets = _lists(np.concatenate(lengths or empty), pa.array(np.concatenate(trigrams or empty)))
    return pa.StructArray.from_arrays([sets, pa.array(np.concatenate(windows or empty).astype(np.int64))], ["trigrams", "n"])


def trigram_set(encoded: Column) -> Column:
    """From an array of encoded texts to struct<trigrams, n>: what is distinct in them together, and the number of windows."""
    return F.arrow_udf(_trigram_sets, "struct<trigrams:array<int>,n:long>")(encoded)


#: Bits of a chunk's number that tell its place in a block of chunks.
PLACE_BITS = 12
BLOCKS = "trigram int, part long, places array<short>, tfs array<int>"


def trigram_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (chunk_no, encoded text), by number, to BLOCKS: the chunks of a part (chunk_no >> PLACE_BITS) that have a
    trigram, as places in the part, and how often.  A part of much text is cut into several blocks."""

    def block(part: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        trigram, place, count = (np.concatenate(x) for x in zip(*found))
        at = np.argsort(trigram, kind="stable")
        trigram = trigram[at]
        first = np.flatnonzero(np.concatenate([[True], trigram[1:] != trigram[:-1]]))
        n = np.diff(np.append(first, len(trigram)))
        return pa.RecordBatch.from_arrays(
            [pa.array(trigram[first]), pa.array(np.full(len(first), part)), _lists(n, pa.array(place[at])), _lists(n, pa.array(count[at]))], ["trigram", "part", "places", "tfs"]
        )

    part, found, held = None, [], 0
    for batch in batches:
        numbers, encoded = batch.column(0).to_numpy(), batch.column(1)
        parts = numbers >> PLACE_BITS
        edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for lo, hi in zip(edges, edges[1:]):
            if hi == lo:
                continue
            if found and (part != parts[lo] or held > 1 << 20):
                yield block(part, found)
                found, held = [], 0
            part = int(parts[lo])
            for a, b in slices(_byte_lengths(encoded.slice(lo, hi - lo))):
                keys, count = np.unique(_windows(_encoded(encoded.slice(lo + a, b - a))), return_counts=True)
                if len(keys):
                    place = (numbers[lo + a : lo + b] & ((1 << PLACE_BITS) - 1)).astype(np.int16)
                    found.append(((keys & 0xFFFFFF).astype(np.int32), place[keys >> 24], count.astype(np.int32)))
                    held += len(keys)
                if held > 1 << 20:
                    yield block(part, found)
                    found, held = [], 0
    if found:
        yield block(part, found)


def trigram_bag(encoded: Column) -> Column:
    """From encoded text to array<struct<trigram, tf>>, one entry for each distinct trigram: no shuffle to count."""
    return F.arrow_udf(_counted_trigrams, "array<struct<trigram:int,tf:int>>")(encoded)


def tokens(c: Column) -> Column:
    """Lower-case words between blanks, tabs and line ends, repeats included."""
    return F.regexp_extract_all(lowered(c), F.lit("[^ \\t\\n\\r]+"), F.lit(0))


def _counted_tokens(texts: pa.Array) -> pa.Array:
    lengths, words, counts = [], [], []
    for a, b in slices(_byte_lengths(texts)):
        bags = [Counter(re.findall("[^ \t\n\r]+", t or "")) for t in texts.slice(a, b - a).to_pylist()]
        lengths += map(len, bags)
        words.append(pa.array([w for bag in bags for w in bag], pa.string()))
        counts.append(pa.array([n for bag in bags for n in bag.values()], pa.int32()))
    pairs = [pa.concat_arrays(x) if x else pa.array([], kind) for x, kind in ((words, pa.string()), (counts, pa.int32()))]
    return _lists(np.array(lengths, np.int64), pa.StructArray.from_arrays(pairs, ["token", "cnt"]))


def token_counts(c: Column) -> Column:
    """array<struct<token, cnt>>, one entry for each distinct token: no shuffle to count."""
    return F.arrow_udf(_counted_tokens, "array<struct<token:string,cnt:int>>")(lowered(c))


def token_bag(text: str) -> Counter[str]:
    return Counter(re.findall("[^ \t\n\r]+", simple_lower(text)))


def fnv1a(token: str) -> int:
    h = 0x811C9DC5
    for b in token.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def fnv1a_column(c: Column) -> Column:
    data = F.hex(F.encode(c, "UTF-8"))
    n = F.expr("1L") * F.length(data) / 2
    values = F.when(n >= 1, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.conv(F.substring(data, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(values, F.lit(0x811C9DC5).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 0x01000193).bitwiseAND(0xFFFFFFFF))


def chunk_hash(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def parse_terms(query: str) -> list[str]:
    """Terms of a query: words between blanks, and phrases between double quotes, without the quotes.  A quote that
    is not closed is a character like others."""
    return [m[0] if m[1] is None else m[1] for m in re.finditer(r'"([^"]*)"|[^ ]+', query.strip())]


def pair_get(pairs: Column, key: str) -> Column:
    """First value of a key in array<struct<key, value>>."""
    return F.try_element_at(F.filter(pairs, lambda p: p["key"] == key), F.lit(1))["value"]
