"""Vectorised word splitting and hashing shared by the operators.

A text is handled as UTF-8 bytes.  ``Words`` cuts a batch of texts into words with a table of the 256 byte
values (True: belongs to a word) and gives every word a 64-bit hash, all in numpy: no Python object per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None

#: Bytes of a batch that are handled at once; bounds the temporaries of a worker to about 100 MB.
CHUNK_BYTES = 1 << 21

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW = powers(0x5851F42D4C957F2D, 4096)

SPACES = b" \t\n\r\x0b\x0c"
NOT_SPACE = np.array([b not in SPACES for b in range(256)])
#: Letters, digits and every byte of a character beyond ASCII.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on all input bits (splitmix64)."""
    h = h + np.uint64(_ODD)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of several texts: ``hashes``, byte ``starts``/``ends`` in ``data``, and ``bounds``: the words of
    text i are ``hashes[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, texts: list[bytes], inside: np.ndarray = NOT_SPACE):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_starts = np.concatenate([[0], np.cumsum(sizes)])
        is_in = inside[self.data]
        edge = np.flatnonzero(is_in[1:] != is_in[:-1]) + 1
        if len(is_in) and is_in[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.bounds = np.searchsorted(self.starts, self.text_starts)
        n = len(self.starts)
        if not n:
            self.hashes = np.zeros(0, np.uint64)
            return
        lengths = self.ends - self.starts
        at = np.flatnonzero(is_in)
        first = np.cumsum(lengths) - lengths
        offset = np.arange(len(at)) - np.repeat(first, lengths)
        if lengths.max() > len(_POW):
            weight = powers(int(_POW[1]), int(lengths.max()) + 1)[offset]
        else:
            weight = _POW[offset]
        total = np.add.reduceat(_BYTE[self.data[at]] * weight, first)
        self.hashes = mix(total + lengths.astype(np.uint64) * np.uint64(_ODD))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (positions whose window leaves the array are dropped)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base = powers(0xD6E8FEB86659FD93, n)
    m = len(hashes) - n + 1
    total = np.zeros(m, np.uint64)
    for i in range(n):
        total += hashes[i : i + m] * base[i]
    return mix(total)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """As ngram_hashes for large n: a polynomial over prefix sums, O(1) a window."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base = 0xD6E8FEB86659FD93
    weight = powers(base, len(hashes) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * weight[:-1], dtype=np.uint64)])
    inverse = powers(pow(base, -1, 1 << 64), len(hashes) + 1)
    return mix((prefix[n:] - prefix[:-n]) * inverse[: len(hashes) - n + 1])


def release() -> None:
    """Give memory that this worker has no use for back to the system: workers live on and share the executor's."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of rows of about ``limit`` bytes of text together, one row at least, with their texts."""
    total = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(column):
        before = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield a, b, column.slice(a, b - a).to_pylist()
        a = b
    release()


def encoded_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """As text_chunks, in lower case and as UTF-8; null as an empty text."""
    for a, b, texts in text_chunks(column, limit):
        yield a, b, [t.lower().encode() if t else b"" for t in texts]


def ragged_take(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``which`` of a ragged array, concatenated, with their offsets."""
    lengths = (offsets[1:] - offsets[:-1])[which]
    out = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(out[-1]) + np.repeat(offsets[:-1][which] - out[:-1], lengths)
    return values[at], out


def pack_sorted(values: np.ndarray) -> bytes:
    """Differences of ascending numbers, byte plane by byte plane: small ones leave planes of zeros to compression."""
    steps = np.diff(values, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T[:6].tobytes()


def unpack_sorted(block: bytes) -> np.ndarray:
    planes = np.frombuffer(block, np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def input_parts(docs: DataFrame, part_bytes: int = 1 << 25) -> int:
    """Into how many ranges of hashes to divide work over ``docs``, by the bytes of its texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, -(-size // part_bytes))
