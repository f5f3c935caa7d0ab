"""Which pairs the Jaccard join counts at all."""

import numpy as np
import pyarrow as pa
import pytest

from trawl.llm import jaccard
from trawl.llm._store import save_arrays
from trawl.llm._text import pack_sorted


def test_prefixes_leave_out_the_most_frequent(tmp_path):
    tokens = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 40, dtype=np.uint64))
    short = jaccard._shorten(tokens)
    df = np.random.default_rng(4).permutation(40).astype(np.int32) + 17
    path = f"file://{tmp_path}/filter.npz"
    save_arrays(path, bitmap=np.zeros(1 << (jaccard.BITMAP_BITS - 3), np.uint8), hot=short[2:], df=df[2:])
    prefix, _ = jaccard._Order(path, 0.4).prefix(tokens)
    n = jaccard.prefix_length(0.4, 40)
    assert prefix[:2].tolist() == short[:2].tolist()
    assert prefix[2:].tolist() == short[2:][np.argsort(df[2:])][: n - 2].tolist()


@pytest.mark.parametrize("t", [0.05, 0.4, 0.8, 1.0])
def test_sizes_of_similar_sets_are_few_classes_apart(t):
    apart = jaccard.classes_apart(t)
    sizes = np.unique(np.concatenate([np.arange(1, 2000), np.geomspace(2000, 5e6, 500).astype(int)]))
    of = lambda n: int(np.log(n) / np.log(jaccard.STEP) + 1e-12)
    for n in sizes.tolist():
        least = jaccard.least_overlap(t, n)
        assert of(n) - of(max(1, least)) <= apart


def test_groups_of_other_sizes_are_not_counted():
    key = lambda size, group, entity: (size << jaccard.HASH_BITS | group) << 32 | entity
    keys = np.array([key(1, 7, 1), key(2, 7, 2), key(9, 3, 3), key(9, 3, 4), key(20, 1, 5)], np.uint64)
    tokens = np.full(len(keys), 5, np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array([pack_sorted(tokens)], pa.binary()), pa.array([keys.tobytes()], pa.binary())], ["tokens", "keys"])
    rows = [(r["key"], r["group"], r["shared"]) for b in jaccard._matrix_part(iter([batch]), 3) for r in b.to_pylist()]
    group = (keys >> np.uint64(32)).tolist()
    assert sorted(rows) == sorted([(int(keys[0]), group[1], 1), (int(keys[2]), group[2], 1)])
