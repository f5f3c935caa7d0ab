"""Chat formatting at the level of tokens.

A conversation becomes, turn by turn, [START] role newline content [END] newline, and one [STOP] at the end.
Role, content and newlines are encoded separately and the reserved ids are spliced between them, so no content
can produce one; control strings that occur in content are escaped as well (one more backslash after "<", so
that unescape() gives the content back), which keeps them inert should the text be formatted again.  The loss
mask is 1 on the content of trained roles and the [END] after it, as the prefix sum of +1/-1 marks at the
borders of those spans.

Rows are shuffled once, by conversation, and assembled from the sorted stream: no grouping buffer beside the
conversation at hand.

Defined results: turns are ordered by number, then role, then text, nulls first; repeated rows are repeated
turns; a null role has an empty name and is not trained; a null text is an empty content; rows with a null
conv_id are one conversation; texts of any length are taken whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm._text import text_chunks
from trawl.llm.bpe import VOCABULARY, Encoder, model_bytes, read_vocabulary

CONTROL = ("<|endoftext|>", "<|im_start|>", "<|im_end|>")
_PLAIN = re.compile(r"<(\\*)\|(endoftext|im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(endoftext|im_start|im_end)\|>")


def escape(content: str) -> str:
    return _PLAIN.sub(r"<\1\\|\2|>", content)


def unescape(content: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", content)


def reserved_ids(vocabulary_size: int) -> tuple[int, int, int]:
    """Ids of CONTROL: the first three after the vocabulary."""
    return vocabulary_size, vocabulary_size + 1, vocabulary_size + 2


class _Conversation:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.ids, self.marks, self.n, self.turns = conv_id, [], [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.n += len(ids)

    def finish(self, stop: int) -> tuple:
        self.add(np.array([stop], np.int32))
        step = np.zeros(self.n + 1, np.int8)
        for a, b in self.marks:
            step[a] += 1
            step[b] -= 1
        return self.conv_id, self.turns, np.concatenate(self.ids), np.cumsum(step[:-1], dtype=np.int8)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int32))
    ids, mask = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0) for i in (2, 3))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int32()),
            pa.array([len(r[2]) for r in rows], pa.int32()),
            pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(mask.astype(np.int8))),
        ],
        ["conv_id", "n_turns", "n_tokens", "token_ids", "loss_mask"],
    )


def format_chats(turns: DataFrame, vocabulary_path: str = VOCABULARY, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, n_turns, n_tokens, token_ids, loss_mask) of each conversation."""
    vocabulary = read_vocabulary(vocabulary_path)
    model = model_bytes(vocabulary)
    stop, start, end = reserved_ids(len(vocabulary))

    def run(batches):
        encoder = Encoder(model)
        newline = encoder.encode(["\n"])[0]
        one_start, one_end = np.array([start], np.int32), np.array([end], np.int32)
        current: _Conversation | None = None
        for batch in batches:
            convs, roles = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b, texts in text_chunks(batch.column(3)):
                n = b - a
                values, at = encoder.encode([(r or "") + "\n" for r in roles[a:b]] + [escape(t or "") for t in texts])
                done = []
                for i in range(n):
                    if current is None or current.conv_id != convs[a + i]:
                        if current is not None:
                            done.append(current.finish(stop))
                        current = _Conversation(convs[a + i])
                    current.turns += 1
                    current.add(one_start)
                    current.add(values[at[i] : at[i + 1]])
                    content_at = current.n
                    current.add(values[at[n + i] : at[n + i + 1]])
                    current.add(one_end)
                    if roles[a + i] in trained:
                        current.marks.append((content_at, current.n))
                    current.add(newline)
                if done:
                    yield _batch(done)
        if current is not None:
            yield _batch([current.finish(stop)])

    ordered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, n_turns int, n_tokens int, token_ids array<int>, loss_mask array<byte>")
