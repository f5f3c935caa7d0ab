"""Licence scan with a generalised suffix automaton.

A template's automaton accepts every run of its tokens.  A document's tokens are streamed through it, which gives
for each token the length of the longest such run ending there (matching statistics).  Each template has one of its
own, so a run that goes on in another template hides nothing.  Runs of at least ``min_run`` tokens that cannot be
extended are chained, in order in both texts and with at most
``max_gap`` tokens between, and a chain that covers at least ``min_coverage`` of its template is reported.

Tokens are runs of letters and digits in lower case.  Templates are few and their tokens known, so a batch is
first mapped to template tokens in numpy; a token that a template does not have resets its automaton, hence only
stretches of ``min_run`` and more of its tokens are streamed.

A template of fewer tokens than ``min_run`` is found when whole.  Of chains over overlapping tokens those stay
that cover most tokens (ties: higher coverage, then name); chains of one template that overlap are alternatives
too, so every reported token belongs to one span.

Defined results: a null or empty text, or an empty table, gives no rows; texts of any length are scanned whole;
repeated rows give repeated rows; other columns are ignored; without templates nothing is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm._text import ALNUM, Words, encoded_chunks
from trawl.llm.licence_texts import TEMPLATES


class SuffixAutomaton:
    """Of several token sequences.  ``ends[state]``: (template, end) of each occurrence of the state's runs."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].add((t, i + 1))
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """The state of q's runs of at most length[p] + 1 tokens, cut off from q."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # an earlier template has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def longest_runs(self, tokens: list[int]) -> list[tuple[int, int, int]]:
        """(start, length, state) of each run of the stream that cannot be extended to either side."""
        runs, state, n = [], 0, 0
        for i, token in enumerate(tokens):
            if token not in self.next[state]:
                if n:
                    runs.append((i - n, n, state))
                while state and token not in self.next[state]:
                    state = self.link[state]
                    n = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                n += 1
            else:
                state, n = 0, 0
        if n:
            runs.append((len(tokens) - n, n, state))
        return runs


def chains(fragments: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int, int]]:
    """Best chains of one template's (start, template start, length): (start, end, covered tokens, fragments).

    Each fragment ends the best chain up to it; chains are then taken by tokens covered, each fragment once."""
    fragments = sorted(set(fragments))
    best: list[tuple[int, int]] = []
    reach = max((n for _, _, n in fragments), default=0) + max_gap
    for j, (s, t, n) in enumerate(fragments):
        top = (n, -1)
        for i in range(j - 1, -1, -1):
            ps, pt, pn = fragments[i]
            if ps + reach < s:  # so do all before
                break
            if ps + pn <= s <= ps + pn + max_gap and pt + pn <= t <= pt + pn + max_gap:
                top = max(top, (best[i][0] + n, i))
        best.append(top)
    used, out = set(), []
    for j in sorted(range(len(fragments)), key=lambda j: (-best[j][0], j)):
        path, i = [], j
        while i >= 0 and i not in used:
            path.append(i)
            i = best[i][1]
        if path:
            used.update(path)
            s, _, _ = fragments[path[-1]]
            e = fragments[j][0] + fragments[j][2]
            out.append((s, e, sum(fragments[i][2] for i in path), len(path)))
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], min_run: int, max_gap: int, min_coverage: float):
        self.names = sorted(templates)
        words = Words([templates[n].lower().encode() for n in self.names], ALNUM)
        self.vocabulary, ids = np.unique(words.hashes, return_inverse=True)
        self.sequences = [ids[a:b].tolist() for a, b in zip(words.bounds, words.bounds[1:])]
        self.sizes = [len(s) for s in self.sequences]
        self.automata = [SuffixAutomaton([s]) for s in self.sequences]
        self.has = np.zeros((len(self.sequences), len(self.vocabulary)), bool)
        for t, s in enumerate(self.sequences):
            self.has[t, s] = True
        self.min_run, self.max_gap, self.min_coverage = min_run, max_gap, min_coverage
        self.least = min([min_run, *(n for n in self.sizes if n)], default=min_run)

    def scan(self, words: Words) -> list[tuple[int, int, int, int, float, int]]:
        """(text, template, start, end, coverage, fragments), positions in tokens of the text."""
        if not len(self.vocabulary) or not len(words.hashes):
            return []
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == words.hashes
        text = words.text_of_word()
        # stretches of known tokens within one text
        cut = np.flatnonzero((known[1:] != known[:-1]) | (text[1:] != text[:-1])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(known)]])
        keep = known[starts] & (ends - starts >= self.least)
        fragments: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
        inside = np.flatnonzero(np.repeat(keep, ends - starts))
        for t, automaton in enumerate(self.automata):
            # stretches of the template's own tokens
            least = min(self.min_run, self.sizes[t])
            own = inside[self.has[t][at[inside]]]
            if not len(own):
                continue
            cut = np.flatnonzero((own[1:] != own[:-1] + 1) | (text[own[1:]] != text[own[:-1]])) + 1
            first, size = own[np.concatenate([[0], cut])], np.diff(np.concatenate([[0], cut, [len(own)]]))
            for a, b in zip(first[size >= least].tolist(), (first + size)[size >= least].tolist()):
                i = int(text[a])
                for s, n, state in automaton.longest_runs(at[a:b].tolist()):
                    if n >= least:
                        for _, e in automaton.ends[state]:
                            fragments.setdefault(i, {}).setdefault(t, []).append((a + s - int(words.bounds[i]), e - n, n))
        out = []
        for i, by_template in sorted(fragments.items()):
            found = []
            for t, f in by_template.items():
                for s, e, covered, pieces in chains(f, self.max_gap):
                    if covered >= self.min_coverage * self.sizes[t]:
                        found.append((-covered, -covered / self.sizes[t], t, s, e, pieces))
            taken: list[tuple[int, int]] = []
            for _, coverage, t, s, e, pieces in sorted(found):
                if all(e <= a or b <= s for a, b in taken):
                    taken.append((s, e))
                    out.append((i, t, s, e, -coverage, pieces))
        return out


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, min_run: int = 4, max_gap: int = 8, min_coverage: float = 0.7
) -> DataFrame:
    """(doc_id, licence, start_token, end_token, start_byte, end_byte, coverage, n_fragments) of each span; bytes
    are those of the lower-case text in UTF-8."""
    templates = TEMPLATES if templates is None else templates
    names = ["doc_id", "licence", "start_token", "end_token", "start_byte", "end_byte", "coverage", "n_fragments"]

    def run(batches):
        scanner = Scanner(templates, min_run, max_gap, min_coverage)
        for batch in batches:
            for a, _, texts in encoded_chunks(batch.column(1)):
                words = Words(texts, ALNUM)
                found = scanner.scan(words)
                i, t, s, e, coverage, pieces = (list(x) for x in zip(*found)) if found else ([],) * 6
                first = words.bounds[np.array(i, np.int64)]
                origin = words.text_starts[np.array(i, np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.array(i, np.int64) + a)),
                        pa.array([scanner.names[x] for x in t], pa.string()),
                        pa.array(s, pa.int64()),
                        pa.array(e, pa.int64()),
                        pa.array(words.starts[first + np.array(s, np.int64)] - origin if found else [], pa.int64()),
                        pa.array(words.ends[first + np.array(e, np.int64) - 1] - origin if found else [], pa.int64()),
                        pa.array(coverage, pa.float64()),
                        pa.array(pieces, pa.int32()),
                    ],
                    names,
                )

    schema = "doc_id long, licence string, start_token long, end_token long, start_byte long, end_byte long, coverage double, n_fragments int"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
