"""What a search is asked for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

#: (trigram, number of chunks that have it)
Frequencies = list[tuple[int, int]]
TrigramFilter = Callable[[Frequencies, int], Frequencies]


def keep_all(found: Frequencies, total_chunks: int) -> Frequencies:
    return found


def keep_rare(ratio: float) -> TrigramFilter:
    """Trigrams in at most this share of the chunks; all of them where there are fewer than two chunks."""

    def choose(found: Frequencies, total_chunks: int) -> Frequencies:
        return found if total_chunks < 2 else [(t, n) for t, n in found if n <= int(total_chunks * ratio)]

    return choose


def keep_rarest(count: int) -> TrigramFilter:
    """The ``count`` rarest trigrams; ties by number."""
    return lambda found, total_chunks: sorted(found, key=lambda x: (x[1], x[0]))[: max(count, 0)]


@dataclass(frozen=True)
class Options:
    """loose: any term instead of all.  scoring: "coverage", "density", "overlap", "terms", "bm25" or a function of
    (tf columns, number of distinct tokens) that returns a column; default coverage, or terms if loose.  only and
    except_files: file ids.  after (inclusive) and before: chunk times in ns.  chunk_filters: conditions over the
    columns content, attrs, n_tokens.  verify: every term occurs in the chunk, in any case.  regex: all match;
    except_regex: none does.  proximity: rerank so many of the first results by how close the terms are."""

    loose: bool = False
    scoring: str | Callable[..., Column] | None = None
    trigram_filter: TrigramFilter | None = None
    only: tuple[frozenset[int], ...] = ()
    except_files: frozenset[int] = frozenset()
    after: int | None = None
    before: int | None = None
    chunk_filters: tuple[Callable[..., Column], ...] = ()
    verify: bool = False
    regex: tuple[str, ...] = ()
    except_regex: tuple[str, ...] = ()
    proximity: int = 0
    no_tmp: bool = False

    @property
    def wanted_files(self) -> frozenset[int] | None:
        """Files of all the sets in ``only``; None: any."""
        return frozenset.intersection(*map(frozenset, self.only)) if self.only else None
