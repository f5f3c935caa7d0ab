"""From one text to its chunks.

A chunk is (location, byte_start, byte_end, content); location is a label such as "3-7" (lines) or "w2" (words).
Chunkers that need no state are Spark expressions; the others are Python functions of the text's bytes, applied
batchwise.  An empty text has no chunks.
"""

from __future__ import annotations

import re
import subprocess
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import slices

CHUNKS = "array<struct<location:string,byte_start:int,byte_end:int,content:string,attrs:array<struct<key:string,value:string>>>>"
#: location, byte range
Span = tuple[str, int, int]


def line_starts(data: bytes) -> list[int]:
    """Where each line begins, and the end of the data."""
    ends = [m.end() for m in re.finditer(rb"\n", data)]
    return [0, *ends] if not data or data.endswith(b"\n") else [0, *ends, len(data)]


def is_blank(line: bytes) -> bool:
    return not line.strip(b" \t\n\r")


def _label(first: int, last: int) -> str:
    return f"{first}-{last}"


def lines(data: bytes) -> Iterator[Span]:
    at = line_starts(data)
    for i, (a, b) in enumerate(zip(at, at[1:]), 1):
        yield _label(i, i), a, b


# ---- markdown


def _fence(line: bytes) -> tuple[bytes, int] | None:
    """Character and length of an opening fence."""
    m = re.match(rb"(`{3,}|~{3,})", line)
    if not m or (m[0][:1] == b"`" and b"`" in line[m.end() :]):
        return None
    return m[0][:1], len(m[0])


def _closes(line: bytes, fence: tuple[bytes, int]) -> bool:
    rest = line.rstrip(b"\n\r")
    bare = rest.lstrip(fence[0])
    return len(rest) - len(bare) >= fence[1] and not bare.strip(b" \t")


def markdown(data: bytes) -> Iterator[Span]:
    """Paragraphs between blank lines.  A heading takes the tag lines that follow and one more paragraph with it."""
    at = line_starts(data)
    blocks: list[list] = []  # [is a heading, only tags, first line, last line]
    fence: tuple[bytes, int] | None = None
    grows = False
    for i, (a, b) in enumerate(zip(at, at[1:]), 1):
        line = data[a:b]
        heading = tags = False
        if fence:
            fence = None if _closes(line, fence) else fence
        elif opened := _fence(line):
            fence = opened
        elif is_blank(line):
            grows = False
            continue
        else:
            heading, tags = line.startswith(b"#"), line.startswith(b"@")
        if grows and not heading:
            blocks[-1][1] &= tags
            blocks[-1][3] = i
        else:
            blocks.append([heading, tags, i, i])
            grows = True
    held: list[int] | None = None
    for heading, tags, first, last in blocks:
        if held and not heading:
            held[1] = last
            if tags:
                continue
            yield _label(*held), at[held[0] - 1], at[held[1]]
            held = None
            continue
        if held:
            yield _label(*held), at[held[0] - 1], at[held[1]]
            held = None
        if heading:
            held = [first, last]
        else:
            yield _label(first, last), at[first - 1], at[last]
    if held:
        yield _label(*held), at[held[0] - 1], at[held[1]]


# ---- brackets


@dataclass(frozen=True)
class Group:
    """Markers of one kind of bracket.  ``inner`` is None where anything may stand inside; otherwise the text inside
    is literal but for the openers named.  ``parents``: openers right inside which it is recognised (None: anywhere)."""

    opens: tuple[str, ...]
    closes: tuple[str, ...]
    separators: tuple[str, ...] = ()
    escape: str = ""
    inner: tuple[str, ...] | None = None
    parents: tuple[str, ...] | None = None


def _pairs(spec: str) -> tuple[Group, ...]:
    return tuple(Group((p[0],), (p[1],)) for p in spec.split())


def _quote(mark: str, escape: str = "") -> Group:
    return Group((mark,), (mark,), escape=escape, inner=())


@dataclass(frozen=True)
class Language:
    line_comments: tuple[str, ...] = ()
    block_comments: tuple[tuple[str, str], ...] = ()
    groups: tuple[Group, ...] = ()

    def __post_init__(self):
        for g in self.groups:
            for m in (*g.opens, *g.closes, *g.separators):
                if not m:
                    raise ValueError("an empty marker")

    @cached_property
    def comment(self) -> str:
        either = [re.escape(m).encode() + rb"[^\n]*\n?" for m in self.line_comments]
        either += [re.escape(a).encode() + rb"(?:[\s\S]*?" + re.escape(b).encode() + rb"|[\s\S]*)" for a, b in self.block_comments]
        return b"|".join(either) or rb"(?!)"

    @property
    def comment_syntax(self) -> str:
        return self.line_comments[0] if self.line_comments else ""


_C_QUOTES = (_quote('"', "\\"), _quote("'", "\\"))
_C = Language(("//",), (("/*", "*/"),), _pairs("{} () []") + _C_QUOTES)
_SHELL = Language(
    ("#",),
    (),
    (
        Group(("if",), ("fi",), ("then", "elif", "else")),
        Group(("while", "for"), ("done",), ("do",)),
        Group(("case",), ("esac",)),
        *_pairs("{} ()"),
        _quote('"', "\\"),
        _quote("'"),
    ),
)
LANGUAGES: dict[str, Language] = {
    "c": _C,
    "cpp": _C,
    "java": _C,
    "go": replace(_C, groups=_C.groups + (_quote("`"),)),
    "js": replace(_C, groups=_C.groups + (Group(("`",), ("`",), escape="\\", inner=("${",)), Group(("${",), ("}",), parents=("`",)))),
    "lisp": Language((";",), (), _pairs("() []") + (_quote('"', "\\"),)),
    "nginx": Language(("#",), (), _pairs("{}") + (_quote('"', "\\"), _quote("'"))),
    "pascal": Language(
        (),
        (("{", "}"), ("(*", "*)")),
        (Group(("begin", "record", "class"), ("end",)), Group(("if",), ("end",), ("then", "else")), *_pairs("() []"), _quote("'")),
    ),
    "shell": _SHELL,
    "bash": _SHELL,
}


def language(name: str) -> Language:
    try:
        return LANGUAGES[name.lower()]
    except KeyError:
        raise ValueError(f"no language {name!r}") from None


def _marker(m: str) -> bytes:
    """A marker that begins with a word character must stand as a word."""
    plain = re.escape(m).encode()
    return rb"(?<!\w)" + plain + rb"(?!\w)" if re.match(r"\w", m, re.ASCII) else plain


class _Reader:
    """Cuts bytes into tokens: (first byte, end, change of depth)."""

    def __init__(self, lang: Language):
        self.lang, self.known = lang, {}

    def _code(self, top: tuple[Group, str] | None):
        """What may come in code right inside ``top``: a pattern, and what each of its groups stands for."""
        if top not in self.known:
            options: list[tuple[bytes, str, Group, str]] = []
            for g in self.lang.groups:
                if g.parents is None or (top and top[1] in g.parents):
                    options += [(_marker(m), "open", g, m) for m in g.opens]
            if top:
                options += [(_marker(m), "close", top[0], m) for m in top[0].closes]
                options += [(_marker(m), "separator", top[0], m) for m in top[0].separators]
            for g in self.lang.groups:
                if g.inner is None:
                    options += [(_marker(m), "stray", g, m) for m in g.closes]
            brackets = b"|".join(b"(" + o[0] + b")" for o in options) or rb"(?!)"
            either = re.compile(rb"([ \t\n\r\f]+)|(" + self.lang.comment + rb")|" + brackets)
            self.known[top] = either, [o[1:] for o in options]
        return self.known[top]

    def _literal(self, g: Group):
        if g not in self.known:
            options = [b"|".join(_marker(m) for m in g.closes), (re.escape(g.escape).encode() + rb"[\s\S]?") if g.escape else rb"(?!)"]
            inner = [(m, next((o for o in self.lang.groups if m in o.opens), None)) for m in g.inner or ()]
            inner = [(m, o) for m, o in inner if o]
            self.known[g] = re.compile(b"|".join(b"(" + o + b")" for o in options + [_marker(m) for m, _ in inner])), inner
        return self.known[g]

    def tokens(self, data: bytes) -> Iterator[tuple[int, int, int | None]]:
        stack: list[tuple[Group, str]] = []
        at = 0

        def weight(g: Group, change: int) -> int | None:
            return change if g.inner is None else None

        while at < len(data):
            top = stack[-1] if stack else None
            if top and top[0].inner is not None:
                pattern, inner = self._literal(top[0])
                start = at
                while (m := pattern.search(data, at)) and m[2] is not None:
                    at = m.end()
                end = m.start() if m else len(data)
                if end > start:
                    yield start, end, 0
                if not m:
                    return
                at = m.end()
                if m[1] is not None:
                    yield m.start(), at, None
                    stack.pop()
                else:
                    mark, g = inner[m.lastindex - 3]
                    yield m.start(), at, weight(g, 1)
                    stack.append((g, mark))
                continue
            pattern, options = self._code(top)
            m = pattern.search(data, at)
            if not m:
                yield at, len(data), 0
                return
            if m.start() > at:
                yield at, m.start(), 0
            at = m.end()
            if m.lastindex <= 2:
                yield m.start(), at, 0
                continue
            kind, g, mark = options[m.lastindex - 3]
            yield m.start(), at, weight(g, {"open": 1, "separator": 0}.get(kind, -1))
            if kind == "open":
                stack.append((g, mark))
            elif kind == "close":
                stack.pop()


def _bracket_groups(data: bytes, at: list[int], lang: Language) -> list[list[int]]:
    """[first line, last line] of the outermost brackets that span lines, with the lines that lead to them."""
    opens: set[int] = set()
    depth_after: dict[int, int] = {}
    depth = last = 0
    for a, b, change in _Reader(lang).tokens(data):
        last = bisect_right(at, b - 1, 0, len(at) - 1)
        if change is None:
            continue
        if change > 0 and depth == 0:
            opens.add(bisect_right(at, a, 0, len(at) - 1))
        depth = max(0, depth + change)
        depth_after[last] = depth
    groups, first = [], 0
    for line in range(1, last + 1):
        if not first and line in opens:
            first = line
        # a line that no token ends on counts as outside of all brackets
        if first and not depth_after.get(line, 0):
            groups.append([first, line])
            first = 0
    if first:
        groups.append([first, last])
    groups = [g for g in groups if g[1] > g[0]]
    before = 0
    for g in groups:
        while g[0] - 1 > before and not is_blank(data[at[g[0] - 2] : at[g[0] - 1]]):
            g[0] -= 1
        before = g[1]
    return groups


def _with_paragraphs(at: list[int], blank: list[bool], groups: list[list[int]]) -> Iterator[Span]:
    """Groups, and the paragraphs between them."""
    n, line, paragraph = len(blank), 1, 0
    waiting = iter(groups)
    g = next(waiting, None)
    passed = 0

    def span(first: int, last: int) -> Span:
        return _label(first, last), at[first - 1], at[last]

    for line in range(1, n + 1):
        if g and line == g[0]:
            if paragraph:
                yield span(paragraph, line - 1)
                paragraph = 0
            yield span(g[0], min(g[1], n))
            passed = g[1]
            g = next(waiting, None)
        elif line <= passed or (g and g[0] <= line <= g[1]):
            continue
        elif blank[line - 1]:
            if paragraph:
                yield span(paragraph, line - 1)
                paragraph = 0
        elif not paragraph:
            paragraph = line
    if paragraph:
        yield span(paragraph, n)


def brackets(lang: Language) -> Callable[[bytes], Iterator[Span]]:
    """Outermost brackets of several lines, with the lines right before them; other text by paragraphs."""

    def cut(data: bytes) -> Iterator[Span]:
        if data:
            at = line_starts(data)
            blank = [is_blank(data[a:b]) for a, b in zip(at, at[1:])]
            yield from _with_paragraphs(at, blank, _bracket_groups(data, at, lang))

    return cut


# ---- indentation


def _indent(line: bytes, tab_width: int) -> int:
    column = 0
    for b in line:
        if b == 0x20 or (b == 0x09 and tab_width <= 0):
            column += 1
        elif b == 0x09:
            column += tab_width - column % tab_width
        else:
            break
    return column


def indents(lang: Language, tab_width: int = 0) -> Callable[[bytes], Iterator[Span]]:
    """Scopes by indentation, each headed by the line before it; other text by paragraphs."""

    def cut(data: bytes) -> Iterator[Span]:
        if not data:
            return
        at = line_starts(data)
        n = len(at) - 1
        blank = [is_blank(data[a:b]) for a, b in zip(at, at[1:])]
        for a, b in lang.block_comments:
            for m in re.finditer(re.escape(a).encode() + rb"(?:[\s\S]*?" + re.escape(b).encode() + rb"|[\s\S]*)", data):
                for i in range(bisect_right(at, m.start()), n):
                    if at[i + 1] > m.end():
                        break
                    blank[i] = True
        found: list[list[int]] = []
        scopes: list[tuple[int, int]] = []  # (indent outside, header line)

        def close(last: int) -> None:
            header = scopes.pop()[1]
            while last > header and blank[last - 1]:
                last -= 1
            found.append([header, last])

        before = header = 0
        for line in range(1, n + 1):
            if blank[line - 1]:
                continue
            here = _indent(data[at[line - 1] : at[line]], tab_width)
            while scopes and here <= scopes[-1][0]:
                close(line - 1)
            if here > before and header:
                scopes.append((before, header))
            before, header = here, line
        while scopes:
            close(n)
        outer: list[list[int]] = []
        for g in sorted(found, key=lambda g: g[0]):
            if not outer or g[1] > outer[-1][1] or g[0] < outer[-1][0]:
                outer.append(g)
        marks = tuple(m.encode() for m in lang.line_comments)
        last = 0
        for g in outer:
            while g[0] - 1 > last and not blank[g[0] - 2] and data[at[g[0] - 2] : at[g[0] - 1]].lstrip(b" \t").startswith(marks or b"\0\0"):
                g[0] -= 1
            last = g[1]
        yield from _with_paragraphs(at, blank, outer)

    return cut


# ---- windows


def word_windows(words: int = 200, overlap: int = 50, pattern: str = r"[^\t\n\f\r ]+") -> Callable[[bytes], Iterator[Span]]:
    compiled = re.compile(pattern)

    def cut(data: bytes) -> Iterator[Span]:
        text = data.decode()
        found = [m.span() for m in compiled.finditer(text)]
        for number, i in enumerate(range(0, len(found), max(words - overlap, 1)), 1):
            a, b = found[i][0], found[min(i + words, len(found)) - 1][1]
            start = len(text[:a].encode())
            yield f"w{number}", start, start + len(text[a:b].encode())

    return cut


def line_blocks(size: int = 50, overlap: int = 10) -> Callable[[bytes], Iterator[Span]]:
    """Overlapping windows of lines."""

    def cut(data: bytes) -> Iterator[Span]:
        ends = [m.end() for m in re.finditer(rb"[^\n]*\n|[^\n]+", data)]
        for a in range(0, len(ends), max(size - overlap, 1)):
            b = min(a + size, len(ends))
            yield f"{a + 1}-{b}", ends[a - 1] if a else 0, ends[b - 1]

    return cut


def byte_blocks(size: int) -> Callable[[bytes], Iterator[Span]]:
    def cut(data: bytes) -> Iterator[Span]:
        for i, a in enumerate(range(0, len(data), size)):
            yield f"b{i}", a, min(a + size, len(data))

    return cut


# ---- registry and application


@dataclass(frozen=True)
class Chunker:
    """``cut`` gives the spans of a text: (location, first byte, end), and attributes as a fourth, (key, value) pairs,
    if it has any.  ``resumes``: appended text is cut from the last chunk on."""

    cut: Callable[[bytes], Iterator[Span]]
    resumes: bool = True
    writable: bool = True
    comment_syntax: str = ""

    def chunks(self, data: bytes) -> list[dict]:
        out = []
        for where, a, b, *attrs in self.cut(data) if data else ():
            pairs = [{"key": k, "value": v} for k, v in (attrs[0] if attrs else ())]
            out.append({"location": where, "byte_start": a, "byte_end": b, "content": data[a:b].decode(), "attrs": pairs})
        return out


def named(name: str) -> Chunker:
    """A built-in chunker: line, markdown, bracket-<language>, indent-<language>[-<tab width>], lines-<size>-<overlap>,
    words-<size>-<overlap>."""
    kind, _, rest = name.partition("-")
    if name == "line":
        return Chunker(lines)
    if name == "markdown":
        return Chunker(markdown)
    if kind == "bracket" and rest:
        lang = language(rest)
        return Chunker(brackets(lang), comment_syntax=lang.comment_syntax)
    if kind == "indent" and rest:
        which, _, width = rest.partition("-")
        lang = language(which)
        return Chunker(indents(lang, int(width or 0)), comment_syntax=lang.comment_syntax)
    if kind in ("lines", "words") and rest:
        size, _, overlap = rest.partition("-")
        return Chunker((line_blocks if kind == "lines" else word_windows)(int(size), int(overlap or 0)), resumes=False)
    raise ValueError(f"no chunker {name!r}")


@dataclass
class Registry:
    """Chunkers by strategy name."""

    own: dict[str, Chunker] = field(default_factory=dict)
    commands: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, chunker: Chunker | Callable[[bytes], Iterator[Span]]) -> None:
        self.own[name] = chunker if isinstance(chunker, Chunker) else Chunker(chunker, resumes=False)

    def add_command(self, name: str, command: str) -> None:
        self.commands[name] = command

    def remove(self, name: str) -> None:
        self.own.pop(name, None)
        self.commands.pop(name, None)

    def get(self, name: str) -> Chunker:
        return self.own[name] if name in self.own else named(name)

    def names(self) -> list[str]:
        return sorted(self.own | self.commands)


def run_command(command: str, path: str) -> list[tuple[str, str]]:
    """(location, content) of each line "location<tab>content" that a command prints about a file."""
    done = subprocess.run(["sh", "-c", command + ' "$1"', "--", path], capture_output=True, check=True)
    out = []
    for line in done.stdout.decode().split("\n"):
        line = line.removesuffix("\r")
        if not line:
            continue
        if "\t" not in line:
            raise ValueError(f"no tab in the chunker's line {line!r}")
        if len(line) > 16 << 20:
            raise ValueError("a chunker's line is longer than 16 MB")
        out.append(tuple(line.split("\t", 1)))
    return out


def _chunk_lists(texts: pa.Array, chunker: Chunker) -> pa.Array:
    """A list of chunks for each text; few texts at a time are Python objects."""
    text, number, pairs = pa.string(), pa.int32(), pa.struct([("key", pa.string()), ("value", pa.string())])
    pieces, lengths = [], []
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in slices(sizes):
        where, first, last, contents, attrs = [], [], [], [], []
        for t in texts.slice(lo, hi - lo).to_pylist():
            data, before = t.encode() if t else b"", len(where)
            for label, a, b, *more in chunker.cut(data) if data else ():
                where.append(label)
                first.append(a)
                last.append(b)
                contents.append(data[a:b].decode())
                attrs.append([{"key": k, "value": v} for k, v in more[0]] if more else [])
            lengths.append(len(where) - before)
        columns = [pa.array(where, text), pa.array(first, number), pa.array(last, number), pa.array(contents, text), pa.array(attrs, pa.list_(pairs))]
        pieces.append(pa.StructArray.from_arrays(columns, ["location", "byte_start", "byte_end", "content", "attrs"]))
    kind = pa.struct([("location", text), ("byte_start", number), ("byte_end", number), ("content", text), ("attrs", pa.list_(pairs))])
    offsets = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(pieces) if pieces else pa.array([], kind))


def chunk_column(text: Column, chunker: Chunker) -> Column:
    """Chunks of a text column, as array<struct<location, byte_start, byte_end, content>>."""

    def apply(texts: pa.Array) -> pa.Array:
        return _chunk_lists(texts, chunker)

    return F.arrow_udf(apply, CHUNKS)(text)


def chunked(docs: DataFrame, chunker: Chunker | str, text: str = "text") -> DataFrame:
    """``docs`` without the text, one row a chunk: pos (0, 1, ...), location, byte_start, byte_end, content, attrs."""
    chunker = named(chunker) if isinstance(chunker, str) else chunker
    others = [c for c in docs.columns if c != text]
    found = docs.select(*others, F.posexplode(chunk_column(F.col(text), chunker)).alias("pos", "c"))
    return found.select(*others, "pos", "c.*")


def line_column(text: Column) -> Column:
    """Lines with their line ends, all in the JVM."""
    return F.regexp_extract_all(text, F.lit("[^\\n]*\\n|[^\\n]+"), F.lit(0))


def chunked_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """As chunked(docs, "line") without byte positions, and without Python."""
    others = [c for c in docs.columns if c != text]
    found = docs.select(*others, F.posexplode(line_column(F.col(text))).alias("pos", "content"))
    number = (F.col("pos") + 1).cast("string")
    return found.select(*others, "pos", F.concat(number, F.lit("-"), number).alias("location"), "content")


def _windows(items: Column, size: int, overlap: int) -> Column:
    """Numbers of the first items of the windows."""
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(max(size - overlap, 1)))).otherwise(F.array().cast("array<int>"))


def _one_line(c: Column) -> Column:
    return F.regexp_replace(c, "\n", r"\\n")


def line_windows(docs: DataFrame, size: int = 50, overlap: int = 10, text: str = "text") -> DataFrame:
    """Overlapping windows of lines: pos, location, content with its line ends written as backslash n.  An empty text
    has one empty window."""
    others = [c for c in docs.columns if c != text]
    has = docs.where(F.col(text).isNotNull()).select(*others, F.when(F.col(text) == "", F.array(F.lit(""))).otherwise(line_column(F.col(text))).alias("_lines"))
    found = has.select(*others, "_lines", F.posexplode(_windows(F.col("_lines"), size, overlap)).alias("pos", "_first"))
    last = F.least(F.col("_first") + size, F.size("_lines")).cast("string")
    return found.select(
        *others, "pos", F.concat((F.col("_first") + 1).cast("string"), F.lit("-"), last).alias("location"),
        _one_line(F.array_join(F.slice("_lines", F.col("_first") + 1, F.lit(size)), "")).alias("content"),
    )


def word_window_rows(docs: DataFrame, size: int = 200, overlap: int = 50, text: str = "text") -> DataFrame:
    """Overlapping windows of words: pos, location, content with its line ends written as backslash n."""
    others = [c for c in docs.columns if c != text]
    words = F.regexp_extract_all(F.col(text), F.lit("[^\\t\\n\\f\\r ]+[\\t\\n\\f\\r ]*"), F.lit(0))
    found = docs.select(*others, words.alias("_words")).select(*others, "_words", F.posexplode(_windows(F.col("_words"), size, overlap)).alias("pos", "_first"))
    content = F.regexp_replace(F.array_join(F.slice("_words", F.col("_first") + 1, F.lit(size)), ""), "[\t\n\f\r ]+\\z", "")
    return found.select(*others, "pos", F.concat(F.lit("w"), (F.col("pos") + 1).cast("string")).alias("location"), _one_line(content).alias("content"))


def line_range(text: Column, location: Column) -> Column:
    """The lines "first-last" of a text; null where there are not so many."""
    parts = F.split(location, "-")
    first, last = F.element_at(parts, 1).cast("int"), F.element_at(parts, 2).cast("int")
    every = line_column(text)
    return F.when((first >= 1) & (last >= first) & (last <= F.size(every)), F.array_join(F.slice(every, first, last - first + 1), ""))


def resumed(chunker: Chunker, data: bytes, last: tuple[int, int] | None) -> tuple[bool, list[dict]]:
    """Chunks of a text that has grown, from the byte range of its last chunk so far: whether that chunk is replaced,
    and the chunks from there on with absolute positions."""
    if last is None:
        return False, chunker.chunks(data)
    start, end = last
    if not 0 <= start <= end <= len(data):
        raise ValueError(f"bytes {start}-{end} are outside of the text of {len(data)} bytes")
    before = data[:start].count(b"\n")
    out = []
    for c in chunker.chunks(data[start:]):
        out.append(c | {"location": shifted(c["location"], before), "byte_start": c["byte_start"] + start, "byte_end": c["byte_end"] + start})
    if out and (out[0]["byte_start"], out[0]["byte_end"]) == (start, end):
        return False, out[1:]
    return bool(out), out


def shifted(location: str, lines_before: int) -> str:
    m = re.fullmatch(r"(\d+)-(\d+)", location)
    return f"{int(m[1]) + lines_before}-{int(m[2]) + lines_before}" if m else location
