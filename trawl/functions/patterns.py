"""Regular expressions: from RE2's dialect to Java's, and to trigrams that a matching text must have."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from trawl.functions.text import Encoding

_SHARED = {"s": r"\t\n\f\r ", "d": "0-9", "w": "0-9A-Za-z_"}


class PatternError(ValueError):
    """A pattern that RE2 would not accept."""


def to_java(pattern: str) -> str:
    """An equivalent Java pattern; raises PatternError for what RE2 does not know."""
    out, i, in_class = ["(?d)"], 0, False
    many_lines = [False]  # whether (?m) holds, for each group that is open
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if c == "\\":
            if len(two) < 2:
                raise PatternError("a backslash ends the pattern")
            letter = two[1]
            if letter == "Q" and not in_class:
                end = pattern.find("\\E", i + 2)
                literal = pattern[i + 2 : end if end >= 0 else len(pattern)]
                out += [x if x.isalnum() or not x.isascii() else f"\\x{ord(x):02x}" for x in literal]
                i = end + 2 if end >= 0 else len(pattern)
                continue
            if letter == "E" and not in_class:  # closes nothing
                i += 2
                continue
            if letter.isdigit() and letter != "0" or letter in "kGZXRhHvV" and letter != "v":
                raise PatternError(f"{two} is not supported")
            if letter in "sdw":
                out.append(_SHARED[letter] if in_class else f"[{_SHARED[letter]}]")
            elif letter in "SDW":
                if in_class:
                    out.append(f"[^{_SHARED[letter.lower()]}]")
                else:
                    out.append(f"[^{_SHARED[letter.lower()]}]")
            elif letter == "v":
                out.append(r"\x0B")
            elif letter == "C":
                raise PatternError(r"\C is not supported")
            else:
                out.append(two)
            i += 2
            continue
        if in_class:
            named = re.match(r"\[:(\^?)([a-z]+):\]", pattern[i:])
            if named:
                name = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "graph": "Graph",
                        "print": "Print", "blank": "Blank", "cntrl": "Cntrl", "xdigit": "XDigit", "space": "Space", "ascii": "ASCII", "word": None}.get(named[2], "")
                if name == "":
                    raise PatternError(f"no class {named[0]}")
                out.append((r"\P{" if named[1] else r"\p{") + name + "}" if name else (r"\W" if named[1] else r"\w"))
                i += named.end()
                continue
            if c == "]":
                in_class = False
            # Java has nested classes and intersections, RE2 has not
            out.append("\\" + c if c == "[" or two == "&&" else c)
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i : i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        if two == "(?":
            group = re.match(r"\(\?(?:(P?<[A-Za-z_]\w*>)|([imsU]*(?:-[imsU]+)?)([:)]))", pattern[i:])
            if not group or group[0] == "(?)":
                raise PatternError(f"{pattern[i : i + 4]} is not supported")
            if group[1]:
                # group names have no effect on matching, and Java allows fewer
                out.append("(")
            else:
                if "U" in group[2]:
                    raise PatternError("the flag U is not supported")
                out.append(group[0])
            flags = group[2] or ""
            on, _, off = flags.partition("-")
            now = (many_lines[-1] or "m" in on) and "m" not in off
            if group[1] or group[3] == ":":
                many_lines.append(now)
            else:
                many_lines[-1] = now
            i += group.end()
            continue
        if c == "$":
            # without (?m), RE2's $ is the end of the text only
            out.append("$" if many_lines[-1] else r"\z")
            i += 1
            continue
        if c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise PatternError("possessive repetition is not supported")
        if c == "(":
            many_lines.append(many_lines[-1])
        elif c == ")" and len(many_lines) > 1:
            many_lines.pop()
        if c == "{":
            counted = re.match(r"\{(\d+)(?:,(\d*))?\}", pattern[i:])
            if counted and max(int(x) for x in counted.groups() if x) > 1000:
                raise PatternError("a repetition of more than 1000")
            # else it is a character like others
            out.append(c if counted else "\\{")
            i += 1
            continue
        out.append(c)
        i += 1
    if in_class:
        raise PatternError("a class is not closed")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            plain = re.sub(r"\\Q.*?(\\E|\Z)", "x", pattern, flags=re.DOTALL)
            plain = re.sub(r"\\[pP](\{\^?\w+\}|\w)|\\E|\\x\{[0-9A-Fa-f]+\}", "x", plain.replace(r"\z", r"\Z"))
            # Python takes {,n} for a repetition, and flags only at the start
            plain = re.sub(r"\{(?=,)", r"\\{", plain)
            plain = re.sub(r"\(\?[imsU-]+\)", "(?:)", plain)
            re.compile(plain)
        except re.error as e:
            raise PatternError(str(e)) from e
    return "".join(out)


@dataclass(frozen=True)
class Need:
    """What a text must have: every one of ``trigrams`` and of ``parts`` (all), or one of ``parts`` (not all).
    Without either there is no requirement."""

    trigrams: frozenset[int] = frozenset()
    parts: tuple[Need, ...] = ()
    all: bool = True

    @property
    def nothing(self) -> bool:
        return not self.trigrams and not self.parts


ANY = Need()


def _both(needs: list[Need]) -> Need:
    needs = [n for n in needs if not n.nothing]
    if len(needs) == 1:
        return needs[0]
    plain = frozenset().union(*(n.trigrams for n in needs if n.all)) if needs else frozenset()
    parts = [p for n in needs for p in (n.parts if n.all else (n,))]
    return Need(plain, tuple(dict.fromkeys(parts)))


def _either(needs: list[Need]) -> Need:
    return ANY if any(n.nothing for n in needs) else Need(parts=tuple(dict.fromkeys(needs)), all=False)


def needed_trigrams(pattern: str, encoding: Encoding) -> Need:
    """A condition that every matching text meets; ANY where none is known.

    Only runs of characters that are no white space count, as white space is encoded by its surroundings."""
    from re import _parser as parser  # the standard library's parse tree

    if re.search(r"\\[pPQECzv]|\[\[:", pattern):
        return ANY
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = parser.parse(pattern)
    except (re.error, OverflowError):
        return ANY
    folded = tree.state.flags & re.IGNORECASE and not encoding.case_insensitive

    def of(sequence, fold: bool) -> Need:
        found, run = [], ""

        def close():
            nonlocal run
            if run:
                found.append(Need(frozenset(encoding.trigrams(run))))
            run = ""

        for op, argument in sequence:
            name = str(op)
            if name == "LITERAL" and chr(argument) not in " \t\n\r\0" and not fold:
                run += chr(argument)
                continue
            close()
            if name == "SUBPATTERN":
                found.append(of(argument[-1], (fold or bool(argument[1] & re.IGNORECASE) and not encoding.case_insensitive)))
            elif name == "BRANCH":
                found.append(_either([of(b, fold) for b in argument[1]]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and argument[0] > 0:
                found.append(of(argument[2], fold))
        close()
        return _both(found)

    return of(tree, bool(folded))
