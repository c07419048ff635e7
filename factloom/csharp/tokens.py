"""Tokens of C# source: comments and directives dropped, the holes of interpolated strings kept as code."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id, word (keyword), num, str, op
    text: str
    line: int


#: Reserved words, and operators of several characters, longest first.
KEYWORDS = frozenset(
    """abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit
    extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out
    override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true
    try typeof uint ulong unchecked unsafe ushort using virtual void volatile while""".split()
)
OPERATORS = ("??=", "<<=", "=>", "==", "!=", "<=", ">=", "&&", "||", "??", "?.", "++", "--", "+=", "-=", "*=", "/=", "%=", "|=", "&=", "^=", "->", "::", "..")

_DIRECTIVE = re.compile(r"[ \t]*#[^\n]*")
_SKIP = r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
_REST = (
    r"(?P<word>@?[^\W\d]\w*)|(?P<num>0[xXbB][\da-fA-F_]+[uUlL]*|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?[fFdDmMuUlL]*)|(?P<op>"
    + "|".join(map(re.escape, OPERATORS))
    + "|.)"
)
#: What comes next: space and comments, what may open a string, or a token.
_NEXT = re.compile(rf"{_SKIP}|(?P<quote>[\"$@'])|{_REST}", re.S)
_PLAIN_NEXT = re.compile(_REST, re.S)
_CHAR = re.compile(r"'(?:[^'\\\n]|\\.[^'\n]*)'")
_HEAD = re.compile(r'[$@]*"')
_PLAIN = re.compile(r'"(?:[^"\\\n]|\\.)*"?')
_VERBATIM = re.compile(r'@"(?:[^"]|"")*"?')
_RAW = re.compile(r'("{3,}).*?(?:\1(?!")|\Z)', re.S)


def tokenize(text: str) -> list[Token]:
    """Never fails: what is no token is passed over."""
    out: list[Token] = []
    _run(text, 0, len(text), 1, out)
    return out


def _run(text: str, at: int, end: int, line: int, out: list[Token]) -> None:
    fresh = True  # at the beginning of a line
    while at < end:
        if fresh and (m := _DIRECTIVE.match(text, at, end)):
            at = m.end()
            if at >= end:
                break
        fresh = False
        m = _NEXT.match(text, at, end)
        kind = m.lastgroup
        if kind == "quote":
            if m[0] != "'" and (n := _string(text, at, end, line, out)):
                line += text.count("\n", at, n)
                at = n
                continue
            if m[0] == "'" and (m := _CHAR.match(text, at, end)):
                out.append(Token("str", m[0], line))
                at = m.end()
                continue
            m = _PLAIN_NEXT.match(text, at, end)
            kind = m.lastgroup
        found = m[0]
        if kind == "skip":
            n = found.count("\n")
            line, fresh = line + n, n > 0 and found[-1].isspace()
            at = m.end()
            continue
        if kind == "word":
            word = found.lstrip("@")
            out.append(Token("word" if word in KEYWORDS and found[0] != "@" else "id", word, line))
        elif kind == "num":
            out.append(Token("num", found, line))
        else:
            if found == "?." and text[at + 2 : at + 3].isdigit():
                found = "?"
            out.append(Token("op", found, line))
            at += len(found)
            continue
        at = m.end()


def _string(text: str, at: int, end: int, line: int, out: list[Token]) -> int:
    """End of the string that begins here, or 0 if none does."""
    head = _HEAD.match(text, at, end)
    if not head:
        return 0
    marks = head[0][:-1]
    quote = head.end() - 1
    raw = _RAW.match(text, quote, end)
    if "$" not in marks:
        m = raw or (_VERBATIM.match(text, quote - 1, end) if "@" in marks else _PLAIN.match(text, quote, end))
        out.append(Token("str", '""', line))
        return m.end()
    out.append(Token("str", '""', line))
    if raw:
        stop, depth = raw.end(), marks.count("$")
        for hole in re.finditer(r"\{" * depth + r"([^{}]*)" + r"\}" * depth, raw[0]):
            _hole(text, quote + hole.start(1), quote + hole.end(1), line + text.count("\n", at, quote + hole.start(1)), out)
        return stop
    i = quote + 1
    while i < end and text[i] != '"' or text.startswith('""', i) and "@" in marks:
        if text[i] == '"':
            i += 2
        elif text[i] == "\\" and "@" not in marks:
            i += 2
        elif text.startswith("{{", i) or text.startswith("}}", i):
            i += 2
        elif text[i] == "{":
            j, depth = i + 1, 1
            while j < end and depth:
                if text[j] == '"' or text[j] == "$" and text[j + 1 : j + 2] == '"':
                    j = max(_string(text, j, end, line, []), j + 1)
                    continue
                depth += (text[j] == "{") - (text[j] == "}")
                j += 1
            _hole(text, i + 1, j - 1, line + text.count("\n", at, i), out)
            i = j
        else:
            i += 1
    return min(i + 1, end)


def _hole(text: str, a: int, b: int, line: int, out: list[Token]) -> None:
    out.append(Token("op", "(", line))
    _run(text, a, b, line, out)
    out.append(Token("op", ")", line))
