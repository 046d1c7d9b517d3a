"""Tokens of TypeScript and JavaScript."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

_PUNCTUATION = sorted(
    "{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @ #".split(), key=len, reverse=True
)
_SKIP = re.compile(r"(?:\s|//[^\n]*|/\*.*?(?:\*/|\Z)|\A#![^\n]*)+", re.S)
_TOKEN = re.compile(
    r"(?P<id>#?[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<num>0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<str>\"(?:[^\"\\\n]|\\.|\\\n)*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.|\\\n)*(?:'|(?=\n)|\Z))|(?P<p>[()\[\]{};,~@]|" + "|".join(map(re.escape, _PUNCTUATION)) + r")|(?P<bad>.)",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
#: After these a slash divides; after other words and signs it begins a regular expression.
_VALUE_ENDS = {")", "]", "}"}
_OPERATOR_WORDS = {"return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "await", "yield"}


@dataclass(slots=True)
class Token:
    type: str  # id, num, str, template, regex, p, end
    text: str
    start: int
    end: int
    newline: bool = False
    spans: Sequence[tuple[int, int]] = ()  # of a template: its expressions


def _template(source: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """End of the template that begins at, and where its expressions are."""
    i, spans = at + 1, []
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1, spans
        elif source.startswith("${", i):
            begin, depth = i + 2, 1
            inner = begin
            while inner < len(source) and depth:
                token = next_token(source, inner, None)
                if token.type == "end":
                    inner = len(source)
                    break
                depth += (token.text == "{") - (token.text == "}")
                inner = token.end
            spans.append((begin, max(begin, inner - 1)))
            i = inner
        else:
            i += 1
    return len(source), spans


def next_token(source: str, at: int, last: Token | None, stop: int | None = None) -> Token:
    stop = len(source) if stop is None else stop
    newline, c = False, source[at : at + 1]
    if c == "/" or c == "#" or c.isspace():
        begin = at
        if m := _SKIP.match(source, at, stop):
            at = m.end()
            newline = source.find("\n", begin, at) >= 0
        c = source[at : at + 1]
    if at >= stop:
        return Token("end", "", stop, stop, newline)
    if c == "`":
        end, spans = _template(source, at)
        return Token("template", source[at:end], at, end, newline, spans)
    if c == "/":
        divides = last is not None and (last.type in ("num", "str", "template", "regex") or (last.type == "id" and last.text not in _OPERATOR_WORDS) or last.text in _VALUE_ENDS)
        if not divides and (m := _REGEX.match(source, at, stop)):
            return Token("regex", m[0], at, m.end(), newline)
    m = _TOKEN.match(source, at, stop)
    kind = m.lastgroup
    return Token("p" if kind == "bad" else kind, m[0], at, m.end(), newline)


def tokens(source: str, begin: int = 0, stop: int | None = None) -> list[Token]:
    """All tokens and one of type end."""
    out: list[Token] = []
    last, stop = None, len(source) if stop is None else stop
    while last is None or last.type != "end":
        last = next_token(source, begin, last, stop)
        begin = last.end
        out.append(last)
    return out
