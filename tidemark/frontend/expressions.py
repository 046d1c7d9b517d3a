"""What a node's text says about rules: member chain, identifier, whether it is a call, argument texts. Works on cut-off text too."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tidemark.frontend.lexer import Token, tokens

#: A chain of plain names; a number's point is none of theirs.
_PLAIN = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*\Z")
_NAME = re.compile(r"#?[A-Za-z_$\u0080-￿][\w$\u0080-￿]*\Z")
_LEADING = re.compile(r"^(?:(?:await|void|yield)\s+)+")
_CAST = re.compile(r"\s+(?:as|satisfies)\s+(?:const|[A-Za-z_$][\w$.<>,\[\]|]*)\s*$")


@dataclass
class Expression:
    segments: list[str] | None = None
    identifier: str | None = None
    is_call: bool = False
    args: list[str] = field(default_factory=list)

    @property
    def last(self) -> str | None:
        return self.segments[-1] if self.segments else None

    @property
    def empty(self) -> bool:
        return not self.segments and self.identifier is None


def module_name(text: str) -> str:
    """A module's name as chains begin with it: scope kept, subpath and `node:` cut."""
    parts = text.removeprefix("node:").split("/")
    return "/".join(parts[:2]) if text.startswith("@") else parts[0]


def _closing(ts: list[Token], at: int) -> int | None:
    depth = 0
    for i in range(at, len(ts)):
        if ts[i].type == "p":
            depth += (ts[i].text in "([{") - (ts[i].text in ")]}")
            if depth == 0:
                return i
    return None


def _chain(ts: list[Token]) -> tuple[list[str] | None, int]:
    """Segments of the chain that begins here, and the token after it."""
    if not ts or ts[0].type == "end":
        return None, 0
    if ts[0].text == "(" and ts[0].type == "p":
        close = _closing(ts, 0)
        if close is None:
            return None, 0
        inner, used = _chain([*ts[1:close], Token("end", "", 0, 0)])
        if inner is None or used != close - 1:
            return None, 0
        segments, at = inner, close + 1
    elif ts[0].type == "id" and ts[0].text == "require" and len(ts) > 3 and ts[1].text == "(" and ts[2].type == "str" and ts[3].text == ")":
        segments, at = [module_name(ts[2].text[1:-1])], 4
    elif ts[0].type == "id":
        segments, at = [ts[0].text], 1
    else:
        return None, 0
    while at < len(ts):
        t = ts[at]
        if t.type == "p" and t.text == "!":
            at += 1
        elif t.type == "p" and t.text in (".", "?.") and ts[at + 1].type == "id":
            segments = [*segments, ts[at + 1].text]
            at += 2
        elif t.type == "p" and (t.text == "[" or (t.text == "?." and ts[at + 1].text == "[")):
            begin = at + (t.text == "?.")
            close = _closing(ts, begin)
            if close is None:
                break
            inside = ts[begin + 1 : close]
            literal = inside[0].text.strip("'\"`") if len(inside) == 1 and inside[0].type in ("str", "num") else None
            segments = [*segments, literal if literal else "*"]
            at = close + 1
        else:
            break
    return segments, at


def member_chain(text: str) -> list[str] | None:
    """Segments of `a.b?.['c'][d]` as a, b, c, *; nothing if the text is more or other than a chain."""
    if _PLAIN.match(text):
        return text.split(".")
    ts = tokens(text)
    segments, at = _chain(ts)
    return segments if segments and ts[at].type == "end" else None


def _arguments(text: str, ts: list[Token], at: int) -> list[str]:
    """Texts of the arguments in the parentheses that open at; text that was cut off ends the last one."""
    out, depth, begin = [], 0, ts[at].end
    for t in ts[at:]:
        if t.type == "end":
            if tail := text[begin:].rstrip("…").strip():
                out.append(tail)
            return out
        if t.type == "p":
            depth += (t.text in "([{") - (t.text in ")]}")
            if depth == 0 or (depth == 1 and t.text == ","):
                if piece := text[begin : t.start].strip():
                    out.append(piece)
                begin = t.end
            if depth == 0:
                return out
    return out


def _parse_one(text: str, call: bool) -> Expression:
    text = _CAST.sub("", _LEADING.sub("", text.strip().rstrip("; \t\n")).strip())
    if not text:
        return Expression(is_call=call)
    body = re.sub(r"^new\s+", "", text)
    ts = tokens(body)
    segments, at = _chain(ts)
    if segments and ts[at].type == "end":
        return Expression(segments, segments[0] if len(segments) == 1 and _NAME.match(segments[0]) else None, call)
    while segments and ts[at].text in ("?.", "<") and ts[at].type == "p":  # optional call, type arguments
        if ts[at].text == "?.":
            at += 1
        else:
            close = next((i for i in range(at, len(ts)) if ts[i].text.endswith(">") and ts[i + 1].text == "("), None)
            if close is None:
                break
            at = close + 1
    if segments and ts[at].type == "p" and ts[at].text == "(":
        return Expression(segments, segments[0] if len(segments) == 1 and _NAME.match(segments[0]) else None, True, _arguments(body, ts, at))
    return Expression(is_call=call)


def parse_expression(text: str | None, label: str | None = None, call: bool = False) -> Expression:
    """From the text, or from the label if the text tells nothing."""
    for candidate in dict.fromkeys(x for x in (text, label) if x is not None):
        if not (found := _parse_one(candidate, call)).empty:
            return found
    return Expression(is_call=call)
