"""Secret scans: all rules in one deterministic automaton, one table look-up for each byte.

Each rule's regular expression becomes an automaton that imitates a leftmost, non-overlapping search: its state is the
list of NFA state sets by start position, earlier starts first; once the leftmost start has matched, later starts are
dropped, and when that match can't go on the automaton reports it and starts anew at the same byte. The product of all
rules' automata is built by subset construction over byte classes, minimised by partition refinement and laid out as one
flat transition list. A match's start is found by running the reversed rule backwards from its end, which costs the
length of the match.

A null text counts as empty and has no spans. Texts are scanned whole, whatever their length; equal texts get equal spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import map_texts, utf8


@dataclass(frozen=True)
class Rule:
    """head: what of a match stands before its value; least: the characters that the value must have. Lengths are checked after the scan, as a counter in one rule multiplies the states of the others."""

    kind: str
    pattern: str
    head: str = ""
    least: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join([*(either_case(w) for w in ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
_VALUE = "[A-Za-z0-9+/_.=-]"

#: The rules whose spans the digest columns count.
BASE = (
    Rule("assign", rf"(?:{_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?{_VALUE}+", r"[^:=]*[:=]\x20*[\"']?", 8),
    Rule("access", r"AKIA[A-Z0-9]+", "AKIA", 12),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: What the operator finds beyond them.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opsur]_[A-Za-z0-9]+", "gh[opsur]_", 36),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-", 10),
)
RULES = BASE + MORE

# ---- regular expression to NFA -----------------------------------------------------------------------------------


class _Nfa:
    """Thompson's construction over bytes; the patterns are ASCII."""

    def __init__(self, pattern: str, backwards: bool = False):
        self.eps: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.backwards = backwards
        self.start = self._state()
        self.accept = self._sequence(re._parser.parse(pattern), self.start)

    def _state(self) -> int:
        self.eps.append([])
        self.moves.append(None)
        return len(self.eps) - 1

    def _sequence(self, items, at: int) -> int:
        for op, arg in reversed(list(items)) if self.backwards else items:
            at = self._item(str(op), arg, at)
        return at

    def _item(self, op: str, arg, at: int) -> int:
        if op in ("LITERAL", "IN"):
            out = self._state()
            step = self._state()
            self.eps[at].append(step)
            self.moves[step] = (frozenset([arg]) if op == "LITERAL" else self._members(arg), out)
            return out
        if op == "SUBPATTERN":
            return self._sequence(arg[-1], at)
        if op == "BRANCH":
            out = self._state()
            for branch in arg[1]:
                begin = self._state()
                self.eps[at].append(begin)
                self.eps[self._sequence(branch, begin)].append(out)
            return out
        if op == "MAX_REPEAT":
            least, most, body = arg
            for _ in range(least):
                at = self._sequence(body, at)
            if str(most) == "MAXREPEAT":
                loop = self._state()
                self.eps[at].append(loop)
                self.eps[self._sequence(body, loop)].append(loop)
                return loop
            out = self._state()
            self.eps[at].append(out)
            for _ in range(most - least):
                at = self._sequence(body, at)
                self.eps[at].append(out)
            return out
        raise ValueError(f"secret rules don't support {op}")

    @staticmethod
    def _members(items) -> frozenset[int]:
        out: set[int] = set()
        for op, arg in items:
            if str(op) == "LITERAL":
                out.add(arg)
            elif str(op) == "RANGE":
                out.update(range(arg[0], arg[1] + 1))
            else:
                raise ValueError(f"secret rules don't support {op} in a class")
        return frozenset(out)

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if self.moves[s] or s == self.accept)

    def step(self, states, byte: int) -> frozenset[int]:
        return self.closure({self.moves[s][1] for s in states if self.moves[s] and byte in self.moves[s][0]})


def byte_classes(nfas) -> tuple[list[int], list[int]]:
    """For each byte its class, and for each class one of its bytes: bytes that no rule tells apart share a class."""
    sets = sorted({m[0] for n in nfas for m in n.moves if m}, key=sorted)
    names: dict[tuple, int] = {}
    of = [names.setdefault(tuple(b in s for s in sets), len(names)) for b in range(256)]
    return of, [of.index(c) for c in range(len(names))]


class _Search:
    """One rule's leftmost, non-overlapping search; a state is a tuple of NFA state sets, one for each live start."""

    def __init__(self, nfa: _Nfa):
        self.nfa, self.begin = nfa, nfa.closure([nfa.start])

    def accepts(self, state) -> bool:
        return bool(state) and self.nfa.accept in state[0]

    def step(self, state, byte: int):
        """The next state, and whether a match ended before this byte."""
        if self.accepts(state):
            on = self.nfa.step(state[0], byte)
            if on:
                if self.nfa.accept not in on:
                    raise ValueError("a rule must not leave acceptance and go on")
                return (on,), False
            return self.step((), byte)[0], True
        out, seen = [], set()
        for group in (*state, self.begin):
            left = self.nfa.step(group, byte) - seen
            if not left:
                continue
            out.append(frozenset(left))
            seen |= left
            if self.nfa.accept in left:
                if len(out) > 1:
                    raise ValueError("a rule must not match inside a longer candidate of its own")
                break
        return tuple(out), False


class Automaton:
    """The combined scanner. table[state | byte] is the next state, states being multiples of 256; from first_event on, entering a state reports the rules in events[state]."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        nfas = [_Nfa(r.pattern) for r in rules]
        of, example = byte_classes(nfas)
        searches = [_Search(n) for n in nfas]
        first = (tuple(() for _ in rules), ())
        number, todo, rows = {first: 0}, [first], []
        while todo:
            states, _ = todo.pop(0)
            row = []
            for byte in example:
                stepped = [s.step(x, byte) for s, x in zip(searches, states, strict=True)]
                after = (tuple(x for x, _ in stepped), tuple(k for k, (_, ended) in enumerate(stepped) if ended))
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row.append(number[after])
            rows.append(row)
        made = list(number)
        at_end = [tuple(k for k, (s, x) in enumerate(zip(searches, states, strict=True)) if s.accepts(x)) for states, _ in made]
        keys = [(made[i][1], at_end[i]) for i in range(len(made))]
        block, trans = self._minimise(np.array(rows), keys)
        n = block.max() + 1
        kept = [int(np.flatnonzero(block == b)[0]) for b in range(n)]
        order = sorted(range(n), key=lambda b: (bool(keys[kept[b]][0]), b != block[0]))
        place = {b: i for i, b in enumerate(order)}
        self.n_built, self.n_states = len(made), n
        self.table = [place[int(trans[b][of[byte]])] << 8 for b in order for byte in range(256)]
        self.events = {place[b] << 8: keys[kept[b]][0] for b in order if keys[kept[b]][0]}
        self.at_end = {place[b] << 8: keys[kept[b]][1] for b in order if keys[kept[b]][1]}
        self.first_event = min(self.events, default=n << 8)
        self.backwards = [self._backwards(_Nfa(r.pattern, backwards=True)) for r in rules]
        self.heads = [re.compile(r.head.encode()) for r in rules]

    @staticmethod
    def _minimise(rows: np.ndarray, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """Moore's refinement: start from what states report, split blocks until transitions agree."""
        names: dict = {}
        block = np.array([names.setdefault(k, len(names)) for k in keys])
        while True:
            _, split = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)
            split = split.reshape(-1)
            if split.max() == block.max():
                break
            block = split
        trans = np.zeros((block.max() + 1, rows.shape[1]), int)
        trans[block] = block[rows]
        return block, trans

    @staticmethod
    def _backwards(nfa: _Nfa) -> tuple[list[int], set[int]]:
        """The reversed rule, anchored: flat table with -1 where no state is left, and the accepting states."""
        of, example = byte_classes([nfa])
        first = nfa.closure([nfa.start])
        number, todo, rows = {first: 0}, [first], []
        while todo:
            state = todo.pop(0)
            row = []
            for byte in example:
                after = nfa.step(state, byte)
                if after and after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row.append(number[after] << 8 if after else -1)
            rows.append(row)
        return [row[of[b]] for row in rows for b in range(256)], {i << 8 for s, i in number.items() if nfa.accept in s}

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, sorted; a match with too short a value is left out but still takes its place."""
        table, first_event, state = self.table, self.first_event, 0
        hits: list[tuple[int, int]] = []
        for i, byte in enumerate(data):
            state = table[state | byte]
            if state >= first_event:
                hits.append((i, state))
        ended = [(i, k) for i, s in hits for k in self.events[s]] + [(len(data), k) for k in self.at_end.get(state, ())]
        since, out = [0] * len(self.rules), []
        for end, k in ended:
            start = self._start(data, end, since[k], k)
            since[k] = end
            if end - self.heads[k].match(data, start, end).end() >= self.rules[k].least:
                out.append((start, end, k))
        return sorted(out, key=lambda x: (x[0], x[2]))

    def _start(self, data: bytes, end: int, least: int, k: int) -> int:
        table, accepting = self.backwards[k]
        state, found = 0, end
        for i in range(end - 1, least - 1, -1):
            state = table[state | data[i]]
            if state < 0:
                break
            if state in accepting:
                found = i
        return found


@lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...] = RULES) -> Automaton:
    return Automaton(rules)


def text_spans(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, end, rule) in code points."""
    found = automaton(rules).spans(data)
    if not found or data.isascii():
        return found
    begins = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(begins[a]), int(begins[b]), k) for a, b, k in found]


def find_secrets(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keep, and secrets: array of structs kind, start, end in code points (end exclusive), ordered by start and then by the rules' order. Null and empty texts have an empty array."""
    kinds = [r.kind for r in rules]

    def compute(part: pa.RecordBatch) -> dict:
        found = [[{"kind": kinds[k], "start": a, "end": b} for a, b, k in text_spans(x, rules)] for x in utf8(part)]
        return {c: part.column(c) for c in keep} | {"secrets": found}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_texts(docs, keep, compute, f"{schema}, secrets array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret replaced by its kind in angle brackets and n_chars, if there, counted anew; overlapping secrets become one mark, of the first one's kind. Null texts stay null; other columns and all rows stay."""
    names = docs.columns
    kinds = [r.kind for r in rules]

    def compute(part: pa.RecordBatch) -> dict:
        texts = part.column("text").to_pylist()
        out = []
        for text, data in zip(texts, utf8(part), strict=True):
            if text is None or not (found := text_spans(data, rules)):
                out.append(text)
                continue
            made, at = [], 0
            for a, b, k in found:
                if a >= at:
                    made += [text[at:a], f"<{kinds[k]}>"]
                at = max(at, b)
            out.append("".join(made) + text[at:])
        return {c: part.column(c) for c in names if c != "text"} | {"text": out}

    rest = [c for c in names if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest, "text").schema)
    out = map_texts(docs, rest, compute, schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return out.select(*names)


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the hash of their joined spans, and all spans joined."""
    found = find_secrets(docs, ["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
