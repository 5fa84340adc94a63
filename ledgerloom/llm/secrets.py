"""Secret scanning with one deterministic automaton for all rules.

The rules' regexes are compiled together: a Thompson construction gives one non-deterministic automaton,
subset construction makes it deterministic over classes of bytes that no rule tells apart, and partition
refinement minimises it into a transition array. Each state is tagged with the rules that it accepts. Two
arrays come from one construction:

* The backward one reads the rules' mirror images from the end of the text and may begin anywhere. Behind
  each byte its state tells which rules have a match that starts there. It runs over every byte once, all
  rules at once, many stretches of text in step: each stretch is first read from the start state, then again
  from the state that the stretch behind it ends in, as far as the two readings differ. So a text without
  any break is read as fast as any other.
* The forward one begins at a start that the backward one found and gives that match's end, the last byte
  at which its rule accepts. A rule's next match is the first start from there on.

A match that is too short is dropped with all that it covers.

Defined results: null or empty text has no spans; spans are code points with an exclusive end; each kind
is leftmost, longest and non-overlapping by itself, while kinds may overlap each other; repeated documents
are scanned row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, utf8

BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rule:
    """`pattern` finds matches. Those count that accept on `tail` bytes or more: of a pattern that ends in a repeated
    class, its length. (Counted tails in patterns would multiply the states where they run side by side.)"""

    kind: str
    pattern: str
    tail: int = 1


_KEYWORD = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"

RULES = (
    Rule("assign", _KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", 6),
    # Shorter runs of these two hold no longer match, so that leaving them out drops the same.
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]+", 36),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 10),
    Rule("google", "AIza[0-9A-Za-z_-]+", 35),
    Rule("stripe", "[rs]k_live_[0-9A-Za-z]+", 16),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 8),
    Rule("pem", "-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
)


class _Nfa:
    """Edges on sets of bytes and empty edges; states are numbers."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, nodes, start: int) -> int:
        """Append what the parsed regex matches, from a state on; returns the state it ends in."""
        for op, arg in nodes:
            if op is sre.LITERAL:
                start = self._byte(start, frozenset([arg]))
            elif op is sre.IN:
                start = self._byte(start, frozenset(self._members(arg)))
            elif op is sre.SUBPATTERN:
                start = self.add(arg[-1], start)
            elif op is sre.BRANCH:
                end = self.state()
                for option in arg[1]:
                    self.empty[self.add(option, start)].append(end)
                start = end
            elif op is sre.MAX_REPEAT:
                least, most, body = arg
                for _ in range(least):
                    start = self.add(body, start)
                if most is sre.MAXREPEAT:
                    loop = self.state()
                    self.empty[start].append(loop)
                    self.empty[self.add(body, loop)].append(loop)
                    start = loop
                else:
                    end = self.state()
                    self.empty[start].append(end)
                    for _ in range(most - least):
                        start = self.add(body, start)
                        self.empty[start].append(end)
                    start = end
            else:
                raise ValueError(f"{op} can't be compiled")
        return start

    def _byte(self, start: int, members: frozenset[int]) -> int:
        end = self.state()
        self.edges[start].append((members, end))
        return end

    @staticmethod
    def _members(items):
        for op, arg in items:
            if op is sre.LITERAL:
                yield arg
            elif op is sre.RANGE:
                yield from range(arg[0], arg[1] + 1)
            else:
                raise ValueError(f"{op} in a class can't be compiled")

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def mirrored(self) -> _Nfa:
        out = _Nfa()
        for _ in self.edges:
            out.state()
        for s, (edges, empty) in enumerate(zip(self.edges, self.empty, strict=True)):
            for members, t in edges:
                out.edges[t].append((members, s))
            for t in empty:
                out.empty[t].append(s)
        return out


@dataclass(frozen=True)
class Automaton:
    """next_state[state + class_of[byte]] is the next state, both premultiplied by n_classes; states from `accepting` on
    accept. accepts and alive (by state / n_classes): bits of the rules that it accepts, and that may still accept."""

    class_of: np.ndarray
    next_state: np.ndarray
    accepts: np.ndarray
    alive: np.ndarray
    accepting: int
    start: int
    n_classes: int


def compile_rules(rules=RULES) -> tuple[Automaton, Automaton]:
    """The forward automaton of the rules, and the backward one."""
    nfa, owner = _Nfa(), []
    roots, finals = [], []
    for k, rule in enumerate(rules):
        roots.append(nfa.state())
        finals.append(nfa.add(sre_parser.parse(rule.pattern), roots[-1]))
        owner += [k] * (len(nfa.edges) - len(owner))
    return _deterministic(nfa, owner, roots, finals, False), _deterministic(nfa.mirrored(), owner, finals, roots, True)


def _deterministic(nfa: _Nfa, owner: list[int], begins: list[int], ends: list[int], anywhere: bool) -> Automaton:
    """Subset construction from the states `begins`, which are in every set if a match may begin anywhere."""
    # Bytes that lie in the same sets of edges are one class; class 0 holds those of no edge.
    sets = sorted({members for edges in nfa.edges for members, _ in edges}, key=sorted)
    order = {tuple([False] * len(sets)): 0}
    class_of = np.array([order.setdefault(tuple(b in s for s in sets), len(order)) for b in range(256)], dtype=np.uint8)
    n_classes, sample = len(order), {int(c): b for b, c in enumerate(class_of)}
    start, end_rule = nfa.closure(begins), {s: k for k, s in enumerate(ends)}
    moves = [[nfa.closure([t for members, t in edges if sample.get(c, -1) in members]) for c in range(n_classes)] for edges in nfa.edges]
    number, table, accepts, alive, todo = {start: 0}, [], [], [], [start]
    while todo:
        states = todo.pop()
        row = []
        for c in range(n_classes):
            target = frozenset().union(start if anywhere else (), *[moves[s][c] for s in states])
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        bits = sum(1 << k for s, k in end_rule.items() if s in states)
        table.append((number[states], row, bits, sum({1 << owner[s] for s in states})))
    _, table, accepts, alive = (np.array(x, dtype=np.int64) for x in zip(*sorted(table), strict=True))
    return _minimised(table, accepts, alive, class_of, n_classes)


def _minimised(table: np.ndarray, accepts: np.ndarray, alive: np.ndarray, class_of: np.ndarray, n_classes: int) -> Automaton:
    """States with the same rules and successors fall together; those that accept nothing get the low numbers."""
    block, n = np.unique(np.stack((accepts, alive)), axis=1, return_inverse=True)[1].reshape(-1), 0
    while True:
        known: dict[bytes, int] = {}
        rows = np.column_stack((block, block[table])).astype(np.int32)
        block = np.array([known.setdefault(row.tobytes(), len(known)) for row in rows])
        if len(known) == n:
            break
        n = len(known)
    first = np.unique(block, return_index=True)[1]
    order = np.argsort(accepts[first] > 0, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    at = first[order]
    small = (rank[block[table[at]]] * n_classes).astype(np.int32).reshape(-1)
    return Automaton(class_of, small, accepts[at], alive[at], int((accepts[at] == 0).sum()) * n_classes, int(rank[block[0]]) * n_classes, n_classes)


#: Bytes that are read at once, the length of the stretches in which they are, and how many of those are too few for arrays.
BLOCK, STRETCH, FEW = 1 << 20, 256, 16


def _states(backward: Automaton, data: np.ndarray, state: int) -> np.ndarray:
    """The states behind each byte of data when it is read from its end, from a state on."""
    n = -(-len(data) // STRETCH)
    pad = n * STRETCH - len(data)
    codes = np.zeros(n * STRETCH, dtype=np.uint8)
    codes[pad:] = backward.class_of[data]
    codes = np.ascontiguousarray(codes.reshape(n, STRETCH).T)
    out, at = np.empty((STRETCH, n), dtype=np.int32), np.full(n, backward.start, dtype=np.int32)
    at[-1] = state
    for t in reversed(range(STRETCH)):
        at = backward.next_state[at + codes[t]]
        out[t] = at
    # Each stretch again from the state that the next one left, until both readings agree.
    changed = np.arange(1, n)
    while len(changed) > FEW:
        active = changed - 1
        at, known = out[0, changed], None
        for t in reversed(range(STRETCH)):
            at = backward.next_state[at + codes[t, active]]
            known = at != out[t, active]
            if not known.all():
                active, at = active[known], at[known]
                if not len(active):
                    break
            out[t, active] = at
        changed = active[active > 0]
    states = out.T.reshape(-1)
    # A few that differ over many stretches: one after the other, byte by byte.
    for i in sorted((changed * STRETCH - 1).tolist(), reverse=True):
        state = int(states[i + 1])
        while i >= 0 and (state := int(backward.next_state[state + int(codes[i % STRETCH, i // STRETCH])])) != states[i]:
            states[i] = state
            i -= 1
    return states[pad:]


def starts_of(backward: Automaton, data: np.ndarray, n_rules: int) -> list[list[int]]:
    """For each rule the positions in data (bytes) at which a match of it starts."""
    found: list[list[np.ndarray]] = [[] for _ in range(n_rules)]
    state = backward.start
    for end in range(len(data), 0, -BLOCK):
        begin = max(0, end - BLOCK)
        states = _states(backward, data[begin:end], state)
        state = int(states[0])
        hits = np.flatnonzero(states >= backward.accepting)
        bits = backward.accepts[states[hits] // backward.n_classes]
        for k in range(n_rules):
            found[k].append(hits[(bits >> k & 1).astype(bool)] + begin)
    return [np.concatenate(x[::-1]).tolist() if x else [] for x in found]


class Scanner:
    """The two automata of the rules, and what they find in a run of bytes."""

    def __init__(self, rules, automata: tuple[Automaton, Automaton]) -> None:
        self.rules, (forward, self.backward) = rules, automata
        self.start, self.n_classes = forward.start, forward.n_classes
        self.class_of, self.next_state, self.accepts, self.alive = (x.tolist() for x in (forward.class_of, forward.next_state, forward.accepts, forward.alive))

    def _match(self, data: bytes, k: int, at: int) -> tuple[int, int]:
        """From a start of rule k: the ends of its shortest and of its longest match."""
        state, first, last = self.start, -1, -1
        for at in range(at, len(data)):
            state = self.next_state[state + self.class_of[data[at]]]
            row = state // self.n_classes
            if self.accepts[row] >> k & 1:
                last = at + 1
                first = first if first >= 0 else last
            elif not self.alive[row] >> k & 1:
                break
        return first, last

    def scan(self, data: bytes):
        """Start, rule and end (bytes) of the matches that count, in order."""
        out = []
        for k, starts in enumerate(starts_of(self.backward, np.frombuffer(data, dtype=np.uint8), len(self.rules))):
            i = 0
            while i < len(starts):
                first, last = self._match(data, k, starts[i])
                if last - first + 1 >= self.rules[k].tail:
                    out.append((starts[i], k, last))
                i = bisect_left(starts, last, i + 1)
        return sorted(out)


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: doc_id and spans, an array of kind, start and end by start, then by the rules' order."""
    shared = docs.sparkSession.sparkContext.broadcast(compile_rules(rules))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches):
        scanner = Scanner(rules, shared.value)
        for batch in arrow_batches(batches):
            texts = utf8(batch.column(1))
            # A zero byte, which is in no rule, ends each text.
            offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
            found: list[list] = [[] for _ in texts]
            for s, k, e in scanner.scan(b"\0".join(texts) + b"\0"):
                i = int(np.searchsorted(offsets, s, side="right")) - 1
                found[i].append((s - int(offsets[i]), k, e - int(offsets[i])))
            out = []
            for text, spans in zip(texts, found, strict=True):
                if spans:
                    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
                    spans = [{"kind": rules[k].kind, "start": int(points[s]), "end": int(points[e])} for s, k, e in spans]
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], ["doc_id", "spans"])

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return frame.mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(found: DataFrame, kinds) -> DataFrame:
    """Counts by base kind, the hash of the base spans, and all spans."""
    def of(*names: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*names))

    base, counts = of(*kinds), [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


# The base rules as they are stated, for tests.
BASE_PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def brute_force(text: str | None) -> list[tuple[int, str, int]]:
    """The base spans of a text (start, kind, end), by plain search; for tests."""
    out = []
    for k, (kind, pattern) in enumerate(BASE_PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(s, kind, e) for s, _, kind, e in sorted(out)]
