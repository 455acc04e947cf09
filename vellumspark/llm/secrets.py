"""Secret scans: all rules compiled into one deterministic automaton that reads each byte of a text once.

Rules are regular expressions of a small language (literals, classes, groups, alternation, ``?``, ``*``, ``+``,
``{m}``, ``{m,}``, ``{m,n}``). They are compiled by subset construction over byte classes and minimised into flat
transition arrays. The forward automaton is unanchored and tells where a match of which rule first ends; a backward
automaton then gives its start, and an anchored one its longest end. Both touch only the bytes of a match.

Matches are leftmost, longest and do not overlap within a rule. For the rules here the longest match is also the one
that a backtracking engine finds, since no optional part can begin with a byte of what follows it. Spans are code
points of the text, ends exclusive.

Defined results: a null text is read as empty and has no spans; repeated documents give repeated rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    fold: bool = False
    #: Bytes that must follow the longest match of ``head`` (a pattern) at the start of a match.
    least: int = 0
    head: str = ""


_HEAD = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: Runs of hex digits are maximal, so asking for 24 of them in the pattern drops the same runs as asking afterwards.
BASE_RULES = (
    Rule("assign", _HEAD + "[A-Za-z0-9+/_.=-]+", fold=True, least=6, head=_HEAD),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Public prefixes of well-known credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN ((RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("cloud_api", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("payment", r"[sr]k_(live|test)_[A-Za-z0-9]+", least=24),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
)
ALL_RULES = BASE_RULES + MORE_RULES


# --- patterns to nondeterministic automata ---------------------------------------------------------------------


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1


class _Parser:
    """Recursive descent over a pattern; the tree is of ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, m, n)."""

    def __init__(self, pattern: str, fold: bool) -> None:
        self.text, self.at, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self) -> tuple:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self) -> tuple:
        part = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                bounds = self.text[self.at : (end := self.text.index("}", self.at))].split(",")
                self.at = end + 1
                low = int(bounds[0])
                high = low if len(bounds) == 1 else int(bounds[1]) if bounds[1] else None
            part = ("rep", part, low, high)
        return part

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def atom(self) -> tuple:
        c = self.peek()
        if c == "(":
            self.take()
            inner = self.alternatives()
            self.take()
            return inner
        if c == "[":
            self.take()
            found: set[int] = set()
            while self.peek() != "]":
                low = self.byte()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    found.update(range(low, self.byte() + 1))
                else:
                    found.add(low)
            self.take()
            return ("set", self.folded(found))
        return ("set", self.folded({self.byte()}))

    def folded(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = found | {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
        return frozenset(found)


def _build(nfa: _Nfa, tree: tuple, start: int, backward: bool) -> int:
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.moves[start].append((tree[1], end))
        return end
    if kind == "cat":
        for part in reversed(tree[1]) if backward else tree[1]:
            start = _build(nfa, part, start, backward)
        return start
    if kind == "or":
        end = nfa.state()
        for part in tree[1]:
            nfa.free[_build(nfa, part, start, backward)].append(end)
        return end
    _, part, low, high = tree
    for _ in range(low):
        start = _build(nfa, part, start, backward)
    if high is None:
        loop = nfa.state()
        nfa.free[start].append(loop)
        nfa.free[_build(nfa, part, loop, backward)].append(loop)
        return loop
    end = nfa.state()
    nfa.free[start].append(end)
    for _ in range(high - low):
        start = _build(nfa, part, start, backward)
        nfa.free[start].append(end)
    return end


# --- subset construction and minimisation ----------------------------------------------------------------------


@dataclass(frozen=True)
class Automaton:
    """``step[state + byte]`` is the next state (states are multiples of 256); from ``final`` on, states accept.

    ``accepts`` maps an accepting state to the numbers of its rules. A dead state, from which nothing is accepted, is -1.
    """

    step: list[int]
    start: int
    final: int
    accepts: dict[int, tuple[int, ...]]


def _closure(nfa: _Nfa, states: set[int]) -> frozenset[int]:
    todo, seen = list(states), set(states)
    while todo:
        for t in nfa.free[todo.pop()]:
            if t not in seen:
                seen.add(t)
                todo.append(t)
    return frozenset(seen)


def _byte_classes(nfa: _Nfa) -> list[int]:
    """A class number for every byte; bytes of a class lie in the same sets of moves."""
    sets = {s for moves in nfa.moves for s, _ in moves}
    names: dict[tuple, int] = {}
    return [names.setdefault(tuple(b in s for s in sets), len(names)) for b in range(256)]


def compile_rules(rules: tuple[Rule, ...], backward: bool = False, search: bool = False) -> Automaton:
    """One automaton for all rules, minimal up to the names of its states.

    For a search it starts anew at every byte, and a rule's matches stop at their first end.
    """
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for number, rule in enumerate(rules):
        begin = nfa.state()
        nfa.free[root].append(begin)
        end = _build(nfa, _Parser(rule.pattern, rule.fold).alternatives(), begin, backward)
        if search:
            nfa.moves[end], nfa.free[end] = [], []
        ends[end] = number
    classes = _byte_classes(nfa)
    one_of = {c: b for b, c in enumerate(classes)}
    first = _closure(nfa, {root})
    subsets, todo, table_ = {first: 0}, [first], []
    while todo:
        now = todo.pop(0)
        row = []
        for c in range(len(one_of)):
            reached = {t for s in now for found, t in nfa.moves[s] if one_of[c] in found}
            nxt = _closure(nfa, reached | ({root} if search else set()))
            if nxt not in subsets:
                subsets[nxt] = len(subsets)
                todo.append(nxt)
            row.append(subsets[nxt])
        table_.append(row)
    marks = [tuple(sorted(ends[s] for s in subset if s in ends)) for subset in subsets]
    # Refine by what is accepted and where each class leads, until no block splits.
    block = [list(dict.fromkeys(marks)).index(m) for m in marks]
    while True:
        names: dict[tuple, int] = {}
        finer = [names.setdefault((block[s], *(block[t] for t in table_[s])), len(names)) for s in range(len(table_))]
        if len(names) == len(set(block)):
            break
        block = finer
    kept: dict[int, int] = {}
    for s, b in enumerate(block):
        kept.setdefault(b, s)
    alive = {b for b, s in kept.items() if marks[s]}
    while more := {b for b, s in kept.items() if b not in alive and any(block[t] in alive for t in table_[s])}:
        alive |= more
    order = sorted(alive | {block[0]}, key=lambda b: (bool(marks[kept[b]]), b))
    place = {b: 256 * i for i, b in enumerate(order)}
    step = [place.get(block[table_[kept[b]][classes[x]]], -1) for b in order for x in range(256)]
    accepts = {place[b]: marks[kept[b]] for b in order if marks[kept[b]]}
    return Automaton(step, place[block[0]], min(accepts, default=256 * len(order)), accepts)


class Scanner:
    """The automata of a set of rules and the scan over one text."""

    def __init__(self, rules: tuple[Rule, ...] = ALL_RULES) -> None:
        self.rules = rules
        self.forward = compile_rules(rules, search=True)
        self.whole = [compile_rules((r,)) for r in rules]
        self.back = [compile_rules((r,), backward=True) for r in rules]
        self.heads = [compile_rules((Rule(r.kind, r.head, r.fold),)) if r.head else None for r in rules]

    def _longest(self, a: Automaton, data: bytes, places: range) -> int:
        """Bytes of the longest accepted run over the places, taken in their order."""
        state, step, final, best = a.start, a.step, a.final, 0
        for n, i in enumerate(places, 1):
            state = step[state + data[i]]
            if state < 0:
                break
            if state >= final:
                best = n
        return best

    def _holds(self, r: int, data: bytes, start: int, end: int) -> bool:
        head = self._longest(self.heads[r], data, range(start, end)) if self.heads[r] else 0
        return end - start - head >= self.rules[r].least

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, number of the rule) in bytes, by start and then by rule."""
        step, final, accepts = self.forward.step, self.forward.final, self.forward.accepts
        state, found, free = self.forward.start, [], [0] * len(self.rules)
        for i, b in enumerate(data):
            state = step[state + b]
            if state >= final:
                for r in accepts[state]:
                    if i < free[r]:
                        continue
                    back = self._longest(self.back[r], data, range(i, free[r] - 1, -1))
                    if not back:
                        continue
                    start = i + 1 - back
                    free[r] = end = start + self._longest(self.whole[r], data, range(start, len(data)))
                    if self._holds(r, data, start, end):
                        found.append((start, end, r))
        return sorted(found, key=lambda x: (x[0], x[2]))


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points; what lies between two borders is decoded once."""
    if not spans or data.isascii():
        return spans
    places, last, n = {}, 0, 0
    for at in sorted({x for a, b, _ in spans for x in (a, b)}):
        n += len(data[last:at].decode("utf-8", "surrogatepass"))
        places[at], last = n, at
    return [(places[a], places[b], r) for a, b, r in spans]


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
)
_DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_scanners: dict[tuple, Scanner] = {}


def _scan(rules: tuple[Rule, ...]):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rules not in _scanners:
            _scanners[rules] = Scanner(rules)
        scanner = _scanners[rules]
        base = {r.kind for r in BASE_RULES}
        for batch in source:
            columns: list[list] = [[] for _ in _OUT]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                named = [(rules[r].kind, a, b) for a, b, r in code_points(data, scanner.spans(data))]
                kinds = [k for k, _, _ in named]
                own = ",".join(f"{k}:{a}:{b}" for k, a, b in named if k in base)
                for held, value in zip(columns, (doc, *(kinds.count(r.kind) for r in BASE_RULES), hashlib.sha256(own.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in named)), strict=True):
                    held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, and all spans."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(rules), _DDL)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """SQL for all rules: the places of matches follow from the lengths of the matches and of the gaps between them."""
    parts, keep = [], []
    for i, rule in enumerate(ALL_RULES):
        pattern, head = rule.pattern, rule.head
        if rule.fold:
            pattern, head = (_either_case(x) for x in (pattern, head))
        quoted = pattern.replace("'", "''")
        parts.append(f"SELECT k, '{rule.kind}' AS kind, {i} AS o, string_split_regex(t, '{quoted}') AS g, regexp_extract_all(t, '{quoted}') AS m FROM d")
        rest = f"len(regexp_replace(x, '{('^' + head).replace(chr(39), chr(39) * 2)}', ''))" if head else "len(x)"
        keep.append(f"WHEN '{rule.kind}' THEN {rest} >= {rule.least}")
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    joined = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),
m AS ({" UNION ALL ".join(parts)}),
s AS (SELECT k, kind, o, m[i] AS x, list_sum(list_transform(g[1:i], lambda y: len(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: len(y))), 0) AS a FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
f AS (SELECT k, kind, o, CAST(a AS BIGINT) AS a, CAST(a + len(x) AS BIGINT) AS b FROM s WHERE CASE kind {" ".join(keep)} END),
n AS (SELECT k, {counts}, {joined} FILTER (kind IN ({base})) AS own, {joined} AS spans FROM f GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n USING (k)
"""


def _either_case(pattern: str) -> str:
    """ASCII letters outside classes and escapes in either case."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            step = 4 if pattern[at + 1] == "x" else 2
            out.append(pattern[at : at + step])
            at += step
            continue
        inside = c == "[" or inside and c != "]"
        out.append(f"[{c.lower()}{c.upper()}]" if c.isalpha() and not inside else c)
        at += 1
    return "".join(out)


ORACLE = _oracle()
