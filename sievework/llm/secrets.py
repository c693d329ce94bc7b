"""Secrets by one deterministic automaton for all rules.

The regexes are compiled to an automaton of the reversed patterns by subset
construction, minimised, and stored as one transition array over byte classes.
One pass over the bytes, from the end of each text to its beginning, then gives
for every position the rules that match from there.  Many stretches of text
advance together, one byte a step: texts are cut behind bytes after which the
automaton is in one and the same state wherever it was before; the few longest
stretches go one by one.  From the starts, the forward automaton of the rule
finds the longest match; runs that leave its state as it is are taken at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as code
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import texts

#: Bytes of text that one scan takes in together.
BLOCK = 4 << 20
#: Fewer stretches than this are read one after the other, since a step over arrays then costs more.
FEW = 16
#: Bytes in one state after which the end of the run is searched.
LOOP = 8


@dataclass(frozen=True)
class SecretRule:
    """A regex over ASCII; a match counts if ``group`` (0: all of it) has at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The rules that every scan has.
BASE = (
    SecretRule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # The same runs as with +, but only those that are long enough have a start.
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further kinds: key blocks, tokens with a fixed opening, signed web tokens, passwords within addresses.
MORE = (
    SecretRule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("git_token", r"gh[oprsu]_[A-Za-z0-9]+", 0, 24),
    SecretRule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    SecretRule("url_password", r"[a-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._!$-]+@", 0, 12),
)


class _Nfa:
    """Fragments of a pattern over sets of bytes; ``backwards`` builds the reversed language."""

    def __init__(self, backwards: bool):
        self.backwards = backwards
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def sequence(self, items, at: int, flags: int) -> int:
        for item in reversed(list(items)) if self.backwards else items:
            at = self.item(item, at, flags)
        return at

    def item(self, item, at: int, flags: int) -> int:
        kind, value = item
        if kind in (code.LITERAL, code.NOT_LITERAL, code.IN, code.ANY):
            to = self.state()
            self.moves[at].append((_bytes_of(kind, value, flags), to))
            return to
        if kind is code.SUBPATTERN:
            _, more, fewer, inner = value
            return self.sequence(inner, at, (flags | more) & ~fewer)
        if kind is code.BRANCH:
            end = self.state()
            for branch in value[1]:
                self.empty[self.sequence(branch, at, flags)].append(end)
            return end
        if kind is code.MAX_REPEAT:
            least, most, inner = value
            for _ in range(least):
                at = self.sequence(inner, at, flags)
            if most is code.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.empty[at].append(loop)
                self.empty[self.sequence(inner, loop, flags)].append(loop)
                self.empty[loop].append(end)
                return end
            ends = [at]
            for _ in range(most - least):
                ends.append(at := self.sequence(inner, at, flags))
            end = self.state()
            for e in ends:
                self.empty[e].append(end)
            return end
        raise ValueError(f"{kind} cannot be compiled to an automaton")


def _bytes_of(kind, value, flags: int) -> frozenset:
    if kind is code.ANY:
        return frozenset(range(256)) - {10}
    if kind is code.IN:
        out, items = set(), list(value)
        negated = items[0][0] is code.NEGATE
        for k, v in items[negated:]:
            if k is code.RANGE:
                out |= set(range(v[0], v[1] + 1))
            elif k is code.LITERAL:
                out.add(v)
            else:
                raise ValueError(f"{k} cannot be compiled to an automaton")
    else:
        out, negated = {value}, kind is code.NOT_LITERAL
    if flags & re.IGNORECASE.value:
        out |= {b ^ 32 for b in out if 65 <= b <= 90 or 97 <= b <= 122}
    return frozenset(range(256)) - out if negated else frozenset(out)


@dataclass
class Automaton:
    """``step[state * n_classes + byte_class[byte]]`` is the next state, ``accepts[state]`` a bit for each rule."""

    byte_class: np.ndarray
    n_classes: int
    step: np.ndarray
    accepts: np.ndarray
    start: int

    def resets(self) -> np.ndarray:
        """Bytes after which the state does not depend on the one before."""
        table = self.step.reshape(-1, self.n_classes)
        return (table == table[0]).all(axis=0)[self.byte_class]

    def rows(self) -> list[list[int]]:
        """The transitions as plain lists, which single steps read faster."""
        return self.step.reshape(-1, self.n_classes).tolist()

    def classes(self, raw: bytes) -> bytes:
        return raw.translate(bytes(self.byte_class.tolist()))


class _Runner:
    """Longest matches of one rule in a block; in a state that stays as it is, a run of bytes is one step."""

    def __init__(self, a: Automaton):
        self.a, self.rows, self.accepts = a, a.rows(), (a.accepts > 0).tolist()
        stays = a.step.reshape(-1, a.n_classes) == np.arange(len(a.accepts))[:, None]
        self.dead = (stays.all(axis=1) & (a.accepts == 0)).tolist()
        self.stays, self.which = np.unique(stays, axis=0, return_inverse=True)
        self.which = [int(w) if self.stays[w].any() else -1 for w in self.which.reshape(-1)]

    def load(self, data: np.ndarray, raw: bytes) -> None:
        self.data, self.bytes, self.leaves = data, self.a.classes(raw), {}

    def _run_end(self, which: int, at: int) -> int:
        """The first place from ``at`` on whose byte leaves the state."""
        if which not in self.leaves:
            self.leaves[which] = np.flatnonzero(~self.stays[which][self.a.byte_class][self.data])
        leaves = self.leaves[which]
        i = int(np.searchsorted(leaves, at))
        return int(leaves[i]) if i < len(leaves) else len(self.data)

    def longest(self, at: int, stop: int) -> int:
        """The end of the longest match from ``at``, -1 without one."""
        rows, accepts, dead, which, classes = self.rows, self.accepts, self.dead, self.which, self.bytes
        state, end, stayed = self.a.start, -1, 0
        while at < stop:
            to = rows[state][classes[at]]
            at += 1
            stayed = stayed + 1 if to == state else 0
            state = to
            if stayed == LOOP and which[state] >= 0:
                at, stayed = max(at, min(stop, self._run_end(which[state], at))), 0
            if accepts[state]:
                end = at
            elif dead[state]:
                break
        return end


def compile_rules(regexes: Sequence[str], backwards: bool, anywhere: bool) -> Automaton:
    """One minimal automaton for all patterns; ``anywhere`` lets matches begin at every byte."""
    nfa = _Nfa(backwards)
    root = nfa.state()
    final: dict[int, int] = {}
    for k, regex in enumerate(regexes):
        first = nfa.state()
        nfa.empty[root].append(first)
        final[nfa.sequence(_parser.parse(regex.encode()), first, 0)] = 1 << k
    # Bytes that no pattern tells apart form a class.
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    _, byte_class = np.unique(np.array([[b in s for s in sets] for b in range(256)]), axis=0, return_inverse=True)
    byte_class = byte_class.reshape(-1)
    n_classes = int(byte_class.max()) + 1
    classes = [{int(byte_class[b]) for b in s} for s in sets]
    by_set = dict(zip(sets, classes))

    def closed(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for to in nfa.empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    begin = closed([root])
    numbers, todo, rows = {begin: 0}, [begin], []
    while todo:
        own = todo.pop(0)
        targets: list[set[int]] = [set() for _ in range(n_classes)]
        for s in own:
            for chars, to in nfa.moves[s]:
                for c in by_set[chars]:
                    targets[c].add(to)
        row = []
        for c in range(n_classes):
            to = closed(targets[c] | ({root} if anywhere else set()))
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append(numbers[to])
        rows.append(row)
    step = np.array(rows, np.int64)
    accepts = np.array([sum(final.get(s, 0) for s in own) for own in numbers], np.int64)
    # Minimise: split groups of states until all members of each go to the same groups.
    group = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack((group, group[step])), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    first = np.unique(group, return_index=True)[1]
    return Automaton(byte_class.astype(np.int64), n_classes, group[step[first]].reshape(-1), accepts[first], int(group[0]))


class Scanner:
    """Finds the spans of all rules in a block of texts."""

    def __init__(self, rules: Sequence[SecretRule]):
        self.rules = list(rules)
        self.back = compile_rules([r.regex for r in rules], True, True)
        self.ahead = [_Runner(compile_rules([r.regex], False, False)) for r in rules]
        self.back_rows, self.back_accepts = self.back.rows(), self.back.accepts.tolist()
        self.exact = [re.compile(r.regex.encode()) for r in rules]

    def starts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, rule bits) where matches begin, by one pass over the bytes."""
        a = self.back
        ends = np.unique(np.concatenate((np.flatnonzero(a.resets()[data]) + 1, offs[1:])))
        ends = ends[ends > 0]
        if not len(ends):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.diff(ends, prepend=0)
        order = np.argsort(-lengths, kind="stable")
        ends, lengths = ends[order], lengths[order]
        classes = a.byte_class[data]
        states = np.full(len(ends), a.start, np.int64)
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # stretches longer than each step's number
        hits, bits = [], []
        begins = a.accepts > 0
        wide = int(np.count_nonzero(active >= FEW))
        for j, n in enumerate(active[:wide].tolist()):
            at = ends[:n] - (j + 1)
            now = a.step[states[:n] * a.n_classes + classes[at]]
            states[:n] = now
            hot = np.flatnonzero(begins[now])
            if len(hot):
                hits.append(at[hot])
                bits.append(a.accepts[now[hot]])
        if wide < len(active):
            for i in range(int(active[wide])):  # the few longest stretches, one after the other
                first, last = int(ends[i] - lengths[i]), int(ends[i]) - wide
                found = self._walk(a.classes(data[first:last].tobytes()), int(states[i]))
                if len(found[0]):
                    hits.append(last - 1 - found[0])
                    bits.append(found[1])
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hits, bits = np.concatenate(hits), np.concatenate(bits)
        order = np.argsort(hits, kind="stable")
        return hits[order], bits[order]

    def _walk(self, classes: bytes, state: int) -> tuple[np.ndarray, np.ndarray]:
        """(bytes from the end, rule bits) where matches begin in one stretch, read backwards."""
        rows, accepts = self.back_rows, self.back_accepts
        hits, bits = [], []
        for j, c in enumerate(reversed(classes)):
            state = rows[state][c]
            if accepts[state]:
                hits.append(j)
                bits.append(accepts[state])
        return np.array(hits, np.int64), np.array(bits, np.int64)

    def spans(self, data: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Per text (rule number, start, end) in bytes, by rule leftmost and not overlapping, ordered by start and rule."""
        hits, bits = self.starts(data, offs)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offs) - 1)]
        if not len(hits):
            return out
        raw, rows = data.tobytes(), texts.owners(offs, hits)
        bounds = offs.tolist()
        for k, rule in enumerate(self.rules):
            own = np.flatnonzero(bits >> k & 1)
            places, owners = hits[own], rows[own]
            self.ahead[k].load(data, raw)
            i = 0
            while i < len(places):
                at, row = int(places[i]), int(owners[i])
                end = self.ahead[k].longest(at, bounds[row + 1])
                match = self.exact[k].fullmatch(raw, at, end)
                if match and len(match[rule.group]) >= rule.least:
                    out[row].append((k, at - bounds[row], end - bounds[row]))
                i += 1
                if i < len(places) and places[i] < end:  # starts within the match; no match goes beyond its text
                    i = int(np.searchsorted(places, end))
        for own in out:
            own.sort(key=lambda s: (s[1], s[0]))
        return out


def scan(docs: DataFrame, rules: Sequence[SecretRule] = BASE + MORE, text_col: str = "text",
         spans_col: str = "secret_spans") -> DataFrame:
    """The input with an array of (kind, start, end) in code points, end exclusive; null and empty texts have none.

    An input column named like the result is replaced.
    """
    kept = [c for c in docs.columns if c != spans_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
                       + [f"`{spans_col}` array<struct<kind:string,start:bigint,end:bigint>>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    scanner = Scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in texts.pieces(batch.column(batch.num_columns - 1), BLOCK):
                found = []
                for row, spans in enumerate(scanner.spans(data, offs)):
                    if spans:
                        chars = np.concatenate(([0], np.cumsum((data[offs[row]:offs[row + 1]] & 0xC0) != 0x80)))
                        spans = [{"kind": rules[k].kind, "start": int(chars[s]), "end": int(chars[e])} for k, s, e in spans]
                    found.append(spans)
                own = batch.slice(a, b - a)
                yield pa.record_batch([*own.columns[:-1], pa.array(found, kind)], names=[*own.schema.names[:-1], spans_col])

    return docs.select(*kept, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def digest_columns(found: DataFrame, spans_col: str = "secret_spans", kinds: Sequence[str] = ("assign", "access", "hex")):
    """Counts by kind, the digest of the spans of ``kinds``, and all spans as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*names: str):
        return F.filter(spans_col, lambda s: s["kind"].isin(*names))

    return [*(F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds),
            F.sha2(joined(of(*kinds)).cast("binary"), 256).alias("base_sha256"), joined(F.col(spans_col)).alias("spans")]
