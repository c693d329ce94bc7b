"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Encoding rests on one property of BPE: a token sequence is the encoding of its
bytes exactly when each two neighbours are (they encode to themselves).  So the
last token of a prefix is the one ending there that agrees with the last token
of the prefix before it.  Reading bytes, the transducer keeps the *live
boundaries*: the positions from which some token may still run past the bytes
read.  Each has its unfinished bytes and its last token; together they are the
state, and each step gives the last token up to the byte read.  As soon as no
boundary but the last is live, no later byte can change the tokens so far and
they are emitted, so the lookahead ends with the longest token that still fits.
States and transitions are made when first met; which tokens agree is compiled
from the ranks in the same lazy way.

Texts have ever new words, most of which need a few transitions that no word
needed before.  So the new words of a piece of text go through the transducer
side by side: step i reads byte i of every word, makes the transitions from the
states that words are in by then, each once, and numbers equal states alike.
States of a step are dropped after the next one, so memory follows the piece.
Single words and very long ones go alone, by states that are kept.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import texts

#: Words whose ids a worker remembers, their bytes, transducer states and token pairs that it keeps; each starts anew when full.
REMEMBERED, REMEMBERED_BYTES = 150_000, 4 << 20
STATES, PAIRS = 50_000, 150_000
#: Words that go side by side have at most so many bytes; fewer words than the second go alone, the third at a time.
SIDE_BYTES, SIDE_FEW, SIDE_WORDS = 64, 64, 1 << 16
#: Tokens that the decoder takes in one step.
DECODE_BLOCK = 1 << 16

# The code points with the Unicode property White_Space.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file's content (base64 and rank on each line)."""
    return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines.splitlines() if x)}


class Transducer:
    """Bytes in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} of the 256 single bytes")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.openings = {token[:n] for token in ranks for n in range(1, len(token))}
        # What is known of a token is bounded by the vocabulary and outlasts a reset.
        self._splits: dict[int, tuple[int, int] | None] = {}
        self._sound: dict[int, bool] = {}
        self._side: SideBySide | None = None
        self.reset()

    def reset(self) -> None:
        """Forget all states, and which tokens agree, and start with the empty state."""
        self._agree: dict[tuple[int, int], bool] = {}
        self._numbers: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._moves: list[dict[int, tuple[int, int, bool]]] = []
        self._number(((b"", None),))

    def merge(self, data: bytes, stop: int = sys.maxsize) -> list[int]:
        """The definition: join the two neighbours of lowest rank until none below ``stop`` can be joined."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1))
            if rank >= stop:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives a token; None for a single byte."""
        if token not in self._splits:
            data = self.bytes_of[token]
            parts = self.merge(data, token) if len(data) > 1 else []
            self._splits[token] = tuple(parts) if len(parts) == 2 else None
        return self._splits[token]

    def sound(self, token: int) -> bool:
        """Whether merges lead to the token at all."""
        if token not in self._sound:
            self._sound[token] = self._split(token) is not None or self.merge(self.bytes_of[token]) == [token]
        return self._sound[token]

    def agree(self, left: int | None, right: int) -> bool:
        """Whether two tokens may stand side by side; without a left one, whether merges lead to the token at all.

        Merges run by rank, so a part at the edge exists from its own rank to
        that of the merge that takes it up.  The tokens disagree when two parts
        that exist together join first; of equal ranks the left one comes first.
        """
        if left is None or not self.sound(right):
            return self.sound(right)
        known = self._agree.get((left, right))
        if known is None:
            known = self._agree[left, right] = self._stand(left, right)
        return known

    def _stand(self, left: int, right: int) -> bool:
        """Undo the merges at both edges, the later one first, and look at each two parts that exist together."""
        left_ends = right_ends = sys.maxsize
        while True:
            left_parts, right_parts = self._split(left), self._split(right)
            left_born, right_born = left if left_parts else -1, right if right_parts else -1
            rank = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if rank is not None and left_born < rank < left_ends and right_born < rank <= right_ends:
                return False
            if left_born > right_born:
                left_ends, left = left, left_parts[1]
            elif right_parts:
                right_ends, right = right, right_parts[0]
            else:
                return True

    def _number(self, state: tuple) -> int:
        number = self._numbers.get(state)
        if number is None:
            number = self._numbers[state] = len(self._states)
            self._states.append(state)
            self._moves.append({})
        return number

    def _move(self, number: int, byte: int) -> tuple[int, int, bool]:
        """Make one transition: the next state, the last token up to here, and whether all tokens are final now."""
        live, ended = [], None
        for open_bytes, last in self._states[number]:
            grown = open_bytes + bytes((byte,))
            token = self.ranks.get(grown)
            if ended is None and token is not None and self.agree(last, token):
                ended = b"", token
            if grown in self.openings:
                live.append((grown, last))
        return self._number((*live, ended)), ended[1], not live

    def encode(self, data: bytes) -> list[int]:
        """The token ids of one piece of text."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        out: list[int] = []
        lasts: list[int] = []
        state, moves = 0, self._moves
        for byte in data:
            step = moves[state].get(byte)
            if step is None:
                if len(self._states) > STATES or len(self._agree) > PAIRS:
                    # Go on from the same state, which gets a new number.
                    kept = self._states[state]
                    self.reset()
                    state, moves = self._number(kept), self._moves
                step = moves[state][byte] = self._move(state, byte)
            state, last, final = step
            lasts.append(last)
            if final:
                out += self._back(lasts)
                lasts = []
        return out + self._back(lasts)

    def encode_all(self, words: list[bytes]) -> list[bytes]:
        """The token ids of many words, each as little-endian unsigned 32-bit integers."""
        found: list[bytes | None] = [None] * len(words)
        side = []
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is None and len(word) <= SIDE_BYTES:
                side.append(i)
            else:
                found[i] = np.array([whole] if whole is not None else self.encode(word), "<u4").tobytes()
        for start in range(0, len(side), SIDE_WORDS):
            some = side[start:start + SIDE_WORDS]
            if len(some) < SIDE_FEW:
                for i in some:
                    found[i] = np.array(self.encode(words[i]), "<u4").tobytes()
                continue
            self._side = self._side or SideBySide(self)
            ids, offs = self._side.encode([words[i] for i in some])
            flat = ids.astype("<u4").tobytes()
            for i, a, b in zip(some, (4 * offs[:-1]).tolist(), (4 * offs[1:]).tolist()):
                found[i] = flat[a:b]
        return found

    def _back(self, lasts: list[int]) -> list[int]:
        """The tokens that end at the last byte, found backwards from the last token of each prefix."""
        out, end = [], len(lasts)
        while end:
            out.append(lasts[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]


def _lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each key asked for, from sorted keys; -1 for others."""
    if not len(keys):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], -1)


class SideBySide:
    """The transducer for many words at once, a byte of each in one step.

    A state is a run of rows (node, last): the live boundaries, the oldest
    first, with the tree node of their unfinished bytes, and the last token.
    """

    def __init__(self, machine: Transducer):
        self.machine = machine
        ranks = machine.ranks
        node = {prefix: i for i, prefix in enumerate(sorted(machine.openings.union(ranks, [b""])))}
        self.top = max(machine.bytes_of) + 1
        # The tree of all tokens: children by node and byte, the token of a node, whether longer tokens go on from it.
        edges = np.array(sorted((node[p[:-1]] << 8 | p[-1], i) for p, i in node.items() if p), np.int64)
        self.edges, self.child = edges[:, 0].copy(), edges[:, 1].copy()
        self.token = np.array([ranks.get(p, -1) for p in node], np.int64)
        self.inner = np.array([p in machine.openings for p in node])
        # Two tokens whose bytes together are a token, and its rank.
        joins = np.array(sorted((ranks[t[:n]] * self.top + ranks[t[n:]], rank) for t, rank in ranks.items()
                                for n in range(1, len(t)) if t[:n] in ranks and t[n:] in ranks), np.int64).reshape(-1, 2)
        self.joins, self.joined = joins[:, 0].copy(), joins[:, 1].copy()
        self.length = np.array([len(machine.bytes_of.get(i, b"")) for i in range(self.top)])
        # Of each token, once met: the first and last of its parts (-1: a single byte), whether merges lead to it.
        self.met = np.zeros(self.top, bool)
        self.first, self.final = np.full(self.top, -1), np.full(self.top, -1)
        self.sound = np.zeros(self.top, bool)

    def _meet(self, tokens: np.ndarray) -> None:
        ahead = tokens[~self.met[tokens]].tolist()
        while ahead:
            t = ahead.pop()
            if not self.met[t]:
                self.met[t], self.sound[t] = True, self.machine.sound(t)
                parts = self.machine._split(t)
                if parts:
                    self.first[t], self.final[t] = parts
                    ahead += parts

    def agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Transducer.agree`` of many tokens; -1 is no left one."""
        pairs, back = np.unique((left + 1) * self.top + right, return_inverse=True)
        left, right = pairs // self.top - 1, pairs % self.top
        self._meet(np.unique(right))
        self._meet(np.unique(left[left >= 0]))
        good = self.sound[right]
        rows = np.flatnonzero(good & (left >= 0))
        left, right = left[rows], right[rows]
        left_ends = np.full(len(rows), sys.maxsize)
        right_ends = left_ends
        while len(rows):
            left_part, right_part = self.final[left], self.first[right]
            left_born, right_born = np.where(left_part < 0, -1, left), np.where(right_part < 0, -1, right)
            rank = _lookup(self.joins, self.joined, left * self.top + right)
            bad = (left_born < rank) & (rank < left_ends) & (right_born < rank) & (rank <= right_ends)
            good[rows[bad]] = False
            later = left_born > right_born
            go = ~bad & (later | (right_part >= 0))
            left_ends, right_ends = np.where(later, left, left_ends)[go], np.where(later, right_ends, right)[go]
            left, right = np.where(later, left_part, left)[go], np.where(later, right, right_part)[go]
            rows = rows[go]
        return good[back]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and the offsets of the words."""
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        lasts = np.empty(len(data), np.int64)
        order = np.argsort(-sizes, kind="stable")
        longer = len(words) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), "right")
        state = np.zeros(len(words), np.int64)
        offs, node, last = np.array([0, 1]), np.array([0]), np.array([-1])
        for at, left in enumerate(longer.tolist()):
            places = starts[order[:left]] + at
            moves, back = np.unique(state[:left] << 8 | data[places], return_inverse=True)
            numbers, ended, offs, node, last = self._moves(moves >> 8, moves & 255, offs, node, last)
            lasts[places], state = ended[back], numbers[back]
        return self._back(starts, sizes, lasts)

    def _moves(self, states: np.ndarray, data: np.ndarray, offs: np.ndarray, node: np.ndarray, last: np.ndarray):
        """Per transition the new state's number and the last token; then the rows of the new states."""
        counts = offs[states + 1] - offs[states]
        of = np.repeat(np.arange(len(states)), counts)
        rows = np.arange(len(of)) + np.repeat(offs[states] - (np.cumsum(counts) - counts), counts)
        node, last = _lookup(self.edges, self.child, node[rows] << 8 | data[of]), last[rows]
        on = node >= 0
        of, node, last = of[on], node[on], last[on]
        token = self.token[node]
        ends = np.flatnonzero(token >= 0)
        ends = ends[self.agree(last[ends], token[ends])][::-1]
        ended = np.full(len(states), -1)
        ended[of[ends]] = token[ends]  # of several the first, which is written last
        live = self.inner[node]
        of = np.concatenate((of[live], np.arange(len(states))))
        node, last = np.concatenate((node[live], np.zeros(len(states), np.int64))), np.concatenate((last[live], ended))
        by = np.argsort(of, kind="stable")
        of, node, last = of[by], node[by], last[by]
        counts = np.bincount(of, minlength=len(states))
        firsts = np.cumsum(counts) - counts
        # Equal runs of rows get one number: the one of the run up to a row follows from that of the row before.
        kinds = np.unique(node * (self.top + 1) + last + 1, return_inverse=True)[1]
        numbers = np.zeros(len(states), np.int64)
        for i in range(counts.max(initial=0)):
            more = np.flatnonzero(counts > i)
            grown = numbers[more] * (len(kinds) + 1) + kinds[firsts[more] + i] + 1
            numbers[more] = np.unique(grown, return_inverse=True)[1] + (i + 1) * len(states)
        _, own, numbers = np.unique(numbers, return_index=True, return_inverse=True)
        counts, firsts = counts[own], firsts[own]
        offs = np.concatenate(([0], np.cumsum(counts)))
        rows = np.arange(offs[-1]) + np.repeat(firsts - offs[:-1], counts)
        return numbers, ended, offs, node[rows], last[rows]

    def _back(self, starts: np.ndarray, sizes: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each word, found backwards from the last token of each prefix."""
        words, ends, found = np.flatnonzero(sizes), sizes[sizes > 0], []
        counts = np.zeros(len(sizes), np.int64)
        while len(words):
            tokens = lasts[starts[words] + ends - 1]
            found.append((words, tokens))
            counts[words] += 1
            ends = ends - self.length[tokens]
            words, ends = words[ends > 0], ends[ends > 0]
        offs = np.concatenate(([0], np.cumsum(counts)))
        ids = np.empty(offs[-1], np.int64)
        for i, (words, tokens) in enumerate(found):
            ids[offs[words + 1] - 1 - i] = tokens
        return ids, offs


def _utf8_machine() -> list[list[int]]:
    """Transitions of the UTF-8 automaton, by state and byte; 0 is between characters, -1 is no UTF-8.

    States 1 to 3 await that many plain continuation bytes, the others a first
    continuation byte from a narrower range.
    """
    cont = range(0x80, 0xC0)
    table = [[-1] * 256 for _ in range(8)]

    def go(state: int, bytes_in: Iterable[int], to: int) -> None:
        for b in bytes_in:
            table[state][b] = to

    go(0, range(0x80), 0)
    go(0, range(0xC2, 0xE0), 1)
    go(0, range(0xE1, 0xF0), 2)
    go(0, range(0xF1, 0xF4), 3)
    for lead, state, after in ((0xE0, 4, range(0xA0, 0xC0)), (0xED, 5, range(0x80, 0xA0)),
                               (0xF0, 6, range(0x90, 0xC0)), (0xF4, 7, range(0x80, 0x90))):
        go(0, [lead], state)
        go(state, after, 1 if lead < 0xF0 else 2)
    for state in (1, 2, 3):
        go(state, cont, state - 1)
    return table


class Decoder:
    """Token ids in, whole characters out: bytes of an unfinished character wait for the next call."""

    MACHINE = _utf8_machine()

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of = bytes_of
        # Tokens that begin and end between characters leave the automaton where it is.
        self.whole = np.array([self._run(0, t)[0] == 0 for t in bytes_of])
        self.state, self.held = 0, b""

    def _run(self, state: int, data: bytes) -> tuple[int, int]:
        """The state after the bytes, and how many of them follow the last whole character (all, if none ends)."""
        since = 0
        for b in data:
            state = self.MACHINE[state][b]
            if state < 0:
                return -1, 0
            since = since + 1 if state else 0
        return state, since

    def feed(self, ids: np.ndarray) -> bytes:
        """The bytes of all characters that are complete by now; ValueError where the bytes are no UTF-8."""
        done, since, state = -1, len(self.held), self.state
        for at in np.flatnonzero(~self.whole[ids]).tolist():
            if state and at != done + 1:
                raise ValueError("a character is cut short")
            token = self.bytes_of[ids[at]]
            state, left = self._run(state, token)
            if state < 0:
                raise ValueError("the bytes are no UTF-8")
            since = left + (since if left == len(token) else 0) if state else 0
            done = at
        if state and done != len(ids) - 1 and done >= 0 or (state and done < 0 and len(ids)):
            raise ValueError("a character is cut short")
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        cut = len(data) - since
        self.state, self.held = state, data[cut:]
        return data[:cut]

    def finish(self) -> None:
        if self.state:
            raise ValueError("the text ends within a character")


class Codec:
    """Splits whole texts by the pattern, encodes each match separately, and decodes."""

    def __init__(self, lines: bytes, pattern: str):
        import regex
        self.transducer = Transducer(read_ranks(lines))
        # Contractions start with an apostrophe, letters and digits never do, so they may be tried in either order.
        head, tail = "'s|'t|'re|'ve|'m|'ll|'d|", r" ?\p{L}+| ?\p{N}+|"
        if pattern.startswith(head + tail):
            pattern = tail + head + pattern[len(head + tail):]
        spaces = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]")
        self.split = regex.compile(spaces.replace(r"\S", f"[^{WHITE_SPACE}]")).findall
        top = max(self.transducer.bytes_of) + 1
        self.bytes_of = [self.transducer.bytes_of.get(i, b"") for i in range(top)]
        self.decoder = Decoder(self.bytes_of)
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return next(self.encode_all([text]))

    def encode_all(self, whole: list[str]) -> Iterator[np.ndarray]:
        """The ids of each of some whole texts; words that are new in them are encoded together."""
        known = self.known
        parts = list(map(self.split, whole))
        if len(known) > REMEMBERED or self.known_bytes > REMEMBERED_BYTES:
            known.clear()
            self.known_bytes = 0
        new = list(set().union(*parts).difference(known))
        ids = self.transducer.encode_all([part.encode() for part in new])
        known.update(zip(new, ids))
        self.known_bytes += sum(map(len, ids))
        for own in parts:
            yield np.frombuffer(b"".join(map(known.__getitem__, own)), "<u4")

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes, block by block, each made of whole characters."""
        decoder = self.decoder
        decoder.state, decoder.held = 0, b""
        for start in range(0, len(ids), DECODE_BLOCK):
            yield decoder.feed(ids[start:start + DECODE_BLOCK])
        decoder.finish()


def codec(lines: bytes, pattern: str) -> Codec:
    """The worker's codec for a vocabulary: states and remembered words outlast a task."""
    kept = sys.modules.setdefault("_sievework_kept", types.ModuleType("_sievework_kept"))
    key = hashlib.sha256(lines + pattern.encode()).hexdigest()
    if getattr(kept, "codec_key", None) != key:
        kept.codec_key, kept.codec = key, Codec(lines, pattern)
    return kept.codec


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
                     digests: bool = False) -> DataFrame:
    """The input with an array column of token ids; with ``digests`` only counts and digests of ids and decoded bytes.

    A null or empty text has no ids.  The decoded ids are checked against the
    text in the same pass; a difference stops the job.  An input column of the
    same name as a result is replaced.
    """
    spark = docs.sparkSession
    lines = spark.sparkContext.broadcast(_file(ranks_path))  # of the vocabulary's size, whatever the table's
    added = (("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")) if digests else (
        ("n_tokens", "bigint"), (ids_col, "array<int>"))
    kept = [c for c in docs.columns if c not in {n for n, _ in added}]
    source = docs.select(*kept, F.col(text_col).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
                       + [f"`{n}` {t}" for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(lines.value, pattern)
        gc.disable()  # the worker's tables hold no cycles, and walking them again and again costs a third of the time
        for batch in batches:
            for a, b, data, offs in texts.pieces(batch.column(batch.num_columns - 1)):
                raw, counts, first, second = data.tobytes(), [], [], []
                places = list(zip(offs[:-1].tolist(), offs[1:].tolist()))
                for (x, y), ids in zip(places, coder.encode_all([raw[x:y].decode() for x, y in places])):
                    back = b"".join(coder.decode(ids))
                    if back != raw[x:y]:
                        raise ValueError("decoded bytes differ from the text")
                    counts.append(len(ids))
                    if digests:
                        first.append(hashlib.sha256(ids.tobytes()).hexdigest())
                        second.append(hashlib.sha256(back).hexdigest())
                    else:
                        first.append(ids)
                if digests:
                    new = [pa.array(first, pa.string()), pa.array(second, pa.string())]
                else:
                    flat = np.concatenate(first).astype(np.int32) if first else np.zeros(0, np.int32)
                    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    new = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                own = batch.slice(a, b - a)
                yield pa.record_batch([*own.columns[:-1], pa.array(counts, pa.int64()), *new],
                                      names=[*own.schema.names[:-1], *(n for n, _ in added)])

    return source.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The input with the text of an array column of token ids, decoded character by character.

    Null and empty arrays give an empty text; ids that are no token, or bytes
    that are no UTF-8, stop the job.  A column named like the result is replaced.
    """
    lines = docs.sparkSession.sparkContext.broadcast(_file(ranks_path))  # of the vocabulary's size, whatever the table's
    kept = [c for c in docs.columns if c != text_col]
    source = docs.select(*kept, F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("__ids"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + [f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(lines.value, pattern)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            flat, ends = ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
            if len(flat) and (flat.min() < 0 or flat.max() >= len(coder.bytes_of) or not all(coder.bytes_of[i] for i in np.unique(flat))):
                raise ValueError("an id is no token")
            found = [b"".join(coder.decode(flat[a:b])).decode() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.record_batch([*batch.columns[:-1], pa.array(found, pa.string())], names=[*batch.schema.names[:-1], text_col])

    return source.mapInArrow(run, schema)
