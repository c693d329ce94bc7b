"""Whole texts as byte arrays inside Arrow batches: pieces, words, rolling and mixing hashes.

All functions work on one *piece*: the UTF-8 bytes of some consecutive rows,
end to end, with ``offs`` (n + 1 offsets).  A piece has about ``PIECE`` bytes,
or one row if that is longer, so the memory of a task follows the longest text
and not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)


def byte_table(inside) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(inside)] = True
    return table


#: The separators of words: space, and tab to carriage return.
SPACE = byte_table([0x20, *range(0x09, 0x0E)])
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def salt(i: int) -> np.uint64:
    return np.uint64((_GOLDEN * (i + 1)) & _MASK)


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(n, np.uint64(base))
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, down) such that ``(prefix[b] - prefix[a]) * down[a]`` is the hash of bytes a to b."""
    up, down = _powers.get(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:len(data)], out=prefix[1:])
    return prefix, down


def span_hash(prefix: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offs


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of each piece of a column."""
    data, offs = binary(column)
    start = 0
    while start < len(offs) - 1:
        end = max(start + 1, int(np.searchsorted(offs, offs[start] + limit, "right")) - 1)
        end = min(end, len(offs) - 1)
        yield start, end, data[offs[start]:offs[end]], offs[start:end + 1] - offs[start]
        start = end


def owners(offs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The row of each byte position."""
    return np.searchsorted(offs, places, "right") - 1


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are inside; runs end at the ends of rows too."""
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; words end at separators and at the ends of rows."""
    return runs(~SPACE[data], offs)


#: Words that are hashed at once, and the bytes up to which a word is hashed that way.
HASHED, HASHED_BYTES = 1 << 14, 256


def keyed_hashes(data: np.ndarray, offs: np.ndarray, key: bytes) -> np.ndarray:
    """SipHash-2-4 of each stretch between two offsets, under a key of 16 bytes.

    Aumasson and Bernstein, SipHash: a fast short-input PRF (2012): who does
    not know the key cannot tell hashes from random ones.  Stretches are taken
    together, eight bytes of each in one step.
    """
    sizes = np.diff(offs)
    blocks = sizes // 8 + 1
    ends = np.cumsum(blocks)
    padded = np.zeros(8 * int(blocks.sum()), np.uint8)
    padded[np.arange(len(data[offs[0]:offs[-1]])) + np.repeat(8 * (ends - blocks) - (offs[:-1] - offs[0]), sizes)] = data[offs[0]:offs[-1]]
    padded[8 * ends - 1] = sizes & 255
    message = padded.view("<u8")
    order = np.argsort(-blocks, kind="stable")
    firsts = (ends - blocks)[order]
    longer = len(sizes) - np.searchsorted(np.sort(blocks), np.arange(blocks.max(initial=0)), "right")
    one, two = (int.from_bytes(key[i:i + 8], "little") for i in (0, 8))
    # The four words "somepseudorandomlygeneratedbytes".
    state = [np.full(len(sizes), x, np.uint64) for x in (
        one ^ 0x736F6D6570736575, two ^ 0x646F72616E646F6D, one ^ 0x6C7967656E657261, two ^ 0x7465646279746573)]

    def turn(x: np.ndarray, n: int) -> None:
        x[:] = x << np.uint64(n) | x >> np.uint64(64 - n)

    def add(a: np.ndarray, b: np.ndarray, n: int) -> None:
        a += b
        turn(b, n)
        b ^= a

    def rounds(own: list[np.ndarray], n: int) -> None:
        a, b, c, d = own
        for _ in range(n):
            add(a, b, 13)
            turn(a, 32)
            add(c, d, 16)
            add(a, d, 21)
            add(c, b, 17)
            turn(c, 32)

    for at, n in enumerate(longer.tolist()):
        own, word = [x[:n] for x in state], message[firsts[:n] + at]
        own[3] ^= word
        rounds(own, 2)
        own[0] ^= word
    state[2] ^= np.uint64(255)
    rounds(state, 4)
    out = np.empty(len(sizes), np.uint64)
    out[order] = state[0] ^ state[1] ^ state[2] ^ state[3]
    return out


def _distinct_hashes(words: pa.Array, key: bytes) -> np.ndarray:
    """The hash of each word; without a key, or for a long word, by one call each."""
    def single(some: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8, key=key).digest() for w in some.to_pylist()]), np.uint64)

    if not key:
        return single(words)
    long_ = pc.greater(pc.binary_length(words), HASHED_BYTES)
    data, offs = binary(words.filter(pc.invert(long_)))
    short = hashlib.blake2b(key, digest_size=16).digest()
    found = [keyed_hashes(data, offs[i:i + HASHED + 1], short) for i in range(0, len(offs) - 1, HASHED)]
    at = long_.to_numpy(zero_copy_only=False)
    out = np.empty(len(words), np.uint64)
    out[~at] = np.concatenate(found) if found else 0
    out[at] = single(words.filter(long_))
    return out


def word_hashes(data: np.ndarray, offs: np.ndarray, key: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the offsets of the rows in the list of words.

    Each distinct word of a piece is hashed by a cryptographic function, under a
    key by one for short inputs, so no text can be made up to have the words of
    another one if the key is secret.
    """
    inside = ~SPACE[data]
    starts, ends = runs(inside, offs)
    places = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    return _distinct_hashes(coded.dictionary, key)[coded.indices.to_numpy()], np.searchsorted(starts, offs, "left")


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int, key: bytes = b"") -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its runs of ``width`` words.

    A row with fewer words has its whole word sequence as one shingle, a row
    without words none.
    """
    words, rows = word_hashes(data, offs, key)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_GOLDEN)) | np.uint64(1)
    n = len(words)
    runs = np.zeros(max(n - width + 1, 0), np.uint64)
    for j in range(width if len(runs) else 0):
        runs += words[j:n - width + 1 + j] * factors[j]
    runs = mix(runs)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= width:
            own = np.sort(runs[a:b - width + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            short = np.array([np.sum(words[a:b] * factors[:b - a], dtype=np.uint64)])
            out.append(mix(short + salt(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
