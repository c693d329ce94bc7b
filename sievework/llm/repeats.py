"""Repeated passages by enhanced suffix arrays over the places where texts can be equal.

A suffix array of the whole corpus would be one sort of every byte.  Here each
window of ``LENGTH`` bytes is assigned to the smallest hash among its
``GRAM``-byte grams, its anchor.  Equal windows have equal anchors, so windows
are only compared under one anchor, and an anchor that occurs once in the
corpus takes no further part.  Consecutive windows with one anchor form a
*stretch* of text; for each anchor that occurs more than once its distinct
stretches are sorted by suffix, and a stack scan of the common-prefix lengths
gives the tree of intervals.  Those of at least ``LENGTH`` bytes whose
occurrences differ in the byte before are the maximal repeats among the distinct
stretches of an anchor.  They only serve to mark what an earlier document has:
stretches that are the same stand for each other and end with their anchor, so
a longer repeat comes in fragments.  No operator gives the maximal repeats of
the corpus with all their occurrences; ``clean_repeats`` gives the removed
spans and the remaining text, ``remove_repeats`` digests of them.

Texts are packed into chunks that are written once, in buckets, so that the
answers for a chunk meet it without moving a text again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.work import new_folder, settle
from sievework.llm import texts

LENGTH = 50
GRAM = 20
#: Bytes of text in a chunk, and in a bucket of chunks.
CHUNK = 1 << 20
BUCKET = 24 << 20
#: Bytes of text for each group that anchors are compared in.
GROUP = 6 << 20
#: Bytes to which suffixes are compared.
REACH = 128
#: Windows that one suffix array takes in, unless more have the same bytes.
SUFFIXES = 100_000
#: Members of repeats that are marked in one step.
MEMBERS = 10_000
#: The first k bytes of a word, for k from 0 to 8.
_FIRST_BYTES = np.array([(1 << 64) - (1 << 64 - 8 * k) for k in range(9)], np.uint64)
#: An anchor in more chunks than this is compared window by window, in as many groups as it has windows.
HOT_CHUNKS = 4096


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(first window, last window, anchor) of every stretch of consecutive windows with one anchor within a text."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    prefix, down = texts.prefix_hash(data)
    low = texts.mix((prefix[gram:] - prefix[:-gram]) * down[:len(data) - gram + 1])
    span, wanted = 1, length - gram + 1
    while 2 * span <= wanted:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wanted:
        low = np.minimum(low[:len(low) - (wanted - span)], low[wanted - span:])
    inside = np.zeros(n + 1, np.int64)
    begins = np.minimum(offs[:-1], n)
    np.add.at(inside, begins, 1)
    np.add.at(inside, np.clip(offs[1:] - length + 1, begins, n), -1)
    inside = np.cumsum(inside[:-1]) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    over = np.ones(n, bool)
    over[:-1] = ~inside[1:] | new[1:]
    last = np.flatnonzero(inside & over)
    # The smallest of many hashes is a small number; mixed again, anchors are even over their range and so over the groups.
    return first, last, texts.mix(low[first] + texts.salt(0))


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions in the given spans, end to end."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The common-prefix intervals (length, first, last) of at least ``least``, children before parents.

    ``lcp[i]`` belongs to the suffixes i - 1 and i of a sorted list; ``lcp[0]`` is not looked at.
    """
    out, stack = [], []
    for i, value in enumerate([*lcp[1:].tolist(), 0], 1):
        left = i - 1
        while stack and stack[-1][0] > value:
            length, left = stack.pop()
            out.append((length, left, i - 1))
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, left))
    return out


def maximal_repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, owner: np.ndarray,
                    least: int = LENGTH):
    """Length, first and last row in the sorted suffix list of every maximal repeat, and that list.

    Suffixes begin at ``starts`` and end at ``ends``; only those of one group
    are compared.  ``owner`` changes where a suffix begins a stretch: there
    the byte before counts as different from all others.  Suffixes are compared
    to ``REACH`` bytes; a repeat that is longer is given at every place from
    which it still has that length.
    """
    ends = np.minimum(ends, starts + REACH)
    reach = int((ends - starts).max())
    words = -(-reach // 8)
    padded = np.concatenate((data, np.zeros(8 * words + 8, np.uint8)))
    word_at = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
    keys = [word_at[starts + 8 * j].astype(np.uint64) & _FIRST_BYTES[np.clip(ends - starts - 8 * j, 0, 8)] for j in range(words)]
    order = np.lexsort((ends - starts, *keys[::-1], group))
    lcp = np.zeros(len(order), np.int64)
    equal = group[order[1:]] == group[order[:-1]]
    for word in keys:
        differs = word[order[1:]] ^ word[order[:-1]]
        same = np.full(len(differs), 8)
        some = differs != 0
        top = np.frexp(differs[some].astype(np.float64))[1]  # highest bit, or one more after rounding
        high = np.where(top > 64, 64, top)
        exact = (differs[some] >> (high - 1).astype(np.uint64)) & np.uint64(1)
        high = np.where(exact == 1, high, high - 1)
        same[some] = (64 - high) // 8
        lcp[1:] += np.where(equal, same, 0)
        equal &= ~some
    sizes = (ends - starts)[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(sizes[1:], sizes[:-1]))
    first_of = np.r_[True, owner[1:] != owner[:-1]]
    before = np.where(first_of, -1 - np.arange(len(starts)), padded[np.maximum(starts - 1, 0)].astype(np.int64))[order]
    long = lcp >= least
    # Blocks of suffixes that share at least the wanted length; only within them does the stack move.
    opens = np.flatnonzero(long & ~np.r_[False, long[:-1]]) - 1
    closes = np.flatnonzero(long & ~np.r_[long[1:], False])
    pair = closes - opens == 1
    found = [(length, a + left, a + right) for a, z in zip(opens[~pair].tolist(), closes[~pair].tolist())
             for length, left, right in intervals(lcp[a:z + 1], least)]
    found = np.array(found, np.int64).reshape(-1, 3)
    length = np.concatenate((lcp[closes[pair]], found[:, 0]))
    left, right = np.concatenate((opens[pair], found[:, 1])), np.concatenate((closes[pair], found[:, 2]))
    turns = np.r_[0, np.cumsum(before[1:] != before[:-1])]
    diverse = (length == REACH) | (turns[right] != turns[left])
    return length[diverse], left[diverse], right[diverse], order


def lower_covered(best: np.ndarray, slot: np.ndarray, smallest: np.ndarray, length: np.ndarray, left: np.ndarray,
                  right: np.ndarray) -> None:
    """Lower ``best`` to the smallest document of each repeat at every window that one of its members covers.

    ``slot`` has the first window of each sorted suffix.  Members are taken
    ``MEMBERS`` at a time, however they are divided among repeats.
    """
    order = np.argsort(left, kind="stable")
    length, left, right = length[order], left[order], right[order]
    bounds = np.stack((left, right + 1), axis=1).reshape(-1)
    low = np.minimum.reduceat(np.r_[smallest, smallest[:1]], bounds)[::2] if len(left) else left
    # Where repeats overlap the last assignment holds, so the smallest document comes last.
    order = np.argsort(-low, kind="stable")
    length, left, right, low = length[order], left[order], right[order], low[order]
    ends = np.cumsum(right - left + 1)
    for at in range(0, int(ends[-1]) if len(ends) else 0, MEMBERS):
        member = np.arange(at, min(at + MEMBERS, int(ends[-1])))
        repeat = np.searchsorted(ends, member, "right")
        windows = length[repeat] - LENGTH + 1
        covered = places(slot[right[repeat] + 1 + member - ends[repeat]], windows)
        best[covered] = np.minimum(best[covered], np.repeat(low[repeat], windows))


class _Chunk:
    """Stretches of one chunk, without texts that are copies as a whole."""

    def __init__(self, row: dict):
        self.docs = np.array(row["docs"], np.int64)
        sizes = np.array(row["sizes"], np.int64)
        self.offs = np.concatenate(([0], np.cumsum(sizes)))
        self.data = np.frombuffer(row["data"], np.uint8)
        self.first, self.last, self.anchor = anchors(self.data, self.offs)
        self.owner = texts.owners(self.offs, self.first)
        copies = np.zeros(len(sizes), bool)
        copies[np.array(row.get("copies") or [], np.int64)] = True
        self.copies = copies
        keep = ~copies[self.owner]
        self.first, self.last, self.anchor, self.owner = (x[keep] for x in (self.first, self.last, self.anchor, self.owner))

    def values(self, groups: int):
        """Distinct anchors in order, the stretches' places among them, how often each occurs, and its group."""
        found, place, often = np.unique(self.anchor, return_inverse=True, return_counts=True)
        group = ((found >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
        return found, place.reshape(-1), often, group

    def stretches(self, groups: int, flags: list[dict]):
        """Distinct stretches under anchors that occur elsewhere too: group, key, start, size, smallest document;
        and for each occurrence its first window, size, document and distinct stretch."""
        found, place, _, group = self.values(groups)
        again, hot = np.zeros(len(found), bool), np.zeros(len(found), bool)
        for f in flags:
            own = np.flatnonzero(group == f["group"])
            again[own] = np.unpackbits(np.frombuffer(f["again"], np.uint8), count=len(own)).astype(bool)
            hot[own] = np.unpackbits(np.frombuffer(f["hot"], np.uint8), count=len(own)).astype(bool)
        use = again[place]
        first, last, key, owner, single = (x[use] for x in (self.first, self.last, self.anchor, self.owner, hot[place]))
        prefix, down = texts.prefix_hash(self.data)
        if single.any():
            # Windows of hot anchors stand alone, each under its own hash.
            windows = (last - first + 1)[single]
            begin = places(first[single], windows)
            own = texts.span_hash(prefix, down, begin, begin + LENGTH)
            first = np.concatenate((first[~single], begin))
            last = np.concatenate((last[~single], begin))
            key = np.concatenate((key[~single], own))
            owner = np.concatenate((owner[~single], np.repeat(owner[single], windows)))
        size = last - first + LENGTH
        whole = texts.span_hash(prefix, down, first, first + size) + texts.mix(size.astype(np.uint64))
        doc = self.docs[owner]
        order = np.lexsort((doc, whole, key))
        change = np.r_[True, (whole[order][1:] != whole[order][:-1]) | (key[order][1:] != key[order][:-1])][:len(order)]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(change) - 1
        lead = order[change]
        at = ((key[lead] >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
        return (at, key[lead], first[lead], size[lead], doc[lead]), (first, size, doc, owner, number)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows one after the other; a batch may hold a whole bucket of chunks."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _pack(docs: DataFrame, chunk: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, data, offs in texts.pieces(batch.column(1), chunk):
                yield pa.record_batch([
                    pa.array([number]), pa.array([batch.column(0)[a:b].to_pylist()], pa.list_(pa.int64())),
                    pa.array([np.diff(offs).tolist()], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary())],
                    names=["chunk", "docs", "sizes", "data"])
                number += 1

    return docs.mapInArrow(run, "chunk long, docs array<long>, sizes array<long>, data binary")


def _digests(chunks: DataFrame) -> DataFrame:
    """(chunk, place, doc, digest, size) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                ends = np.cumsum(row["sizes"]).tolist()
                found = [hashlib.sha256(row["data"][e - s:e]).digest() for s, e in zip(row["sizes"], ends)]
                n = len(found)
                yield pa.record_batch([pa.array([row["chunk"]] * n), pa.array(range(n), pa.int64()), pa.array(row["docs"], pa.int64()),
                                       pa.array(found, pa.binary()), pa.array(row["sizes"], pa.int64())],
                                      names=["chunk", "place", "doc", "digest", "size"])

    return chunks.select("chunk", "docs", "sizes", "data").mapInArrow(
        run, "chunk long, place long, doc long, digest binary, size long")


def _ask(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                found, _, often, group = _Chunk(row).values(groups)
                cuts = np.searchsorted(group, np.arange(groups + 1))  # groups follow the order of anchors
                used = np.flatnonzero(np.diff(cuts)).tolist()
                low = (found & np.uint64(0xFFFFFFFF)).astype("<u4")
                yield pa.record_batch([
                    pa.array(used, pa.int64()), pa.array([row["chunk"]] * len(used), pa.int64()),
                    pa.array([low[cuts[g]:cuts[g + 1]].tobytes() for g in used], pa.binary()),
                    pa.array([np.packbits(often[cuts[g]:cuts[g + 1]] > 1).tobytes() for g in used], pa.binary())],
                    names=["group", "chunk", "anchors", "twice"])
    return run


def _answer(table: pa.Table) -> pa.Table:
    """For every chunk of a group, which of its anchors occur again, and which in very many chunks."""
    lists = [np.frombuffer(x, "<u4") for x in table.column("anchors").to_pylist()]
    sizes = [len(x) for x in lists]
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in
                            zip(table.column("twice").to_pylist(), sizes)])
    found, place, often = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    place = place.reshape(-1)
    again = (often > 1)[place] | (np.bincount(place, twice, len(found)) > 0)[place]
    hot = (often > HOT_CHUNKS)[place]
    ends = np.cumsum(sizes).tolist()
    return pa.table({
        "chunk": table.column("chunk"), "group": table.column("group"),
        "again": pa.array([np.packbits(again[e - n:e]).tobytes() for n, e in zip(sizes, ends)], pa.binary()),
        "hot": pa.array([np.packbits(hot[e - n:e]).tobytes() for n, e in zip(sizes, ends)], pa.binary())})


def _send(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                chunk = _Chunk(row)
                (group, key, first, size, doc), _ = chunk.stretches(groups, row["flags"] or [])
                order = np.argsort(group, kind="stable")
                cuts = np.searchsorted(group[order], np.arange(groups + 1))
                used = np.flatnonzero(np.diff(cuts)).tolist()
                own = [order[cuts[g]:cuts[g + 1]] for g in used]
                yield pa.record_batch([
                    pa.array(used, pa.int64()), pa.array([row["chunk"]] * len(used), pa.int64()),
                    pa.array([key[o].tobytes() for o in own], pa.binary()),
                    pa.array([size[o].astype("<u4").tobytes() for o in own], pa.binary()),
                    pa.array([doc[o].tobytes() for o in own], pa.binary()),
                    pa.array([chunk.data[places(first[o], size[o])].tobytes() for o in own], pa.binary())],
                    names=["group", "chunk", "keys", "sizes", "docs", "data"])
    return run


def _compare(table: pa.Table) -> pa.Table:
    """For every chunk's stretches, runs of windows that a smaller document has: stretch, first, last window, document."""
    columns = {c: table.column(c).to_pylist() for c in ("keys", "sizes", "docs", "data")}
    size = np.concatenate([np.frombuffer(x, "<u4") for x in columns["sizes"]]).astype(np.int64)
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in columns["keys"]])
    doc = np.concatenate([np.frombuffer(x, np.int64) for x in columns["docs"]])
    hashes = []
    for raw, sizes in zip(columns["data"], columns["sizes"]):  # one by one: hashing takes many times the bytes
        own = np.frombuffer(sizes, "<u4").astype(np.int64)
        prefix, down = texts.prefix_hash(np.frombuffer(raw, np.uint8))
        ends = np.cumsum(own)
        hashes.append(texts.span_hash(prefix, down, ends - own, ends) + texts.mix(own.astype(np.uint64)))
    whole = np.concatenate(hashes)
    data = np.frombuffer(b"".join(columns.pop("data")), np.uint8)
    start = np.cumsum(size) - size
    order = np.lexsort((doc, whole, key))
    change = np.r_[True, (whole[order][1:] != whole[order][:-1]) | (key[order][1:] != key[order][:-1])]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(change) - 1
    lead = order[change]  # distinct stretches, each with its smallest document, ordered by key
    windows = size[lead] - LENGTH + 1
    base = np.cumsum(windows) - windows
    best = np.repeat(doc[lead], windows)
    _, of_key, n_key = np.unique(key[lead], return_inverse=True, return_counts=True)
    many = np.flatnonzero(n_key[of_key.reshape(-1)] > 1)
    # Anchors with one stretch need no comparison, nor do windows whose bytes come once; hashes tell them, chunk by chunk.
    many = many[np.argsort(lead[many])]
    row_of = np.repeat(np.arange(len(columns["sizes"])), [len(x) // 4 for x in columns["sizes"]])
    cuts = np.searchsorted(row_of, np.arange(len(columns["sizes"]) + 1))
    shares = np.searchsorted(lead[many], cuts)
    hashes = [np.zeros(0, np.uint64)]
    for a, b, low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), shares[:-1].tolist(), shares[1:].tolist()):
        if low < high:
            prefix, down = texts.prefix_hash(data[start[a]:start[b - 1] + size[b - 1]])
            at = places(start[lead[many[low:high]]] - start[a], windows[many[low:high]])
            hashes.append(texts.span_hash(prefix, down, at, at + LENGTH))
    window = np.concatenate(hashes)
    order = np.argsort(window)
    equal = window[order][1:] == window[order][:-1]
    order = order[(np.r_[False, equal] | np.r_[equal, False])[:len(order)]]
    window = window[order]
    begins = places(start[lead[many]], windows[many])[order]
    stretch = np.repeat(many, windows[many])[order]
    # Repeats begin with equal windows, so suffix arrays are cut where the window changes.
    turns, at = np.flatnonzero(np.r_[window[1:] != window[:-1], True][:len(window)]) + 1, 0
    while at < len(window):
        till = int(turns[min(np.searchsorted(turns, at + SUFFIXES), len(turns) - 1)])
        own, opened = stretch[at:till], start[lead[stretch[at:till]]]
        length, left, right, order = maximal_repeats(data, begins[at:till], opened + size[lead[own]], window[at:till],
                                                     np.cumsum(begins[at:till] == opened))
        slot = (base[own] + begins[at:till] - opened)[order]
        lower_covered(best, slot, doc[lead[own]][order], length, left, right)
        at = till
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = number[a:b]
        n = windows[own]
        local = np.repeat(np.arange(b - a), n)
        window = np.arange(len(local)) - np.repeat(np.cumsum(n) - n, n)
        value = best[places(base[own], n)]
        better = value < doc[a:b][local]
        new = better & np.r_[True, ~better[:-1] | (value[1:] != value[:-1]) | (local[1:] != local[:-1])][:len(better)]
        last = better & np.r_[~better[1:] | new[1:], True][:len(better)]
        out.append(tuple(x.tobytes() for x in (local[new].astype("<u4"), window[new].astype("<u4"),
                                               window[last].astype("<u4"), value[new])))
    return pa.table({"chunk": table.column("chunk"), "group": table.column("group"),
                     **{n: pa.array([o[i] for o in out], pa.binary()) for i, n in enumerate(("stretch", "first", "last", "doc"))}})


def _spans(chunk: _Chunk, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of removed bytes begin, and where they end; a run ends with its text."""
    begins, ends = removed.copy(), removed.copy()
    begins[1:] &= ~removed[:-1]
    ends[:-1] &= ~removed[1:]
    inner = chunk.offs[:-1][chunk.offs[:-1] < len(removed)]
    begins[inner] = removed[inner]
    ends[inner[inner > 0] - 1] = removed[inner[inner > 0] - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _kept(chunk: _Chunk, removed: np.ndarray) -> Iterator[bytes]:
    for a, b in zip(chunk.offs[:-1].tolist(), chunk.offs[1:].tolist()):
        yield chunk.data[a:b][~removed[a:b]].tobytes()


def _digested(docs: list, chunk: _Chunk, removed: np.ndarray) -> pa.RecordBatch:
    count = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[chunk.offs])
    spans = np.diff(np.searchsorted(_spans(chunk, removed)[0], chunk.offs))
    return pa.record_batch([
        pa.array(docs, pa.int64()), pa.array(np.diff(chunk.offs)), pa.array(count(removed)), pa.array(spans),
        pa.array([hashlib.sha256(x).hexdigest() for x in _kept(chunk, removed)], pa.string())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cleaned(docs: list, chunk: _Chunk, removed: np.ndarray) -> pa.RecordBatch:
    starts, ends = _spans(chunk, removed)
    cuts = np.searchsorted(starts, chunk.offs)
    own = np.repeat(chunk.offs[:-1], np.diff(cuts))
    spans = pa.StructArray.from_arrays([pa.array(starts - own), pa.array(ends - starts)], ["start", "length"])
    return pa.record_batch([
        pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans),
        pa.array(list(_kept(chunk, removed)), pa.binary())], names=["doc_id", "spans", "kept"])


def _remove(groups: int, cleaned: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                chunk = _Chunk(row)
                (group, _, _, size, doc), (first, sizes, owner_doc, owner, number) = chunk.stretches(groups, row["flags"] or [])
                windows = size - LENGTH + 1
                base = np.cumsum(windows) - windows
                best = np.repeat(doc, windows)
                order = np.argsort(group, kind="stable")
                cuts = np.searchsorted(group[order], np.arange(groups + 1))
                for f in row["found"] or []:
                    own = order[cuts[f["group"]]:cuts[f["group"] + 1]]
                    at, low, high = (np.frombuffer(f[c], "<u4").astype(np.int64) for c in ("stretch", "first", "last"))
                    value, n = np.frombuffer(f["doc"], np.int64), high - low + 1
                    slots = places(base[own[at]] + low, n)
                    best[slots] = np.minimum(best[slots], np.repeat(value, n))
                n = sizes - LENGTH + 1
                gone = best[places(base[number], n)] < np.repeat(owner_doc, n)
                hit = places(first, n)[gone]
                change = np.zeros(len(chunk.data) + 1, np.int64)
                np.add.at(change, hit, 1)
                np.add.at(change, hit + LENGTH, -1)
                removed = np.cumsum(change[:-1]) > 0
                for i in np.flatnonzero(chunk.copies).tolist():
                    if chunk.offs[i + 1] - chunk.offs[i] >= LENGTH:
                        removed[chunk.offs[i]:chunk.offs[i + 1]] = True
                yield (_cleaned if cleaned else _digested)(row["docs"], chunk, removed)
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (runs of removed bytes), kept_sha256.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
    document of smaller identifier.  Null counts as empty; shorter texts lose
    nothing.  Rows that repeat an identifier are the same document, so they take
    nothing from each other; a row without identifier is compared as the largest.
    """
    return _without_repeats(docs, id_col, text_col, False)


def clean_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans (start and length of each run of removed bytes), kept (the bytes that remain).

    What goes is what ``remove_repeats`` counts.  Spans begin and end at any
    byte, also within a character, so ``kept`` is binary.
    """
    return _without_repeats(docs, id_col, text_col, True)


def _without_repeats(docs: DataFrame, id_col: str, text_col: str, cleaned: bool) -> DataFrame:
    spark = docs.sparkSession
    none = np.iinfo(np.int64).max
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("doc"), F.col(text_col).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = max(4, -(-total // BUCKET)), max(8, -(-total // GROUP))
    name, folder = f"chunks_{uuid.uuid4().hex}", new_folder(spark, "chunks")
    (_pack(own, CHUNK).write.bucketBy(int(buckets), "chunk").option("path", folder).saveAsTable(name))
    chunks = spark.table(name)
    try:
        texts_seen = settle(_digests(chunks))
        firsts = texts_seen.groupBy("digest").agg(F.min("doc").alias("low"))
        copies = settle(texts_seen.join(firsts, "digest").where("doc > low").groupBy("chunk")
                        .agg(F.collect_list("place").alias("copies")))
        kept = _with(chunks, copies)
        flags = settle(kept.mapInArrow(_ask(groups), "group long, chunk long, anchors binary, twice binary")
                       .groupBy("group").applyInArrow(_answer, "chunk long, group long, again binary, hot binary")
                       .groupBy("chunk").agg(F.collect_list(F.struct("group", "again", "hot")).alias("flags")))
        flagged = _with(kept, flags)
        found = settle(flagged.mapInArrow(_send(groups), "group long, chunk long, keys binary, sizes binary, docs binary, data binary")
                       .groupBy("group").applyInArrow(_compare, "chunk long, group long, stretch binary, first binary, last binary, doc binary")
                       .groupBy("chunk").agg(F.collect_list(F.struct("group", "stretch", "first", "last", "doc")).alias("found")))
        result = settle(_with(flagged, found).mapInArrow(
            _remove(groups, cleaned), "doc_id long, spans array<struct<start: long, length: long>>, kept binary" if cleaned
            else "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    finally:
        spark.sql(f"DROP TABLE {name}")
    return result.withColumn("doc_id", F.when(F.col("doc_id") != none, F.col("doc_id")))


def _with(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks with their answers; the chunks stay where their bucket is."""
    return chunks.join(answers.hint("shuffle_hash"), "chunk", "left")
