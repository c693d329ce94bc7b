"""Near duplicates by fast similarity sketches, banding and exact verification.

Sketching follows Dahlgaard, Knudsen and Thorup (Fast Similarity Sketching,
2017): in round i every element of a set is hashed to one of t bins with a
value that begins with i; rounds from t on send every element to bin i - t.  So
every coordinate is filled after 2t rounds at most, usually after about
t log t / n, and the share of equal coordinates concentrates around the
similarity.  Rows whose bands collide are compared on their full sets.

Documents with equal sets are one node; a node that is named by a document with
several sets has each of them, told apart by a hash of their digests.  In each bucket of a band all nodes are
first linked to one leader.  What is still apart then is compared with further
leaders, chosen among the parts; the links between all members of a bucket are
never written.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.work import settle
from sievework.llm import grouped, texts
from sievework.llm.components import components, stars

#: Coordinates in a band.
BAND_ROWS = 4
#: Probability at most with which a pair just at the threshold shares no band.
MISS = 1e-8


def n_bands(threshold: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(threshold ** rows, 1 - 1e-12))))


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches, one row of t coordinates per set; the rows of empty sets mean nothing."""
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), t), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    rows = np.repeat(np.arange(len(sets), dtype=np.int64) * t, sizes)
    for i in range(2 * t):
        if not len(items):
            break
        h = texts.mix(items + texts.salt(i))
        value = (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, rows + bins, value)
        filled = out.max(axis=1) != np.iinfo(np.uint64).max
        if filled.any():
            stay = ~filled[rows // t]
            items, rows = items[stay], rows[stay]
    return out


def bands(sketch: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A 64-bit key for each band of each sketch; keys of different bands differ."""
    n = sketch.shape[1] // rows
    keys = np.zeros((len(sketch), n), np.uint64)
    for j in range(rows):
        keys = texts.mix(keys + sketch[:, j:n * rows:rows])
    return texts.mix(keys + texts.mix(np.arange(1, n + 1, dtype=np.uint64)))


#: Members of a bucket in one block; a group compares two blocks.
BLOCK = 256
#: Shingles that a group compares in one step.
COLUMNS = 8192
#: Shingles of the members that are compared with one leader in one group.
GROUP_SHINGLES = 250_000
#: Bits of the filter of wanted documents: 16 for each of them, but no more than 2^27 (16 MB).
FILTER_BITS = 1 << 27
#: Words of the filter that come to the driver as one row.
FILTER_PART = 1 << 16


def digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _sketch_table(docs: DataFrame, width: int, t: int, key: bytes) -> DataFrame:
    """doc, n (size of the set), digest of the set, and its bands (none for an empty set), for each (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in texts.pieces(batch.column(1)):
                sets = texts.shingle_sets(texts.LOWER[data], offs, width, key)
                keys = bands(sketches(sets, t)).view(np.int64)
                sizes = np.array([len(s) for s in sets])
                ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, keys.shape[1], 0)))).astype(np.int32)
                yield pa.record_batch([
                    batch.column(0)[a:b], pa.array(sizes),
                    pa.array([digest(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[sizes > 0].reshape(-1)))],
                    names=["doc", "n", "digest", "bands"])

    return docs.mapInArrow(run, "doc long, n long, digest binary, bands array<long>")


def _filter(wanted: DataFrame):
    """A broadcast bit filter of a column ``node``: bounded in size, it may let others pass but loses none."""
    spark = wanted.sparkSession
    bits = min(1 << max(16, (16 * wanted.count()).bit_length()), FILTER_BITS)
    place = F.pmod(F.xxhash64("node"), F.lit(bits))
    words = (wanted.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 31 AS INT))")).alias("bits")))

    def pack(group: pa.Table) -> pa.Table:
        """One range of the filter as bytes."""
        w, out = group.column("w").to_numpy(), np.zeros(FILTER_PART, np.uint32)
        out[w % FILTER_PART] = group.column("bits").to_numpy()
        return pa.table({"part": [int(w[0]) // FILTER_PART], "packed": [out.tobytes()]})

    table = np.zeros(max(bits // 32, FILTER_PART), np.uint32)
    parts = words.withColumn("part", F.expr(f"w DIV {FILTER_PART}")).groupBy("part").applyInArrow(pack, "part long, packed binary")
    for row in parts.coalesce(8).toLocalIterator():  # 16 MB in all, by eighths
        table[row.part * FILTER_PART:(row.part + 1) * FILTER_PART] = np.frombuffer(row.packed, np.uint32)
    shared = spark.sparkContext.broadcast(table)
    return shared, F.pmod(F.xxhash64("doc"), F.lit(bits))


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, key: bytes) -> DataFrame:
    """``wanted`` (node, set and more) with ``items``, the packed sorted set; ``set`` is the hash of the set's digest."""
    table, place = _filter(wanted.select("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            own = batch.filter(pa.array((table.value[at >> 5] >> (at & 31).astype(np.uint32) & 1) > 0))
            for a, b, data, offs in texts.pieces(own.column(1)):
                sets = texts.shingle_sets(texts.LOWER[data], offs, width, key)
                yield pa.record_batch([own.column(0)[a:b], pa.array([digest(s) for s in sets], pa.binary()),
                                       pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "digest", "items"])

    found = (docs.withColumn("place", place).mapInArrow(run, "node long, digest binary, items binary")
             .where(F.octet_length("items") > 0).select("node", F.xxhash64("digest").alias("set"), "items"))
    return found.join(wanted, ["node", "set"]).dropDuplicates(["node", "set"])


def _verify(pairs: DataFrame, sets: DataFrame, per_mille: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, compared leader by leader in groups of bounded size."""
    load = pairs.groupBy("a").agg(F.count("*").alias("deg"), F.max("size").alias("most"))
    groups = (F.col("deg") * F.col("most") / GROUP_SHINGLES).cast("long") + 1
    placed = load.select("a", groups.alias("groups"))
    leaders = (placed.join(sets, F.col("a") == F.col("node"))
               .select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"),
                       F.lit(None).cast("long").alias("b"), "items"))
    members = (pairs.join(placed, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("groups")))
               .join(sets, F.col("b") == F.col("node")).select("a", "part", "b", "items"))

    def run(table: pa.Table) -> pa.Table:
        a = table.column("a")[0].as_py()
        rows = [(b, np.frombuffer(x, np.uint64)) for b, x in zip(table.column("b").to_pylist(), table.column("items").to_pylist())]
        found = set()
        for own in (s for b, s in rows if b is None):
            for b, other in rows:
                if b is not None and b not in found:
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = int(np.count_nonzero(own[at] == other))
                    if 1000 * both >= per_mille * (len(own) + len(other) - both):
                        found.add(b)
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(sorted(found), pa.int64())})

    return grouped.by_key(leaders.unionByName(members), ["a", "part"], ["b"], run, "a long, b long")


def _candidates(table: pa.Table, per_mille: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows to compare it with) in a group of two blocks of a bucket's members.

    Only members of different components whose counts allow the similarity,
    and only in the first bucket that both share.
    """
    node, part, n, able, mine = (table.column(c).to_numpy() for c in ("node", "component", "n", "able", "mine"))
    key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
    keys = np.stack(table.column("bands").to_pylist()).astype(np.int64)
    band = int(np.flatnonzero((keys == key).all(axis=0))[0])
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    for x in left.tolist():
        y = right[(part[right] != part[x]) & ((node[right] > node[x]) if i == j else True)]
        y = y[(1000 + per_mille) * np.minimum(able[y], able[x]) >= per_mille * (n[y] + n[x])]
        y = y[~(keys[y, :band] == keys[x, :band]).any(axis=1)]
        if len(y):
            yield x, y


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many items each of the left sets shares with each of the right ones."""
    used = np.unique(np.concatenate((left, right)))
    place = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    items, number, often = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    number = (np.cumsum(often > 1) - 1)[number.reshape(-1)], (often > 1)[number.reshape(-1)]
    column, place = number[0][number[1]], place[number[1]]
    order = np.argsort(column, kind="stable")
    column, place = column[order], place[order]
    rows, cols = np.searchsorted(used, left), np.searchsorted(used, right)
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int((often > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        has = np.zeros((len(used), COLUMNS), np.float32)
        has[place[a:b], column[a:b] - start] = 1
        out += has[rows] @ has[cols].T
    return out


def _between_parts(members: DataFrame, sets: DataFrame, per_mille: int) -> DataFrame:
    """Links (a, b) between different components within a bucket, one for each two components of a group.

    ``members`` has key, node, set, component, n, able (shingles that another member
    has too) and bands.  Buckets are compared in pairs of blocks.  A first pass
    finds who has anyone to be compared with, so that only their sets travel;
    the pairs themselves are never written.
    """
    # The component of a member taken at random is most often the largest one.
    rest = F.col("component") != F.col("main")
    heads = members.groupBy("key").agg(F.max_by("component", F.xxhash64("set", F.lit("main"))).alias("main"))
    own = members.join(heads, "key")
    blocks = own.groupBy("key").agg(F.ceil(F.count_if(rest) / BLOCK).alias("others"), F.ceil(F.count_if(~rest) / BLOCK).alias("same"))
    own = own.join(blocks, "key").withColumn("mine", F.when(rest, F.pmod(F.xxhash64("set"), F.col("others"))).otherwise(
        F.col("others") + F.pmod(F.xxhash64("set"), F.col("same"))))
    # A member meets a block of its bucket once, as the smaller or the larger of two block numbers; those of the main
    # component meet the others only.
    last = F.when(rest, F.col("others") + F.col("same") - 1).otherwise(F.col("others") - 1)
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    columns = ("key", "i", "j", "mine", "node", "set", "component", "n", "able", "bands")
    spread = spread.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).select(*columns)

    def involved(table: pa.Table) -> pa.Table:
        used = set()
        for x, y in _candidates(table, per_mille):
            used.add(x)
            used.update(y.tolist())
        return table.select(columns).take(pa.array(sorted(used), pa.int64()))

    def compare(table: pa.Table) -> pa.Table:
        node, part, n = (table.column(c).to_numpy() for c in ("node", "component", "n"))
        items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        pairs = list(_candidates(table, per_mille))
        found = {}
        if pairs:
            left, right = np.array([x for x, _ in pairs]), np.unique(np.concatenate([y for _, y in pairs]))
            both = _common(items, left, right)
            for row, (x, y) in enumerate(pairs):
                shared = both[row, np.searchsorted(right, y)].astype(np.int64)
                for other in y[1000 * shared >= per_mille * (n[x] + n[y] - shared)].tolist():
                    found.setdefault((part[x], part[other]), (int(node[x]), int(node[other])))
        return pa.table({"a": pa.array([a for a, _ in found.values()], pa.int64()),
                         "b": pa.array([b for _, b in found.values()], pa.int64())})

    schema = "key long, i long, j long, mine long, node long, set long, component long, n long, able long, bands array<long>"
    light = grouped.by_key(spread, ["key", "i", "j"], ["node"], involved, schema)
    return grouped.by_key(light.join(sets, ["node", "set"]), ["key", "i", "j"], ["node"], compare, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                threshold: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct runs of ``width`` words (words: runs of
    characters other than space and tab to carriage return, A-Z lower-cased);
    with fewer words, the whole sequence; null and empty texts and texts
    without words have an empty set and are linked with nothing.  Two documents
    are linked if the Jaccard similarity of their sets is at least
    ``threshold`` (in thousandths); sets are compared by 64-bit hashes of their
    shingles.  ``component_id`` is the smallest identifier reachable by links.
    Rows that repeat an identifier are one document with several sets; a row
    without identifier has no component and is kept.  A pair at the threshold
    is missed with a probability below ``MISS``.
    """
    per_mille = round(1000 * threshold)
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    key = os.urandom(16)
    table = settle(_sketch_table(own, width, n_bands(threshold) * BAND_ROWS, key))
    known = table.where("doc IS NOT NULL AND n > 0")
    same = known.groupBy("digest").agg(F.min("doc").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = settle(same.select("node", F.xxhash64("digest").alias("set"), "n", "bands", "digest"))

    slots = nodes.select("node", "set", "n", F.explode("bands").alias("key"))
    crowded = slots.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.count("*").alias("size")).where("size > 1")
    slots = settle(slots.join(crowded.select("key", "lead"), "key"))
    sets = settle(sets_of(own, settle(slots.select("node", "set").distinct()), width, key))

    # First every member of a bucket with its leader; sizes alone rule many out.
    small, big = F.least("n", "lead.n"), F.greatest("n", "lead.n")
    pairs = (slots.where((F.col("node") != F.col("lead.node")) & (1000 * small >= per_mille * big))
             .select(F.col("lead.node").alias("a"), F.col("node").alias("b"), big.alias("size"))
             .groupBy("a", "b").agg(F.max("size").alias("size")))
    links = settle(_verify(pairs, sets, per_mille).unionByName(own_links(table, nodes)))
    parts = settle(components(links))

    # Then what lies in one bucket but in different components; leaders have been compared with everyone.
    placed = slots.where(F.col("node") != F.col("lead.node")).join(parts, "node", "left").select(
        "key", "node", "set", "n", F.coalesce("component", "node").alias("component"))
    mixed = settle(_still_mixed(placed))
    seen = mixed.select("node", "set").distinct().join(sets, ["node", "set"]).select("set", "items")
    alone = (_items(seen).groupBy("item").agg(F.min("set").alias("set"), F.max("set").alias("last")).where("set = last")
             .groupBy("set").agg(F.count("*").alias("alone")))
    able = (mixed.join(alone, "set", "left").withColumn("able", F.col("n") - F.coalesce("alone", F.lit(0)))
            .where(1000 * F.col("able") >= per_mille * F.col("n")))
    able = _still_mixed(able).join(nodes.select("node", "set", "bands"), ["node", "set"])
    more = _between_parts(able, sets, per_mille)
    parts = components(stars(parts).unionByName(more))

    named = table.join(nodes.select("digest", "node"), "digest", "left").withColumn("node", F.coalesce("node", "doc"))
    named = named.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return named.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.col("component")).alias("component_id"),
        (F.col("doc").isNull() | (F.col("doc") == F.col("component"))).alias("kept"))


def own_links(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) of every document that has several sets, an empty one included, with the nodes of its sets."""
    several = (table.where("doc IS NOT NULL").groupBy("doc").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
               .where("low < high").select("doc"))
    return (table.select("doc", "digest").join(several, "doc", "left_semi").join(nodes.select("digest", "node"), "digest")
            .where("node <> doc").select(F.col("node").alias("a"), F.col("doc").alias("b")).distinct())


def _still_mixed(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    mixed = (members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low < high").select("key"))
    return members.join(mixed, "key")


def _items(sets: DataFrame) -> DataFrame:
    """(set, item) for every member of the packed sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items = np.frombuffer(raw, np.int64)
                yield pa.record_batch([pa.array(np.full(len(items), own)), pa.array(items)], names=["set", "item"])

    return sets.mapInArrow(run, "set long, item long")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
              threshold: float = 0.8) -> DataFrame:
    """The input rows, all columns, with one document of each near-duplicate group: the one of smallest identifier."""
    gone = (near_groups(docs, id_col, text_col, width, threshold).where("NOT kept")
            .select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
