"""Similarity join of shingle sets by parity sketches.

A sketch is a row of bits, and each shingle flips the one it is hashed to; two
sketches differ in no more bits than their sets differ in shingles.  Sets are
dealt into bands of sizes such that similar ones lie in the same or in
neighbouring bands.  Where sets of a pair of bands may differ in d shingles,
their sketches are cut into d + 1 words; similar sets then agree in one word
at least, and meet in the bucket of that band, word number and word.  Words with
hardly a shingle are the same by chance in many sets.  So sketches have 2 r
words more, and each set leaves out the r words to which it has the fewest
shingles; one of the words on which similar sets agree is still in both.

In a bucket all sets are first compared with one leader, in large ones those of
other components with further leaders.  Sets that are in
different components after that are compared with each other: their sketches
first, whose distance rules out nearly all that are not similar, then the full
sets.  A bucket crowded by many components is dealt anew by another,
independent sketch; the others are compared block by block, but for blocks of
one component.  No link between components is lost at any of these steps, and
the links within a component are not written.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.work import release, settle
from sievework.llm import grouped, minhash, texts
from sievework.llm.components import components, stars

#: Members of a bucket from which it gets further leaders, and how many; components from which it is dealt anew, and how often.
CROWD, LEADERS, PARTS, LEVELS = 64, 4, 1024, 2
#: Of so many words of a sketch a set leaves one out.
LEAVE = 32
#: Members of a crowded bucket in one block; a group compares two blocks.
BLOCK = 256
#: Shingles that are compared with one leader in one group.
GROUP_SHINGLES = 250_000
#: Words of sketches that are compared at once.
WORDS = 1 << 20
#: Bytes of sets that are compared with leaders in one task; every turn then has as many tasks as its pairs need.
TASK_BYTES = 8 << 20
#: Sets up to which their numbers are broadcast, so that the other sets are not shuffled with them.
FEW = 200_000


class Bands:
    """Bands of set sizes for a similarity, given in thousandths."""

    def __init__(self, per_mille: int, most: int = 1 << 40):
        self.per_mille = per_mille
        lows = [1]
        while lows[-1] <= most:
            # The smallest size that cannot be similar to the smallest of this band.
            lows.append(1000 * lows[-1] // per_mille + 1)
        self.lows = np.array(lows)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, "right") - 1

    def differ(self, group: int) -> int:
        """In how many shingles similar sets of a band, or of a band and the next one, can differ."""
        small = int(self.lows[group + 1]) - 1
        large = 1000 * small // self.per_mille
        return (small + large) * (1000 - self.per_mille) // (1000 + self.per_mille)

    def left_out(self, group: int) -> int:
        return (self.differ(group) + 1) // LEAVE

    def words(self, group: int) -> int:
        return self.differ(group) + 1 + 2 * self.left_out(group)


def sketches(sets: list[np.ndarray], words: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of all sketches end to end, shingles in each, offsets): per set as many 64-bit words as asked for."""
    sizes = np.array([len(s) for s in sets])
    offs = np.concatenate(([0], np.cumsum(words)))
    out = np.zeros(offs[-1], np.uint64)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if not len(items):
        return out, out.astype(np.int64), offs
    h = texts.mix(items + texts.salt(seed))
    place = ((h >> np.uint64(32)) * np.repeat(words, sizes).astype(np.uint64) >> np.uint64(32)) + np.repeat(offs[:-1], sizes).astype(np.uint64)
    flips = np.sort(place << np.uint64(6) | h & np.uint64(63))
    at = (flips >> np.uint64(6)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out[at[first]] = np.bitwise_xor.reduceat(np.uint64(1) << (flips & np.uint64(63)), first)
    return out, np.bincount(at, minlength=len(out)), offs


def _lists(sets: list[np.ndarray], groups: np.ndarray, bands: Bands, seed: int) -> pa.Array:
    """The sketches for a group of bands each; empty for groups below the first and for empty sets.

    Words that a set leaves out are null.
    """
    asked = np.array([bands.words(g) if g >= 0 and len(s) else 0 for g, s in zip(groups.tolist(), sets)], np.int64)
    flat, held, offs = sketches([s if n else s[:0] for s, n in zip(sets, asked)], asked, seed)
    gone = np.zeros(len(flat), bool)
    for g, a, b in zip(groups.tolist(), offs[:-1].tolist(), offs[1:].tolist()):
        few = bands.left_out(g) if a < b else 0
        if few:
            gone[a + np.argpartition(held[a:b], few - 1)[:few]] = True
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat.view(np.int64), mask=gone))


def _set_table(docs: DataFrame, width: int, bands: Bands, key: bytes, sketched: bool) -> DataFrame:
    """doc, n (size of the set), digest of the set and, if asked for, band and the sketches for it and the one below."""
    schema = "doc long, n long, digest binary" + ", band long, here array<long>, below array<long>" * sketched

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in texts.pieces(batch.column(1)):
                sets = texts.shingle_sets(texts.LOWER[data], offs, width, key)
                sizes = np.array([len(s) for s in sets])
                out = [batch.column(0)[a:b], pa.array(sizes), pa.array([minhash.digest(s) for s in sets], pa.binary())]
                if sketched:
                    band = bands.of(sizes)
                    out += [pa.array(band), _lists(sets, band, bands, 0), _lists(sets, band - 1, bands, 0)]
                yield pa.record_batch(out, names=["doc", "n", "digest", "band", "here", "below"][:len(out)])

    return docs.mapInArrow(run, schema)


def _again(members: DataFrame, sets: DataFrame, bands: Bands, seed: int) -> DataFrame:
    """uid, grp, band and the words of a sketch for each of some members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(3)]
            yield pa.record_batch([*batch.columns[:3], _lists(items, batch.column(1).to_numpy(), bands, seed)],
                                  names=["uid", "grp", "band", "words"])

    own = settle(members.select("uid", "grp").distinct())
    own = own.join(_picked(sets, own, own.count()), "uid").select("uid", "grp", "band", "items")
    return own.mapInArrow(run, "uid long, grp long, band long, words array<long>")


#: In a rank, the bit above the member's number: whether it is of the group's upper band.
UPPER = 1 << 62


def _slots(sketched: DataFrame, seed: int) -> DataFrame:
    """key, rank, pos, lead: the members of all buckets with more than one, and the leader of each.

    A rank is the member's number, with one bit more in the upper band of its
    group.  The lowest rank leads; a bucket without a member of the lower band
    is left to the group above.  Nothing else travels with the many words that
    no other member has.
    """
    rank = F.col("uid").bitwiseOR((F.col("band") - F.col("grp")) * F.lit(UPPER))
    one = sketched.select("grp", rank.alias("rank"), F.posexplode("words").alias("pos", "word"))
    one = one.where("word IS NOT NULL").select(F.xxhash64(F.lit(seed), "grp", "pos", "word").alias("key"), "rank", "pos")
    heads = (one.groupBy("key").agg(F.min("rank").alias("lead"), F.count("*").alias("size"))
             .where((F.col("size") > 1) & (F.col("lead") < UPPER)).select("key", "lead"))
    return one.join(heads, "key")


def _picked(sets: DataFrame, uids: DataFrame, most: int) -> DataFrame:
    """The sets with one of ``most`` numbers at most; all sets where those are many."""
    return sets.join(F.broadcast(uids.select("uid").distinct()), "uid", "left_semi") if most <= FEW else sets


def _compared(pairs: DataFrame, sets: DataFrame, about: DataFrame, per_mille: int) -> DataFrame | None:
    """Links (a, b) among pairs (lead, uid), verified on full sets in groups of bounded size; None without a pair."""
    sizes = about.select("uid", "n")
    pairs = settle(pairs.distinct().join(sizes.select(F.col("uid").alias("lead"), F.col("n").alias("m")), "lead").join(sizes, "uid"))
    # Sizes alone rule many out.
    fit = per_mille * F.greatest("m", "n") <= 1000 * F.least("m", "n")
    every, left, items = pairs.agg(F.count("*"), F.count_if(fit), F.coalesce(F.sum(F.when(fit, F.col("n"))), F.lit(0))).first()
    if not every:
        return None
    pairs = pairs.where(fit)
    used = pairs.select("uid").unionByName(pairs.select(F.col("lead").alias("uid")))
    sets = _picked(sets, used, 2 * left)
    tasks = min(1 + 8 * items // TASK_BYTES, grouped.n_tasks(sets.sparkSession))
    load = (pairs.groupBy("lead").agg(F.count("*").alias("deg"), F.max("m").alias("n"))
            .select("lead", (F.col("deg") * F.col("n") / GROUP_SHINGLES).cast("long").alias("parts")))
    leads = load.select(F.col("lead").alias("uid"), "lead", F.explode(F.sequence(F.lit(0).cast("long"), "parts")).alias("part"),
                        F.lit(0).alias("second"))
    others = pairs.join(load, "lead").select("uid", "lead", F.pmod(F.xxhash64("uid"), F.col("parts") + 1).alias("part"), F.lit(1).alias("second"))
    placed = leads.unionByName(others).join(sets, "uid").select("lead", "part", "second", "node", "items")

    def compare(group: pa.Table) -> pa.Table:
        items, nodes = group.column("items"), group.column("node").to_pylist()
        own = np.frombuffer(items[0].as_py(), np.uint64)
        found = [b for b, raw in zip(nodes[1:], items[1:]) if _jaccard(own, np.frombuffer(raw.as_py(), np.uint64), per_mille)]
        return pa.table({"a": pa.array([nodes[0]] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return grouped.by_key(placed, ["lead", "part"], ["second"], compare, "a long, b long", tasks)


def _jaccard(one: np.ndarray, other: np.ndarray, per_mille: int) -> bool:
    if per_mille * max(len(one), len(other)) > 1000 * min(len(one), len(other)):
        return False
    at = np.minimum(np.searchsorted(one, other), len(one) - 1)
    both = int(np.count_nonzero(one[at] == other))
    return 1000 * both >= per_mille * (len(one) + len(other) - both)


def _candidates(group: pa.Table, per_mille: int) -> list[tuple[int, int]]:
    """Pairs of rows in a group of two blocks whose sizes, components and sketches leave open that they are similar.

    Sketches that agree in an earlier word meet in an earlier bucket, so only
    the first one takes the pair.  Nearest sketches come first.
    """
    part, n, band, mine = (group.column(c).to_numpy() for c in ("component", "n", "band", "mine"))
    i, j, grp, pos = (group.column(c)[0].as_py() for c in ("i", "j", "grp", "pos"))
    words = group.column("words").combine_chunks().flatten()
    held = words.is_valid().to_numpy(zero_copy_only=False).reshape(len(group), -1)
    words = words.fill_null(0).to_numpy().view(np.uint64).reshape(len(group), -1)
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    found = []
    step = max(1, WORDS // max(1, len(right) * words.shape[1]))
    for at in range(0, len(left), step):
        x = left[at:at + step, None]
        y = right[None, :]
        total = n[x] + n[y]
        open_ = (part[x] != part[y]) & (np.minimum(band[x], band[y]) == grp)
        open_ &= per_mille * np.maximum(n[x], n[y]) <= 1000 * np.minimum(n[x], n[y])
        if i == j:
            open_ &= x < y
        rows, cols = np.nonzero(open_)
        if len(rows):
            both = held[left[at + rows]] & held[right[cols]]
            differ = np.where(both, words[left[at + rows]] ^ words[right[cols]], 0)
            bits = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
            met = both[:, :pos] & (differ[:, :pos] == 0)
            fits = (bits * (1000 + per_mille) <= total[rows, cols] * (1000 - per_mille)) & ~met.any(axis=1)
            found += zip(bits[fits].tolist(), left[at + rows[fits]].tolist(), right[cols[fits]].tolist())
    return [(x, y) for _, x, y in sorted(found)]


def _between(members: DataFrame, sets: DataFrame, per_mille: int) -> DataFrame:
    """Links (a, b) between members of a bucket in different components, one for each two components of a group.

    ``members`` has key, grp, pos, uid, node, n, band, component, words.  A
    bucket of more than ``BLOCK`` members is compared in pairs of blocks.  A
    first pass finds whose sketches are near another one's, so that only their
    sets travel; the pairs themselves are not written.
    """
    # The component of a member taken at random is most often the largest one.
    rest = F.col("component") != F.col("main")
    heads = members.groupBy("key").agg(F.max_by("component", F.xxhash64("uid", F.lit("main"))).alias("main"))
    own = members.join(heads, "key")
    blocks = own.groupBy("key").agg(F.ceil(F.count_if(rest) / BLOCK).alias("others"), F.ceil(F.count_if(~rest) / BLOCK).alias("same"))
    own = own.join(blocks, "key").withColumn("mine", F.when(rest, F.pmod(F.xxhash64("uid"), F.col("others"))).otherwise(
        F.col("others") + F.pmod(F.xxhash64("uid"), F.col("same"))))
    # A member meets a block of its bucket once, as the smaller or the larger of two block numbers; those of the main
    # component meet the others only.
    last = F.when(rest, F.col("others") + F.col("same") - 1).otherwise(F.col("others") - 1)
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    columns = ["key", "i", "j", "mine", "grp", "pos", "uid", "node", "n", "band", "component", "words"]
    own = own.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).select(*columns)
    schema = ", ".join(f"{c} {'array<long>' if c == 'words' else 'int' if c == 'pos' else 'long'}" for c in columns)

    def involved(group: pa.Table) -> pa.Table | None:
        used = sorted({x for pair in _candidates(group, per_mille) for x in pair}) if len(group) > 1 else []
        return group.take(pa.array(used)) if used else None

    def compare(group: pa.Table) -> pa.Table:
        node, part = group.column("node").to_pylist(), group.column("component").to_pylist()
        items, found = group.column("items"), {}
        for x, y in _candidates(group, per_mille):
            if (part[x], part[y]) not in found and (part[y], part[x]) not in found:
                if _jaccard(*(np.frombuffer(items[i].as_py(), np.uint64) for i in (x, y)), per_mille):
                    found[part[x], part[y]] = node[x], node[y]
        return pa.table({"a": pa.array([a for a, _ in found.values()], pa.int64()),
                         "b": pa.array([b for _, b in found.values()], pa.int64())})

    near = settle(grouped.by_key(own, ["key", "i", "j"], ["uid"], involved, schema))
    sets = _picked(sets.select("uid", "items"), near, near.count())
    return grouped.by_key(near.join(sets, "uid"), ["key", "i", "j"], ["uid"], compare, "a long, b long")


def _mixed(members: DataFrame, parts: DataFrame, turn: int) -> DataFrame:
    """The members of the buckets that hold several components, with those, and with another leader for each bucket."""
    placed = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    head = F.max_by(F.struct("uid", "component", "upper"), F.xxhash64("uid", F.lit(turn)))
    mixed = (placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("upper").alias("least"), head.alias("head"),
        F.approx_count_distinct("component").alias("parts"), F.count("*").alias("size"))
        .where("low < high AND least = 0").select("key", "head", "parts", "size"))
    return placed.join(mixed, "key")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    A document's set holds its distinct runs of ``width`` words (words: runs of
    characters other than space and tab to carriage return, A-Z lower-cased);
    with fewer words, the whole sequence; null and empty texts and texts
    without words have an empty set and are linked with nothing.  Two documents
    are linked if the Jaccard similarity of their sets is at least
    ``threshold`` (in thousandths).  Every such pair is found; sets are compared by 64-bit hashes of
    their shingles under a key drawn for the run.  ``component_id`` is the smallest identifier reachable by
    links.  Rows that repeat an identifier are one document with several sets;
    a row without identifier has no component.  An empty table gives no rows,
    and a text of any length is read whole.
    """
    per_mille = round(1000 * threshold)
    bands, key = Bands(per_mille), os.urandom(16)
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    table = settle(_set_table(own, width, bands, key, False))
    # The sketches are made in a reading of their own, so that only those of distinct sets are written.
    known = _set_table(own, width, bands, key, True).where("doc IS NOT NULL AND n > 0")
    nodes = known.groupBy("digest").agg(F.min("doc").alias("node"), *(F.first(c).alias(c) for c in ("n", "band", "here", "below")))
    nodes = settle(nodes.withColumn("uid", F.monotonically_increasing_id()))
    both = F.array(F.struct(F.col("band").alias("grp"), F.col("here").alias("words")),
                   F.struct((F.col("band") - 1).alias("grp"), F.col("below").alias("words")))
    slots = settle(_slots(nodes.select("uid", "band", F.inline(both)), 0))
    nodes = settle(nodes.select("uid", "node", "digest", "n", "band"))
    release(docs.sparkSession)
    number = F.col("rank").bitwiseAND(F.lit(UPPER - 1))
    about = settle(nodes.join(slots.select(number.alias("uid")).distinct(), "uid", "left_semi").select(
        "uid", "node", "n", "band", F.xxhash64("digest").alias("set")))
    sets = settle(minhash.sets_of(own, about, width, key).select("uid", "node", "band", "items"))
    about = about.drop("set")
    links = minhash.own_links(table, nodes)

    for level in range(LEVELS + 1):
        release(docs.sparkSession)
        # The leaders are left out from now on, when they have been compared with everyone.
        others = slots.where("rank <> lead").select("key", "pos", number.alias("uid"), F.shiftright("rank", 62).alias("upper"), "lead")
        found = _compared(others.select("lead", "uid"), sets, about, per_mille)
        links = settle(links if found is None else links.unionByName(found))
        members = others.drop("lead").join(about, "uid")
        del slots, others
        for turn in range(LEADERS + 1):
            parts = settle(components(links))
            links = stars(parts)
            # Components only grow, so buckets of one component are done with, and each turn reads those that the last one left.
            placed = settle(_mixed(members, parts, turn))
            members = placed.drop("component", "head", "parts", "size")
            release(docs.sparkSession)
            if turn == LEADERS:
                break
            large = placed.where((F.col("size") > CROWD) & F.expr("component <> head.component AND upper + head.upper < 2"))
            found = _compared(large.select(F.col("head.uid").alias("lead"), "uid"), sets, about, per_mille)
            if found is None:
                break
            links = settle(links.unionByName(found))
        placed = placed.drop("head", "size").withColumn("grp", F.col("band") - F.col("upper"))
        few = placed if level == LEVELS else placed.where(F.col("parts") <= PARTS)
        words = _again(few, sets, bands, level).drop("band")
        links = links.unionByName(_between(few.join(words, ["uid", "grp"]), sets, per_mille))
        crowded = placed.where(F.col("parts") > PARTS)
        if level == LEVELS or crowded.isEmpty():
            break
        slots = settle(_slots(settle(_again(crowded, sets, bands, level + 1)), level + 1))

    parts = components(links)
    named = table.select("doc", "n", "digest").join(nodes.select("digest", "node"), "digest", "left")
    named = named.withColumn("node", F.coalesce("node", "doc")).join(parts, "node", "left")
    return named.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("component", "node")).alias("component_id"))
