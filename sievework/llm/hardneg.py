"""Hard negatives for contrastive training, from exact integer scores.

Vectors are quantised to integers.  Scores are inner products in a residue
number system: the matrices are multiplied modulo several small primes in
float32, where every sum stays an exact integer, and the signed scores follow
by Chinese remaindering in mixed radix.

Anchors meet rows in tiles, blocks of anchors by blocks of rows, one group of
a shuffle each.  A first pass over the tiles gives every anchor its positives,
a second one the negatives within the window that each positive's score opens.
A tile returns only the few best of each anchor or window; a window function
then ranks those of all tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.work import settle

# Primes just below 1024.
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)
#: Rows and anchors in a tile, and scores that are held at once.
ROW_BLOCK, ANCHOR_BLOCK, SCORES = 16_384, 16_384, 1 << 20
#: Rows in a tile at least, where there are too few tiles to keep all cores busy.
LEAST_BLOCK = 1024

_NEVER = np.iinfo(np.int64).min


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo p of smallest magnitude; exact in float32 for whole numbers below 2^24."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def moduli(left: np.ndarray, right: np.ndarray) -> list[int]:
    """As many primes as the largest possible score of two matrices' rows asks for.

    ValueError if a score, or a hundred times it, could exceed 64 bits.
    """
    most = [int(np.abs(x).max()) if x.size else 0 for x in (left, right)]
    bound, weight, used = max(1, left.shape[1] * most[0] * most[1]), 1, []
    if 100 * bound >= 1 << 63:
        raise ValueError("scores of these vectors exceed 64 bits")
    for p in PRIMES:
        if weight <= 2 * bound:
            used.append(p)
            weight *= p
    return used


def residues(matrix: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """A component matrix per prime: residues of smallest magnitude in float32."""
    return [((matrix + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def residue_product(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The exact inner products of the rows of two integer matrices, given by their residues."""
    total, weight = None, 1
    for a, b, p in zip(left, right, primes):
        half = p // 2
        step = (1 << 24) // (half * half)
        residue = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, a.shape[1], step):
            # A block's sum is below 2^24; its residue is added to one below p.
            residue = _centred(residue + _centred(a[:, at:at + step] @ b[:, at:at + step].T, p), p)
        # The next digit in mixed radix, of smallest magnitude, so that the number is signed.
        digit = residue.astype(np.int64)
        if total is None:
            total = (digit + half) % p - half
        else:
            digit = (digit - total % p) * pow(weight, -1, p)
            total += weight * ((digit + half) % p - half)
        weight *= p
    return total


def first_columns(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of its k highest allowed scores, lower columns first among equals; -1 where there are no more."""
    rows, n = scores.shape
    k = min(k, n)
    if not k or not rows:
        return np.full((rows, k), -1)
    if max(int(scores.max()), -int(scores.min())) < (1 << 62) // n - 1:
        key = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), _NEVER)
        at = np.argpartition(key, n - k, axis=1)[:, n - k:]
        own = np.take_along_axis(key, at, 1)
        order = np.argsort(own, axis=1)[:, ::-1]
        return np.where(np.take_along_axis(own, order, 1) == _NEVER, -1, np.take_along_axis(at, order, 1))
    out = np.full((rows, k), -1)
    for row in range(rows):
        columns = np.flatnonzero(allowed[row])
        best = columns[np.lexsort((columns, -scores[row, columns]))][:k]
        out[row, :len(best)] = best
    return out


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones are filled with zeros."""
    lists = column.combine_chunks()
    values, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


class _Tile:
    """Anchors and rows of one group; rows by identifier, a missing one last."""

    def __init__(self, table: pa.Table):
        width = max((w for w in table.column("vec").combine_chunks().value_lengths().to_pylist()), default=0)
        is_anchor = table.column("asks")
        self.anchors = table.filter(is_anchor)
        rows = table.filter(pc.invert(is_anchor))
        self.rows = rows.sort_by([("id", "ascending"), ("uid", "ascending")])
        labels = pa.concat_arrays([self.anchors.column("label").combine_chunks(), self.rows.column("label").combine_chunks()])
        codes = labels.dictionary_encode().indices.to_numpy()
        self.anchor_labels, self.row_labels = codes[:len(self.anchors)], codes[len(self.anchors):]
        self.anchor_uids, self.row_uids = (t.column("uid").to_numpy() for t in (self.anchors, self.rows))
        self.left, self.right = _matrix(self.anchors.column("vec"), width), _matrix(self.rows.column("vec"), width)

    def scores(self):
        """(first anchor, scores of some anchors with all rows, whether labels are equal), block by block."""
        if not len(self.left) or not len(self.right):
            return
        step = max(1, SCORES // len(self.right))
        primes = moduli(self.left, self.right)
        left, right = residues(self.left, primes), residues(self.right, primes)
        for at in range(0, len(self.left), step):
            same = self.anchor_labels[at:at + step, None] == self.row_labels
            yield at, residue_product([x[at:at + step] for x in left], right, primes), same


def _tiles(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Every row with every block of anchors and every anchor with every block of rows, dealt out by (i, j)."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    high = max(-(-n_rows // ROW_BLOCK), min(3 * cores, -(-n_rows // LEAST_BLOCK)), 1)
    wide = max(-(-n_anchors // ANCHOR_BLOCK), 1)

    def blocks(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    own = F.pmod(F.xxhash64("uid"), F.lit(high)).cast("int")
    left = rows.withColumn("i", own).withColumn("j", blocks(wide)).withColumn("asks", F.lit(False))
    own = F.pmod(F.xxhash64("uid"), F.lit(wide)).cast("int")
    right = anchors.withColumn("j", own).withColumn("i", blocks(high)).withColumn("asks", F.lit(True))
    return left.unionByName(right, allowMissingColumns=True).repartition(min(high * wide, 20_000), "i", "j").groupBy("i", "j")


def mine(rows: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """One row per hard negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``asks`` holds.  A score is the inner
    product of two vectors whose components x became floor(scale * x).  An
    anchor's positives are its ``positives`` best other rows of the same label;
    for each of them the ``negatives`` best rows of another label follow whose
    score lies within ``low`` to ``high`` percent of the positive's.  Higher
    scores come first, then smaller identifiers.

    Rows with a missing label or vector or with a component that is missing,
    NaN or infinite take no part.  Repeated rows are rows of their own, each
    anchor among them gives its own results; a missing identifier comes after
    all others.  Vectors of unequal length count as filled with zeros.
    Anchors without positives and positives without negatives give no row,
    an empty table none.  Quantised components beyond 32 bits, or scores beyond 64, stop the job.
    """
    vec = F.col(vector_col).cast("array<double>")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    table = settle(
        rows.where(F.col(label_col).isNotNull() & vec.isNotNull() & sound)
        .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x).cast("int")).alias("vec"),
                F.coalesce(asks.cast("boolean"), F.lit(False)).alias("asks"))
        .withColumn("uid", F.monotonically_increasing_id()))
    n_rows, n_anchors = table.agg(F.count("*"), F.count_if("asks")).first()
    everyone = table.select("uid", "id", "label", "vec")
    anchors = table.where("asks").select("uid", "id", "label", "vec")

    def near(group: pa.Table) -> pa.Table:
        tile, out = _Tile(group), []
        for at, scores, same in tile.scores():
            same &= tile.anchor_uids[at:at + len(same), None] != tile.row_uids
            best = first_columns(scores, same, positives)
            row, slot = np.nonzero(best >= 0)
            out.append((at + row, best[row, slot], scores[row, best[row, slot]]))
        who, which, score = map(np.concatenate, zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"uid": tile.anchor_uids[who], "other": tile.row_uids[which],
                         "positive_id": tile.rows.column("id").take(pa.array(which)), "positive_score": score})

    found = (_tiles(everyone, anchors, n_rows, n_anchors)
             .applyInArrow(near, "uid long, other long, positive_id long, positive_score long"))
    order = Window.partitionBy("uid").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "other")
    chosen = found.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= positives)
    windows = settle(chosen.groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("slot", "positive_id", "positive_score"))).alias("windows")))

    def hard(group: pa.Table) -> pa.Table:
        tile, out = _Tile(group), []
        opened = tile.anchors.column("windows").to_pylist()
        ids = [[w["positive_id"] for w in own] for own in opened]
        for at, scores, same in tile.scores():
            for slot in range(positives):
                asked = np.array([i for i in range(len(scores)) if slot < len(opened[at + i])], np.int64)
                goal = np.array([opened[at + i][slot]["positive_score"] for i in asked], np.int64)
                own = scores[asked]
                inside = ~same[asked] & (low * goal[:, None] <= 100 * own) & (100 * own <= high * goal[:, None])
                best = first_columns(own, inside, negatives)
                row, place = np.nonzero(best >= 0)
                out.append((at + asked[row], np.full(len(row), slot), best[row, place], goal[row], own[row, best[row, place]]))
        who, slot, which, goal, score = map(np.concatenate, zip(*out)) if out else (np.zeros(0, np.int64),) * 5
        return pa.table({
            "uid": tile.anchor_uids[who], "anchor_id": tile.anchors.column("id").take(pa.array(who)),
            "slot": pa.array(slot, pa.int32()),
            "positive_id": pa.array([ids[w][s] for w, s in zip(who.tolist(), slot.tolist())], pa.int64()),
            "positive_score": goal, "negative_id": tile.rows.column("id").take(pa.array(which)), "negative_score": score,
            "other": tile.row_uids[which]})

    found = _tiles(everyone, anchors.join(windows, "uid"), n_rows, n_anchors).applyInArrow(
        hard, "uid long, anchor_id long, slot int, positive_id long, positive_score long, negative_id long, "
              "negative_score long, other long")
    order = Window.partitionBy("uid", "slot").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "other")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
