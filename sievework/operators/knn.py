"""k-nearest-neighbour imputation, exact or by random projections.

The feature space is cut into cells, and cells with too many rows are cut
again, each in a task of its own, until boxes are of bounded size.  A row with
missing targets first looks into its own box, which bounds how far its k-th
neighbour can be, and then only into the boxes that reach into that radius; they
are found level by level.  Box contents and the rows visiting a box are both
split into pieces, so a crowded box or a crowd of equal rows is spread over tasks.

The approximate search cuts randomly turned copies of the feature space in the
same way and looks into the own box of each copy only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.schema import as_number, col, is_missing, numeric_columns, require_columns, require_numeric
from sievework.functions.stats import deviation
from sievework.functions.work import settle

ROWS_PER_BOX = 4096
#: Cuts that lead from a cell to its parts; a cell has at most two to this power.
DEPTH = 10
SAMPLE_PER_BOX = 32
PIECE_ROWS = 50_000
#: Up to this many comparisons everything is one box, and one task makes so many of them.
SMALL_WORK, TASK_WORK = 1 << 32, 1 << 26
#: Turned copies of the feature space that the approximate search looks into.
TURNS = 8
MIN_VALID_SHARE = 0.80


@dataclass(frozen=True)
class _Plan:
    """What the fit found: usable features, their scaling, and the row counts."""

    features: list[str]
    centre: list[float]
    width: list[float]
    n_impute: int
    n_can_impute: int
    n_reference: int


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _fit(df: DataFrame, cols: Sequence[str], features: Sequence[str] | None) -> _Plan | None:
    require_columns(df, cols)
    require_numeric(df, cols)
    candidates = list(features) if features else [c for c in numeric_columns(df) if c not in cols]
    if not candidates:
        raise ValueError(f"k-NN imputation of {list(cols)} needs another numeric column")
    gap = ~_all([~is_missing(df, c) for c in cols])
    row = df.agg(F.count_if(gap).alias("gaps"), *[
        F.count_if(gap & ~is_missing(df, c)).alias(f"f{i}") for i, c in enumerate(candidates)]).first()
    n = row["gaps"]
    if n == 0:
        return None
    usable = [c for i, c in enumerate(candidates) if row[f"f{i}"] / n >= MIN_VALID_SHARE]
    if not usable:
        raise ValueError(
            f"k-NN imputation of {list(cols)}: no numeric column is valid in at least "
            f"{MIN_VALID_SHARE:.0%} of the {n} rows to impute")
    complete = _all([~is_missing(df, c) for c in usable])
    aggs = [F.count_if(gap & complete).alias("can"), F.count_if(~gap & complete).alias("ref")]
    for i, c in enumerate(usable):
        x = F.when(~gap & complete, as_number(c))
        aggs += [F.avg(x).alias(f"m{i}"), deviation(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    if row["can"] and not row["ref"]:
        raise ValueError("No rows with valid targets and features to learn from")
    return _Plan(usable, [row[f"m{i}"] or 0.0 for i in range(len(usable))],
                 [row[f"s{i}"] or 1.0 for i in range(len(usable))], n, row["can"], row["ref"])


def report(df: DataFrame, cols: Sequence[str], features: Sequence[str] | None = None) -> DataFrame:
    """``n_impute, n_can_impute, ratio, n_dropped`` in one row."""
    plan = _fit(df, cols, features)
    n, can = (plan.n_impute, plan.n_can_impute) if plan else (0, 0)
    return df.sparkSession.createDataFrame(
        [(n, can, can / n if n else 1.0, n - can)],
        "n_impute long, n_can_impute long, ratio double, n_dropped long")


# --- boxes ----------------------------------------------------------------


@dataclass(frozen=True)
class _Tree:
    """A complete binary tree of median cuts; node i has children 2i+1 and 2i+2."""

    depth: int
    dims: np.ndarray
    cuts: np.ndarray

    def part_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.dims[node]] >= self.cuts[node])
        return node - (2 ** self.depth - 1)


def _grow(sample: np.ndarray, depth: int) -> _Tree:
    dims = np.zeros(2 ** depth - 1, dtype=np.int64)
    cuts = np.zeros(2 ** depth - 1)
    held = {0: sample}
    for node in range(2 ** depth - 1):
        rows = held.pop(node)
        if len(rows):
            spread = rows.max(axis=0) - rows.min(axis=0)
            dims[node] = int(np.argmax(spread))
            cuts[node] = float(np.median(rows[:, dims[node]]))
        right = rows[:, dims[node]] >= cuts[node]
        held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
    return _Tree(depth, dims, cuts)


def _pieces(counts: DataFrame, by: str, rows: int) -> DataFrame:
    """``by, pieces``: into how many pieces of at most ``rows`` rows each group is cut."""
    return counts.select(by, F.ceil(F.col("n") / rows).alias("pieces"))


def _in_pieces(df: DataFrame, pieces: DataFrame, by: str, spread_by: str) -> DataFrame:
    return df.join(pieces, by).withColumn("piece", F.pmod(F.xxhash64(spread_by), F.col("pieces"))).drop("pieces")


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for a table that both sides of a cogroup are joined with."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def _extents(ref: DataFrame, z: list[str], by: str) -> DataFrame:
    return ref.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"lo_{c}") for c in z],
                               *[F.max(c).alias(f"hi_{c}") for c in z])


def _cut(ref: DataFrame, sizes: DataFrame, z: list[str]) -> DataFrame:
    """``box, depth, dims, cuts``: the cuts of every box with too many rows, from a bounded sample of each."""
    crowded = sizes.where(F.col("n") > ROWS_PER_BOX).withColumn(
        "depth", F.least(F.lit(DEPTH), F.ceil(F.log2(F.col("n") / ROWS_PER_BOX)).cast("int")))
    share = SAMPLE_PER_BOX * F.pow(F.lit(2.0), F.col("depth")) / F.col("n")
    # The sample only places the cuts; any cuts give the same neighbours.
    drawn = ref.join(crowded.withColumn("share", share).drop("n"), "box").where(F.rand(1) < F.col("share"))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = _grow(rows[z].to_numpy(dtype=float), int(rows["depth"].iloc[0]))
        return pd.DataFrame({"box": [rows["box"].iloc[0]], "depth": [tree.depth], "dims": [tree.dims.tolist()], "cuts": [tree.cuts.tolist()]})

    return drawn.select("box", "depth", *z).groupBy("box").applyInPandas(
        grow, "box long, depth int, dims array<long>, cuts array<double>")


def _descend(df: DataFrame, trees: DataFrame, z: list[str], spread_by: str) -> DataFrame:
    """The rows with ``box`` replaced by the part of it they lie in; boxes that are not cut have one part."""
    def move(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if len(rows):
            part = 0
            if len(tree):
                t = tree.iloc[0]
                part = _Tree(int(t["depth"]), np.asarray(t["dims"]), np.asarray(t["cuts"])).part_of(rows[z].to_numpy(dtype=float))
            rows["box"] = rows["box"] * 2 ** DEPTH + part
        return rows.drop(columns="piece")

    pieces = _pieces(_counts(df, "box"), "box", PIECE_ROWS)
    held = _in_pieces(df, pieces, "box", spread_by)
    cuts = trees.join(_fresh(pieces), "box").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    return held.groupBy("box", "piece").cogroup(cuts.drop("pieces").groupBy("box", "piece")).applyInPandas(move, df.schema)


def _gap_to_boxes(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each box."""
    out = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        v = x[:, j, None]
        d = np.maximum(np.maximum(low[None, :, j] - v, v - high[None, :, j]), 0.0)
        out += d * d
    return out


# --- neighbours -----------------------------------------------------------


def _nearest(queries: pd.DataFrame, refs: pd.DataFrame, z: list[str], targets: list[str], k: int) -> pd.DataFrame:
    """The k nearest reference rows of every query row (ties by reference id), within its radius."""
    refs = refs.sort_values("rid", kind="stable", na_position="first")
    r = refs[z].to_numpy(dtype=float)
    keep = min(k, len(r))
    parts = []
    step = max(1, 4_000_000 // max(1, len(r)))
    for start in range(0, len(queries) if keep else 0, step):
        block = queries.iloc[start:start + step]
        x = block[z].to_numpy(dtype=float)
        d = np.zeros((len(x), len(r)))
        for j in range(len(z)):
            diff = x[:, j, None] - r[None, :, j]
            d += diff * diff
        limit = np.minimum(np.partition(d, keep - 1, axis=1)[:, keep - 1], block["radius"].to_numpy(dtype=float))
        row, at = np.nonzero(d <= limit[:, None])
        dist = d[row, at]
        order = np.lexsort((at, dist, row))
        row, at, dist = row[order], at[order], dist[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        chosen = place < keep
        row, at, dist = row[chosen], at[chosen], dist[chosen]
        part = refs.iloc[at][["rid", *targets]].reset_index(drop=True)
        part.insert(0, "dist", dist)
        part.insert(0, "qid", block["qid"].to_numpy()[row])
        parts.append(part)
    if parts:
        return pd.concat(parts, ignore_index=True)
    return pd.DataFrame({c: [] for c in ("qid", "dist", "rid", *targets)})


def _search(queries: DataFrame, refs: DataFrame, z: list[str], targets: list[str], k: int, out: str,
            rows: tuple[int, int] = (PIECE_ROWS, PIECE_ROWS)) -> DataFrame:
    """Neighbours of queries (qid, z, radius, box) among the references of their box.

    A box is cut into pieces on both sides, of at most ``rows`` rows: queries
    visit every reference piece once, reference pieces are repeated per query piece.
    """
    left = _pieces(_counts(queries, "box"), "box", rows[0]).withColumnRenamed("pieces", "qpieces")
    right = _pieces(_counts(refs, "box"), "box", rows[1]).withColumnRenamed("pieces", "rpieces")
    both = left.join(right, "box")

    def every(pieces: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(pieces) - 1))

    q = queries.join(both, "box").withColumn("qp", F.pmod(F.xxhash64("qid"), F.col("qpieces"))).withColumn("rp", every("rpieces"))
    r = refs.join(_fresh(both), "box").withColumn("rp", F.pmod(F.xxhash64("rid", *z), F.col("rpieces"))).withColumn("qp", every("qpieces"))

    def nearest(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return _nearest(asked, known, z, targets, k)

    return q.groupBy("box", "qp", "rp").cogroup(r.groupBy("box", "qp", "rp")).applyInPandas(nearest, out)


def _levels(ref: DataFrame, imp: DataFrame, z: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """References and queries with the box they lie in, and how often boxes were cut.

    Cuts go on until no box has more than twice ``ROWS_PER_BOX`` rows, or until
    a crowded box can no longer be cut.
    """
    ref, imp = (df.withColumn("box", F.lit(0).cast("long")) for df in (ref, imp))
    depth, most = 0, None
    while True:
        sizes = settle(_counts(ref, "box"))
        largest = sizes.agg(F.max("n")).first()[0] or 0
        if largest <= 2 * ROWS_PER_BOX or largest == most:
            return ref, imp, depth
        most = largest
        trees = settle(_cut(ref, sizes, z))
        ref, imp = settle(_descend(ref, trees, z, "rid")), settle(_descend(imp, trees, z, "qid"))
        depth += 1


def _first_of_equals(ref: DataFrame, z: list[str], k: int) -> DataFrame:
    """Of rows with equal features only the first k can ever be neighbours."""
    first = Window.partitionBy(*z).orderBy("rid")
    return ref.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")


def _schemas(imp: DataFrame, ref: DataFrame, targets: list[str]) -> str:
    qid, rid = imp.schema["qid"].dataType.simpleString(), ref.schema["rid"].dataType.simpleString()
    return f"qid {qid}, dist double, rid {rid}, " + ", ".join(f"{t} double" for t in targets)


def _neighbours(imp: DataFrame, ref: DataFrame, z: list[str], targets: list[str], k: int, n_imp: int,
                n_ref: int) -> DataFrame:
    """``qid, dist, rid, targets``: at least the k nearest references of every row of ``imp``."""
    out = _schemas(imp, ref, targets)
    imp = imp.withColumn("radius", F.lit(math.inf))
    if n_ref <= ROWS_PER_BOX or n_imp * n_ref <= SMALL_WORK:
        one = (df.withColumn("box", F.lit(0).cast("long")) for df in (imp, ref))
        return _search(*one, z, targets, k, out, (max(1, TASK_WORK // min(n_ref, PIECE_ROWS)), PIECE_ROWS))

    ref, homes, depth = _levels(_first_of_equals(ref, z, k), imp, z)
    near = settle(_search(homes, ref, z, targets, k, out))
    closest = near.select("qid", "dist", F.row_number().over(Window.partitionBy("qid").orderBy("dist")).alias("_n"))
    reach = closest.where(F.col("_n") <= k).groupBy("qid").agg(
        F.when(F.count("dist") >= k, F.max("dist")).otherwise(F.lit(math.inf)).alias("radius"))
    # A box of fewer than k rows proves no radius, nor does one that a query alone lies in.
    asked = homes.drop("radius").join(reach, "qid", "left").fillna(math.inf, ["radius"]).withColumn("home", F.col("box"))
    further = settle(_visits(asked.withColumn("box", F.lit(0).cast("long")), ref, z, depth)
                     .where("box <> home").select(homes.columns))
    return near.unionByName(_search(further, ref, z, targets, k, out))


def _visits(asked: DataFrame, ref: DataFrame, z: list[str], depth: int) -> DataFrame:
    """One row for each query and box that reaches into the query's radius, found from the whole down level by level."""
    def reached(rows: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        low, high = (boxes[[f"{end}_{c}" for c in z]].to_numpy(dtype=float) for end in ("lo", "hi"))
        ids, found = boxes["box"].to_numpy(), []
        for i in range(0, len(rows) if len(boxes) else 0, 1024):
            part = rows.iloc[i:i + 1024]
            gap = _gap_to_boxes(part[z].to_numpy(dtype=float), low, high)
            row, at = np.nonzero(gap <= part["radius"].to_numpy(dtype=float)[:, None] * (1 + 1e-9))
            found.append(part.iloc[row].assign(box=ids[at]))
        return pd.concat(found).drop(columns=["parent", "piece"]) if found else rows.iloc[:0].drop(columns=["parent", "piece"])

    schema = asked.schema
    for level in range(1, depth + 1):
        # The cell of a box at some level: the box without the parts it was cut into later.
        cells = _extents(ref.withColumn("box", F.shiftright("box", DEPTH * (depth - level))), z, "box")
        cells = cells.withColumn("parent", F.shiftright("box", DEPTH))
        pieces = _pieces(_counts(asked, "box"), "box", PIECE_ROWS).withColumnRenamed("box", "parent")
        held = _in_pieces(asked.withColumnRenamed("box", "parent"), pieces, "parent", "qid").withColumn("box", F.lit(0).cast("long"))
        cells = _fresh(cells).join(_fresh(pieces), "parent").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        held = held.select(*asked.columns, "parent", "piece")
        asked = held.groupBy("parent", "piece").cogroup(cells.groupBy("parent", "piece")).applyInPandas(reached, schema)
        if level < depth:
            asked = settle(asked)
    return asked


def _probable(imp: DataFrame, ref: DataFrame, z: list[str], targets: list[str], k: int) -> DataFrame:
    """``qid, dist, rid, targets``: the k nearest references within the own boxes of several turned feature spaces."""
    out = _schemas(imp, ref, targets)
    ref = settle(_first_of_equals(ref, z, k).withColumn("uid", F.monotonically_increasing_id()))
    found = None
    for turn in range(TURNS):
        turned, _ = np.linalg.qr(np.random.default_rng(turn).normal(size=(len(z), len(z))))
        names = [f"y{i}" for i in range(len(z))]

        def projected(df: DataFrame) -> DataFrame:
            return df.withColumns({y: sum((F.col(c) * F.lit(float(w)) for c, w in zip(z, column)), F.lit(0.0))
                                   for y, column in zip(names, turned.T)})

        own, asked, _ = _levels(projected(ref.drop(*targets).withColumn("__rid", F.col("rid")).withColumn("rid", F.col("uid"))),
                                projected(imp.withColumn("radius", F.lit(math.inf))), names)
        near = _search(asked, own, z, [], k, out.split(", rid ")[0] + ", rid long")
        found = near if found is None else found.unionByName(near)
    found = found.dropDuplicates(["qid", "rid"]).withColumnRenamed("rid", "uid")
    return found.join(ref.select("uid", "rid", *targets), "uid").select("qid", "dist", "rid", *targets)


def knn_impute(df: DataFrame, cols: Sequence[str], k: int = 5, *, id_col: str,
               features: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Fill missing numeric cells by the mean over the k nearest complete rows.

    Features (None: all other numeric columns) are used if valid in at least
    80 % of the rows to impute, and scaled by mean and population std of the
    complete rows.  Rows to impute that lack a feature are dropped.
    ``id_col`` breaks ties between equal distances; it may be missing or repeat.
    ``approximate`` looks for neighbours in the boxes of randomly turned feature
    spaces only, which finds most of them at a cost that does not grow with the
    number of features.
    """
    cols = list(cols)
    require_columns(df, [id_col])
    plan = _fit(df, cols, features)
    if plan is None:
        return df
    gap = ~_all([~is_missing(df, c) for c in cols])
    complete = _all([~is_missing(df, c) for c in plan.features])
    whole = df.where(~gap)
    doubles = {c: as_number(c) for c in cols}
    if plan.n_can_impute == 0:
        return whole.withColumns(doubles)

    z = [f"z{i}" for i in range(len(plan.features))]
    scaled = [((as_number(c) - F.lit(m)) / F.lit(w)).alias(name)
              for name, c, m, w in zip(z, plan.features, plan.centre, plan.width)]
    targets = [f"t{i}" for i in range(len(cols))]
    # Rows to impute are numbered once; the written copy keeps the numbers.
    numbered = settle(df.where(gap & complete).withColumn("__row", F.monotonically_increasing_id()))
    imp = numbered.select(F.col("__row").alias("qid"), *scaled)
    ref = df.where(~gap & complete).select(
        col(id_col).alias("rid"), *scaled, *[as_number(c).alias(t) for c, t in zip(cols, targets)])
    k = min(k, plan.n_reference)
    found = (_probable(imp, ref, z, targets, k) if approximate
             else _neighbours(imp, ref, z, targets, k, plan.n_can_impute, plan.n_reference))
    best = Window.partitionBy("qid").orderBy("dist", "rid")
    means = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).groupBy("qid").agg(
        *[F.avg(t).alias(f"__{t}") for t in targets]).withColumnRenamed("qid", "__row")
    filled = numbered.join(means, "__row").withColumns(
        {c: F.coalesce(as_number(c), F.col(f"__{t}")) for c, t in zip(cols, targets)}).select(*[col(c) for c in df.columns])
    return whole.withColumns(doubles).unionByName(filled)
