"""Mixing sources to target weights by weighted sampling without replacement.

Every document has an exponential key, ``-ln(u) / quality`` with ``u`` from a
hash of its identifier: in the order of keys, better documents come earlier.
A source is taken in whole epochs as far as its target goes; the fraction of
an epoch left takes documents in key order until the budget is full.  The cut
is found from sums over cells of the key range, twice refined, so no source is
ever sorted as a whole: only the documents of one cell in a million are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.work import settle

#: Sources up to which their table of cuts (some 100 bytes each) is broadcast; counted first.
BROADCAST_SOURCES = 10_000
#: Bits of a cell's number on each of the two levels.
_LEVEL = 10


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: str, size: Column) -> Column:
    """A document's weight: words by words and symbols, 1 for text without symbols."""
    symbols = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[#*$%&|<>]")), F.lit(0))
    return F.when(size == 0, 1.0).otherwise(size / (size + symbols))


def _key(identifier: Column, weight: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def _cell(key: Column) -> Column:
    """The key's place among 2^20 cells, in the order of keys."""
    top = (1 << 2 * _LEVEL) - 1
    return F.least(F.floor((1 - F.exp(-key)) * (top + 1)), F.lit(top)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], total_share: float, most: float) -> DataFrame:
    """source, source_size, target from source, source_size: ``weights`` repeat over the sources in code point order.

    Targets share ``total_share`` of all sizes by weight; none passes ``most``
    times its source, and what it leaves is shared by weight among the others.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", weight).withColumn("full", F.col("source_size") * F.lit(float(most)))
    # Sources fill up in the order of full / w; the first one that its share doesn't fill sets the level for the rest.
    order = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) * F.lit(float(total_share)) - (F.sum("full").over(so_far) - F.col("full")))
             / (F.sum("w").over(everything) - F.sum("w").over(so_far) + F.col("w")))
    levelled = ranked.withColumn("level", level)
    final = F.max(F.when(F.col("full") >= F.col("level") * F.col("w"), F.col("level"))).over(everything)
    return levelled.withColumn("final", final).select(
        "source", "source_size",
        F.round(F.least(F.col("full"), F.coalesce(F.col("final") * F.col("w"), F.col("full"))), 6).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: Sequence[float] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0,
         seed: str = "mix") -> DataFrame:
    """One row per source: its size and target, whole epochs, and the cut in key order for the fraction left."""
    size = word_count(text_col)
    rows = settle(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), size.alias("size"),
                              _key(F.col(id_col), quality(text_col, size), seed).alias("key"))
                  .withColumn("cell", _cell(F.col("key"))))
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_share, most)
    goals = settle(goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                                    .otherwise(0).cast("long"))
                   .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))

    def boundary(cells: DataFrame, starts: DataFrame, width: int, name: str) -> DataFrame:
        """The first cell of each source that runs past the rest, and the words before it."""
        sums = cells.groupBy("source", (F.shiftright("cell", width)).alias("part")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("part"))
        ends = _on_source(sums.withColumn("end", run), starts)
        past = ends.where(F.col("before") + F.col("end") > F.col("rest"))
        return past.groupBy("source", "rest").agg(F.min_by(F.struct("part", (F.col("before") + F.col("end") - F.col("words"))
                                                                    .alias("before")), "part").alias("at")).select(
            "source", "rest", F.col("at.part").alias(name), F.col("at.before").alias("before"))

    first = boundary(rows, goals.select("source", "rest", F.lit(0).cast("long").alias("before")), _LEVEL, "coarse")
    inner = _on_source(rows, first.select("source", "coarse")).where(F.shiftright("cell", _LEVEL) == F.col("coarse"))
    second = settle(boundary(inner.select("source", "cell", "size"), first.select("source", "rest", "before"), 0, "fine"))
    last = _on_source(rows, second).where(F.col("cell") == F.col("fine"))
    order = Window.partitionBy("source").orderBy("key", "id")
    last = last.withColumn("ahead", F.col("before") + F.sum("size").over(order) - F.col("size"))
    cut = (last.where(2 * F.col("ahead") + F.col("size") <= 2 * F.col("rest")).groupBy("source")
           .agg(F.max(F.struct("key", "id")).alias("cut")))
    ends = _on_source(second.select("source", "fine"), cut, "left")
    # A source without a boundary is never cut: its fraction takes all it has.
    return _on_source(goals, ends, "left").withColumn("fine", F.coalesce("fine", F.lit(1 << 2 * _LEVEL)))


def _on_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null as a source of its own; the right side's source goes."""
    right = right.withColumnRenamed("source", "__of")
    return left.join(right, left["source"].eqNullSafe(right["__of"]), how).drop("__of")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0, seed: str = "mix",
        prefix: str = "__mix_") -> DataFrame:
    """The input rows with size, source_size, target and copies (how often the mix takes the document).

    A document is taken whole, ``floor(target / source_size)`` times and once
    more if it lies before the cut; the one at the cut is taken if more of it
    lies before than behind.  A null text has no words; a null source is a
    source, the last one; rows that repeat an identifier are taken together.
    The new columns have ``prefix`` before their names.
    """
    cuts = settle(plan(docs, id_col, text_col, source_col, weights, total_share, most, seed)
                  .select(*(F.col(c).alias(f"__cut_{c}") for c in ("source", "source_size", "target", "epochs", "rest", "fine", "cut"))))
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    size = word_count(text_col)
    own = docs.withColumn(prefix + "size", size)
    own = own.withColumn("__key", _key(F.col(id_col), quality(text_col, F.col(prefix + "size")), seed))
    own = own.join(cuts, F.col(source_col).eqNullSafe(F.col("__cut_source")), "left")
    cell = _cell(F.col("__key"))
    inside = (cell < F.col("__cut_fine")) | ((cell == F.col("__cut_fine")) & F.coalesce(
        F.struct(F.col("__key").alias("key"), F.col(id_col).alias("id")) <= F.col("__cut_cut"), F.lit(False)))
    return own.withColumns({
        prefix + "source_size": F.col("__cut_source_size"), prefix + "target": F.col("__cut_target"),
        prefix + "copies": F.col("__cut_epochs") + (inside & (F.col("__cut_rest") > 0)).cast("long"),
    }).drop("__key", *(f"__cut_{c}" for c in ("source", "source_size", "target", "epochs", "rest", "fine", "cut")))
