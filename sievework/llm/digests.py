"""Exact duplicates by merging sorted runs of text digests in a tree.

Every partition turns its texts into one sorted run for each range of digests:
distinct digests with the wanted identifier and the number of rows.  Runs of a
range meet ``FAN`` at a time in binomial rounds until one is left for each
range.  A run holds distinct digests only, so a group of copies, however large,
is one entry for each run from the first level on; ranges follow the number of
rows, so no final run outgrows a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.work import settle
from sievework.llm import texts

#: Runs that one merge takes in.
FAN = 8
#: Digests of one range, at most about this many.
RANGE_ROWS = 200_000

_ENTRY = np.dtype([("digest", "V32"), ("size", "<i8"), ("id", "<i8"), ("rows", "<i8")])
_LOWER = bytes(texts.LOWER)


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, digest (SHA-256 of the text with A-Z lower-cased, null as empty) and size in bytes."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = texts.binary(batch.column(1))
            view = memoryview(data)
            found = [hashlib.sha256(bytes(view[a:b]).translate(_LOWER)).digest()
                     for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary()), pa.array(np.diff(offs))],
                                  names=["doc", "digest", "size"])

    return (docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
            .mapInArrow(digest, "doc long, digest binary, size long"))


def merge_runs(runs: list[np.ndarray], largest: bool) -> np.ndarray:
    """One sorted run from several: equal digests are verified by size and become one entry."""
    rows = np.concatenate(runs) if runs else np.zeros(0, _ENTRY)
    if not len(rows):
        return rows
    words = np.ascontiguousarray(rows["digest"]).view(">u8").reshape(-1, 4)
    order = np.lexsort((rows["size"], words[:, 3], words[:, 2], words[:, 1], words[:, 0]))
    rows, words = rows[order], words[order]
    first = np.ones(len(rows), bool)
    first[1:] = (words[1:] != words[:-1]).any(axis=1) | (rows["size"][1:] != rows["size"][:-1])
    at = np.flatnonzero(first)
    out = rows[at]
    out["id"] = (np.maximum if largest else np.minimum).reduceat(rows["id"], at)
    out["rows"] = np.add.reduceat(rows["rows"], at)
    return out


def _packed(ranges: list[int], runs: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(ranges, pa.int32()), pa.array(runs, pa.int64()), pa.array(data, pa.binary())],
                           names=["range", "run", "data"])


_RUN_SCHEMA = "range int, run long, data binary"


def tree_merge(digests: DataFrame, largest: bool = False, fan: int = FAN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """digest, size, keep_id, group_size: one row for each distinct digest, by rounds of run merges."""
    n_ranges = max(1, -(-digests.count() // range_rows))

    def first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.zeros(batch.num_rows, _ENTRY)
            rows["digest"] = np.frombuffer(b"".join(batch.column(1).to_pylist()), "V32")
            rows["size"], rows["id"] = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            rows["rows"] = 1
            held.append(merge_runs([rows], largest))
        run = merge_runs(held, largest)
        top = np.ascontiguousarray(run["digest"]).view(">u4").reshape(-1, 8)[:, 0].astype(np.int64) if len(run) else []
        place = np.asarray(top, np.int64) * n_ranges >> 32
        for r in np.unique(place).tolist():
            yield _packed([r], [task], [run[place == r].tobytes()])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            held += [np.frombuffer(x, _ENTRY) for x in batch.column("data").to_pylist()]
            if batch.num_rows:
                key = batch.column("range")[0].as_py(), batch.column("run")[0].as_py() // fan
        yield _packed([key[0]], [key[1]], [merge_runs(held, largest).tobytes()])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                rows = np.frombuffer(data, _ENTRY)
                raw = pa.Array.from_buffers(pa.binary(32), len(rows), [None, pa.py_buffer(rows["digest"].tobytes())])
                yield pa.record_batch(
                    [raw.cast(pa.binary()), *(pa.array(np.ascontiguousarray(rows[x])) for x in ("size", "id", "rows"))],
                    names=["digest", "size", "keep_id", "group_size"])

    known = digests.where("doc IS NOT NULL")
    runs = known.mapInArrow(first_runs, _RUN_SCHEMA)
    left = settle(runs)
    most = (left.agg(F.max("run")).first()[0] or 0) + 1
    while most > 1:
        left = left.groupBy("range", F.floor(F.col("run") / fan).alias("to")).applyInArrow(
            lambda table: _one(merge(iter(table.combine_chunks().to_batches()))), _RUN_SCHEMA)
        most = -(-most // fan)
    return left.mapInArrow(unpack, "digest binary, size long, keep_id long, group_size long")


def _one(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(list(batches))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty.  Of a group the smallest identifier stays (``largest``: the
    largest).  Rows that repeat an identifier and its text are all marked as
    kept with it; a row without an identifier takes no part in any group: it
    has no keep_id, a group of one, and stays.  An empty table gives no rows.
    """
    digests = settle(digest_rows(docs, id_col, text_col))
    groups = tree_merge(digests, largest)
    joined = digests.alias("d").join(
        groups.alias("g"), F.expr("d.doc IS NOT NULL AND d.digest = g.digest AND d.size = g.size"), "left")
    return joined.select(
        F.col("doc").alias("doc_id"), "keep_id", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("doc").isNull() | F.col("keep_id").eqNullSafe(F.col("doc"))).alias("kept"),
        F.lower(F.hex("d.digest")).alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False) -> DataFrame:
    """The input rows, all columns, without those whose text has a kept copy under another identifier.

    An identifier with several texts stays as long as one of them is kept.
    """
    gone = (exact_groups(docs, id_col, text_col, largest).groupBy(F.col("doc_id").alias("__gone"))
            .agg(F.max("kept").alias("__kept")).where("NOT __kept").select("__gone"))
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
