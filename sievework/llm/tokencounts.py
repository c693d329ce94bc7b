"""Document lengths in flat token files that have no index.

A flat file is one long row of token identifiers in which a separator ends each
document.  It is cut into blocks without regard to documents.  Every block is
searched for separators in one vectorised pass; the blocks' token counts and
last separators, summed up by a prefix scan, then stitch the documents that
cross blocks, however many.  The scan has two levels, so that the order of a
file's blocks is never worked out in one long row.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions.work import new_folder
from sievework.llm import texts
from sievework.llm.bpe import _file, read_ranks

#: Tokens in a block, and blocks in a stride of the upper level of the scan.
BLOCK = 1 << 18
STRIDE = 4096


def read_flat(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, data) of flat files of ``width``-byte identifiers, each file below 2 GB."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", "length")
    cut = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(
        F.ceil(F.col("length") / (width * block)) - 1, F.lit(0)))))
    return cut.select("file", "block", F.substring("content", (F.col("block") * width * block + 1).cast("int"),
                                                   F.lit(width * block)).alias("data"))


def write_flat(docs: DataFrame, ranks_path: str, pattern: str, separator: int, id_col: str = "doc_id",
               text_col: str = "text", width: int = 2, block: int = BLOCK) -> DataFrame:
    """Encode whole texts into flat token files, one for each partition, kept as a table of blocks.

    Rows are (file, block, data, ids): ``ids`` lists the identifiers of the
    documents that end in the block.  A null text is an empty document.
    """
    spark = docs.sparkSession
    lines = spark.sparkContext.broadcast(_file(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        name, number = f"part-{TaskContext.get().partitionId():06d}", 0
        encode = _encoder(lines.value, pattern)
        waiting, count, ends = [], 0, []

        def blocks(least: int):
            nonlocal waiting, count, ends, number
            flat, at = np.concatenate(waiting) if waiting else np.zeros(0, f"<u{width}"), 0
            while count - at >= least and count - at > 0:
                n = min(block, count - at)
                own = [d for place, d in ends if place < at + n]
                ends = ends[len(own):]
                yield pa.record_batch([pa.array([name]), pa.array([number], pa.int64()), pa.array([flat[at:at + n].tobytes()], pa.binary()),
                                       pa.array([own], pa.list_(pa.int64()))], names=["file", "block", "data", "ids"])
                number, at = number + 1, at + n
            waiting, ends, count = [flat[at:]], [(p - at, d) for p, d in ends], count - at

        for batch in batches:
            for a, b, data, offs in texts.pieces(batch.column(1)):
                raw = data.tobytes()
                for x, y, doc in zip(offs[:-1].tolist(), offs[1:].tolist(), batch.column(0)[a:b].to_pylist()):
                    ids = np.array([*encode(raw[x:y].decode()), separator], f"<u{width}")
                    waiting.append(ids)
                    count += len(ids)
                    ends.append((count - 1, doc))
                if count >= block:
                    yield from blocks(block)
        yield from blocks(1)

    folder = new_folder(spark, "tokens")
    (docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
     .mapInArrow(run, "file string, block long, data binary, ids array<long>").write.parquet(folder))
    return spark.read.parquet(folder)


def _encoder(lines: bytes, pattern: str):
    """The worker's encoder; it outlasts a task."""
    import tiktoken
    kept = sys.modules.setdefault("_sievework_kept", types.ModuleType("_sievework_kept"))
    if getattr(kept, "encoder_key", None) != (len(lines), hash(lines), pattern):
        kept.encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(lines), special_tokens={})
        kept.encoder_key = len(lines), hash(lines), pattern
    return kept.encoder.encode_ordinary


def scan(blocks: DataFrame, separator: int, width: int = 2, labels: str | None = None, stride: int = STRIDE) -> DataFrame:
    """(file, document, n_tokens, closed) of every document, from (file, block, data).

    ``document`` numbers the documents of a file from 0; ``n_tokens`` leaves
    the separator out; tokens behind the last separator are a document that is
    not ``closed``.  ``labels`` names an array column with one entry for each
    separator of the block; it adds a column ``label``.  Empty files and
    blocks without separators are fine.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, numbers, data = (batch.column(i) for i in range(3))
            found, sizes = [], []
            for raw in data:
                tokens = np.frombuffer(raw.as_buffer(), f"<u{width}") if raw.is_valid else np.zeros(0, f"<u{width}")
                found.append(np.flatnonzero(tokens == separator))
                sizes.append(len(tokens))
            ends = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            flat = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
            names = ["file", "block", "n", "seps"] + (["labels"] if labels else [])
            yield pa.record_batch([files, numbers, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                                   *([batch.column(3)] if labels else [])], names=names)

    kind = blocks.schema[labels].dataType.simpleString() if labels else ""
    found = blocks.select("file", "block", "data", *([F.col(labels)] if labels else [])).mapInArrow(
        search, "file string, block long, n long, seps array<long>" + (f", labels {kind}" if labels else ""))
    found = found.withColumn("stride", F.floor(F.col("block") / stride)).withColumn("last", F.try_element_at("seps", F.lit(-1)))

    # Lower level: within a stride.  Positions count from its first token.
    inner = Window.partitionBy("file", "stride").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("base", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    found = found.withColumn("before", F.coalesce(F.sum(F.size("seps")).over(inner), F.lit(0)))
    found = found.withColumn("previous", F.max(F.col("base") + F.col("last")).over(inner))
    strides = found.groupBy("file", "stride").agg(
        F.sum("n").alias("n"), F.sum(F.size("seps")).alias("count"), F.max(F.col("base") + F.col("last")).alias("last"))
    # Upper level: the strides of a file.
    outer = Window.partitionBy("file").orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)
    strides = strides.withColumn("s_base", F.coalesce(F.sum("n").over(outer), F.lit(0)))
    strides = strides.withColumn("s_before", F.coalesce(F.sum("count").over(outer), F.lit(0)))
    strides = strides.withColumn("s_previous", F.coalesce(F.max(F.col("s_base") + F.col("last")).over(outer), F.lit(-1)))

    placed = found.join(strides.select("file", "stride", "s_base", "s_before", "s_previous"), ["file", "stride"])
    placed = placed.withColumn("previous", F.coalesce(F.col("s_base") + F.col("previous"), F.col("s_previous")))
    zipped = F.arrays_zip("seps", "labels") if labels else F.arrays_zip("seps")
    every = placed.select("file", "base", "s_base", "before", "s_before", "previous", "seps", F.posexplode(zipped).alias("at", "one"))
    ahead = F.when(F.col("at") == 0, F.col("previous")).otherwise(
        F.col("s_base") + F.col("base") + F.get("seps", F.col("at") - 1))
    closed = every.select(
        "file", (F.col("s_before") + F.col("before") + F.col("at")).alias("document"),
        (F.col("s_base") + F.col("base") + F.col("one.seps") - ahead - 1).alias("n_tokens"), F.lit(True).alias("closed"),
        *([F.col("one.labels").alias("label")] if labels else []))
    rest = (strides.groupBy("file").agg(F.sum("n").alias("n"), F.sum("count").alias("document"),
                                        F.max(F.col("s_base") + F.col("last")).alias("last"))
            .withColumn("n_tokens", F.col("n") - F.coalesce(F.col("last"), F.lit(-1)) - 1).where("n_tokens > 0")
            .select("file", "document", "n_tokens", F.lit(False).alias("closed"),
                    *([F.lit(None).cast(blocks.schema[labels].dataType.elementType).alias("label")] if labels else [])))
    return closed.unionByName(rest)
