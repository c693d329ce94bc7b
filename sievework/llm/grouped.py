"""Many small groups in few tasks: rows sorted by key, read as a stream, one group after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def n_tasks(spark: SparkSession) -> int:
    """Tasks for work that is heavy for its bytes: as many as shuffles have, three for each core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def by_key(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table], pa.Table | None], schema: str,
           tasks: int | None = None) -> DataFrame:
    """Apply ``work`` to the rows of each group, sorted by ``order`` within it.

    ``keys`` are columns of 64-bit integers without nulls.  A group is held in
    memory while it is worked on, so callers bound its size; groups as such
    cost no call of their own between the engine and Python.  Callers that know
    how much work there is give the number of ``tasks``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(batch: pa.RecordBatch | None) -> Iterator[pa.Table]:
            """The groups that are complete, now that ``batch`` follows (None: nothing follows)."""
            if batch is None:
                if held:
                    yield pa.Table.from_batches(held)
                return
            own = np.stack([batch.column(k).to_numpy() for k in keys])
            cuts = np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1
            if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
                yield pa.Table.from_batches(held)
                held.clear()
            ends = [*cuts.tolist(), batch.num_rows]
            start = 0
            for end in ends[:-1]:
                yield pa.Table.from_batches([*held, batch.slice(start, end - start)])
                held.clear()
                start = end
            held.append(batch.slice(start))

        for batch in batches:
            if batch.num_rows:
                for group in groups(batch):
                    found = work(group)
                    if found is not None and len(found):
                        yield from found.to_batches()
        for group in groups(None):
            found = work(group)
            if found is not None and len(found):
                yield from found.to_batches()

    dealt = df.repartition(tasks or n_tasks(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)
