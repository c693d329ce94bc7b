"""Ranked lexical search over an inverted index, by best positions.

The index is dealt into shards of consecutive documents; a row holds one
term's postings in one shard, a row with an empty term the shard's documents.
It is written as a table, and any set of queries can be run against it.

In a shard a query's impact lists (documents by falling contribution) are read
in parallel.  Every document met is looked up in all lists at once, and the
places found there count as seen too (Akbarinia, Pacitti and Valduriez, Best
Position Algorithms for Top-k Queries, 2007).  A document not yet seen can
have no more than the sum of what stands just after each list's unbroken run
of seen places; reading ends when that is strictly below the k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.work import new_folder, settle
from sievework.llm import texts

#: Bytes of text in a shard, or one text if that is longer.
SHARD = 8 << 20
#: Queries that are run together against a shard.
BATCH = 256
#: Places read from each list in the first step; every further step reads twice as many.
STEP = 64

#: Bytes of terms: digits, letters and everything beyond ASCII.
TERM = texts.byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def terms_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The row of every term of a piece, and the terms, A-Z lower-cased."""
    small = texts.LOWER[data]
    inside = TERM[small]
    starts, ends = texts.runs(inside, offs)
    places = np.concatenate(([0], np.cumsum(ends - starts)))
    terms = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(small[inside])])
    return texts.owners(offs, starts), terms.dictionary_encode()


def _postings(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each row, distinct terms, bounds of their postings, rows, occurrences)."""
    n = len(offs) - 1
    rows, terms = terms_of(data, offs)
    key = np.sort(terms.indices.to_numpy().astype(np.int64) * n + rows)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    bounds = np.searchsorted(key[first], np.arange(len(terms.dictionary) + 1) * n)
    return np.bincount(rows, minlength=n), terms.dictionary, bounds, key[first] % n, np.diff(np.append(first, len(key)))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows: shard, term, df, n_terms, postings, ids.

    Terms are maximal runs of ASCII letters and digits and of characters beyond
    ASCII, A-Z lower-cased.  ``postings`` has the numbers of the documents in
    their shard and then the occurrences, as 32-bit integers.  In the row with
    the empty term it has the documents' numbers of terms as 64-bit integers,
    ``df`` the number of documents with a term, ``n_terms`` their terms and
    ``ids`` the identifiers.  Rows without text have no terms; rows that repeat
    an identifier are documents of their own.  A text of any length is read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, data, offs in texts.pieces(batch.column(1), SHARD):
                lengths, terms, bounds, rows, often = _postings(data, offs)
                df = np.diff(bounds)
                # Per term its documents and then its occurrences.
                at = np.arange(len(rows)) + np.repeat(bounds[:-1], df)
                flat = np.zeros(2 * len(rows), np.int32)
                flat[at], flat[at + np.repeat(df, df)] = rows, often
                lists = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(df), [None, pa.py_buffer(bounds.astype(np.int64) * 8), pa.py_buffer(flat)])
                none = pa.nulls(len(df), pa.list_(pa.int64()))
                head = [[shard], [b""], [int((lengths > 0).sum())], [int(lengths.sum())], [lengths.astype(np.int64).tobytes()]]
                yield pa.record_batch(
                    [*(pa.array(x, t) for x, t in zip(head, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))),
                     pa.array([batch.column(0)[a:b].to_pylist()], pa.list_(pa.int64()))], names=NAMES)
                yield pa.record_batch([
                    pa.array(np.full(len(df), shard)), terms.cast(pa.binary()), pa.array(df.astype(np.int64)),
                    pa.array(np.zeros(len(df), np.int64)), lists.cast(pa.binary()), none], names=NAMES)
                shard += 1

    own = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return own.mapInArrow(run, "shard long, term binary, df long, n_terms long, postings binary, ids array<long>")


NAMES = ["shard", "term", "df", "n_terms", "postings", "ids"]


def _query_terms(queries: DataFrame) -> DataFrame:
    """(uid, term, times) of every query row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in texts.pieces(batch.column(1)):
                _, terms, bounds, rows, often = _postings(data, offs)
                own = np.repeat(np.arange(len(terms)), np.diff(bounds))
                yield pa.record_batch([batch.column(0)[a:b].take(pa.array(rows)), terms.cast(pa.binary()).take(pa.array(own)),
                                       pa.array(often.astype(np.int64))], names=["uid", "term", "times"])

    return queries.mapInArrow(run, "uid long, term binary, times long")


class ImpactList:
    """Documents by falling impact, and the place of each document in the list."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray):
        order = np.argsort(-impacts, kind="stable")
        self.docs, self.impacts = docs[order], impacts[order]
        self.known = docs
        self.places = np.empty(len(docs), np.int64)
        self.places[order] = np.arange(len(docs))

    def look_up(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the documents are in the list, and at which places."""
        at = np.minimum(np.searchsorted(self.known, docs), len(self.known) - 1)
        hits = np.flatnonzero(self.known[at] == docs)
        return hits, self.places[at[hits]]


def best_positions(lists: list[ImpactList], times: list[int], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, places read): every document whose score is at least the k-th best, and perhaps others.

    Scores sum ``times`` x impact over the lists.  Documents without a score above 0 are left out.
    """
    score, met = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool)
    seen = [np.zeros(len(x.docs), bool) for x in lists]
    best = [0] * len(lists)
    depth, step = 0, STEP
    while True:
        fresh = np.unique(np.concatenate([x.docs[depth:depth + step] for x in lists])) if lists else np.zeros(0, np.int64)
        fresh = fresh[~met[fresh]]
        met[fresh] = True
        rest = 0
        for i, own in enumerate(lists):
            hits, places = own.look_up(fresh)
            score[fresh[hits]] += times[i] * own.impacts[places]
            seen[i][places] = True
            tail = seen[i][best[i]:]
            gap = int(np.argmin(tail)) if len(tail) else 0
            best[i] += gap if len(tail) and not tail[gap] else len(tail)
            if best[i] < len(own.docs):
                rest += times[i] * int(own.impacts[best[i]])
        depth += step
        step *= 2
        found = np.flatnonzero(met)
        if not rest or len(found) >= k and int(np.partition(score[found], -k)[-k]) > rest:
            found = found[score[found] > 0]
            return found, score[found], min(depth, max((len(x.docs) for x in lists), default=0))


def search(shards: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text",
           doc_col: str = "doc_id") -> DataFrame:
    """The k best documents of every query row: the identifier of the query, rank, the document's identifier, score.

    ``shards`` is a stored index.  With N documents that have terms, L terms in
    all, n in one document and df documents with the term, a term weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))) and adds, for each time the query
    has it, weight * (10^9 tf div (1000 tf + 12 m)) with m = 75 + 25 n N div L.
    Documents without a score above 0 are not returned; equal scores are ranked
    by identifier, a missing one last.  A query without terms has no rows; rows
    that repeat an identifier are queries or documents of their own.
    """
    spark = shards.sparkSession
    heads = shards.where(F.octet_length("term") == 0)
    n_docs, n_terms, n_shards = heads.agg(F.sum("df"), F.sum("n_terms"), F.count("*")).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0
    asked = settle(queries.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("__item"),
                                  F.col(text_col).cast("string").alias("__text")))
    n_batches = -(-asked.count() // BATCH) or 1
    wanted = _query_terms(asked.select("uid", "__text"))
    counts = (shards.where(F.octet_length("term") > 0).join(wanted.select("term").distinct(), "term", "left_semi")
              .groupBy("term").agg(F.sum("df").alias("df")))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    batch = F.pmod(F.xxhash64("uid"), F.lit(n_batches)).cast("int")
    used = (wanted.join(counts, "term").withColumn("batch", batch).groupBy("batch", "term")
            .agg(F.first(weight).alias("weight"), F.collect_list(F.struct("uid", "times")).alias("users")))
    every = spark.range(n_batches).select(F.col("id").cast("int").alias("batch"), F.lit(b"").alias("term"))
    used = settle(used.unionByName(every, allowMissingColumns=True))

    def rank(group: pa.Table) -> pa.Table:
        terms = group.column("weight").to_pylist()
        head = next((i for i, w in enumerate(terms) if w is None))
        lengths = np.frombuffer(group.column("postings")[head].as_py(), np.int64)
        norm = 12 * np.array([75 + 25 * n * n_docs // max(n_terms, 1) for n in lengths.tolist()], np.int64)
        asks: dict[int, list[tuple[ImpactList, int]]] = {}
        for weight, raw, users in zip(terms, group.column("postings"), group.column("users").to_pylist()):
            if weight:
                rows, tf = np.frombuffer(raw.as_py(), np.int32).reshape(2, -1).astype(np.int64)
                own = ImpactList(rows, weight * (1_000_000_000 * tf // (1000 * tf + norm[rows])))
                for user in users:
                    asks.setdefault(user["uid"], []).append((own, user["times"]))
        # By identifier, a missing one last, so that of equal scores the first ones are kept.
        ids = group.column("ids")[head].values
        order = np.argsort(pc.array_sort_indices(ids, order="ascending", null_placement="at_end").to_numpy())
        uids, docs, scores = [], [], []
        for uid, lists in asks.items():
            found, score, _ = best_positions([x for x, _ in lists], [t for _, t in lists], len(lengths), k)
            top = np.lexsort((order[found], -score))[:k]
            uids += [uid] * len(top)
            docs.append(found[top])
            scores.append(score[top])
        docs, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, scores))
        return pa.table({"uid": pa.array(uids, pa.int64()), "doc": ids.take(pa.array(docs)), "score": pa.array(scores, pa.int64())})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    met = (shards.join(used, "term").select("shard", "batch", "weight", "postings", "ids", "users")
           .repartition(max(1, min(parts, n_shards * n_batches)), "shard", "batch").groupBy("shard", "batch"))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best = met.applyInArrow(rank, "uid long, doc long, score long").withColumn("rank", F.row_number().over(order))
    return (best.where(F.col("rank") <= k).join(asked.select("uid", "__item"), "uid")
            .select(F.col("__item").alias(id_col), "rank", F.col("doc").alias(doc_col), "score"))


def store(shards: DataFrame) -> DataFrame:
    """Write an index to the shared folder and read it back."""
    folder = new_folder(shards.sparkSession, "lexical-index")
    shards.write.parquet(folder)
    return shards.sparkSession.read.parquet(folder)
