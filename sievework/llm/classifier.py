"""A quality classifier of averaged word and character n-gram vectors.

Words, pairs of neighbouring words and byte n-grams of a text are hashed to buckets, each bucket has a
learned vector, a document is the mean of its vectors, and a softmax layer
gives the probability of each class.  Both layers are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled rows.
As the softmax of two classes sees only one direction of the mean, scoring
needs one number for each bucket: it averages those over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import texts

#: Labelled documents that the model is trained on, at most; those of smallest identifier hash.
SAMPLE = 4_000
#: Buckets of features, and lengths of the byte n-grams.
BUCKETS = 1 << 16
GRAMS = (3, 4)


def _fold(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def features(data: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS, grams=GRAMS):
    """Lists of (bucket of each feature, offsets of the texts among them): words, pairs of words, each length of n-gram."""
    words, rows = texts.word_hashes(data, offs)
    yield _fold(words, buckets), rows
    # A pair is the difference of its words' hashes, so that a word said twice is one feature whatever the word.
    pairs = words[1:] - words[:-1]
    inner = np.ones(len(pairs), bool)
    cuts = rows[1:-1]
    inner[cuts[(cuts > 0) & (cuts <= len(pairs))] - 1] = False
    yield (_fold(texts.mix(pairs[inner] + texts.salt(2)), buckets),
           np.concatenate(([0], np.cumsum(np.maximum(np.diff(rows) - 1, 0)))))
    for n in grams:
        size = max(len(data) - n + 1, 0)
        code = np.zeros(size, np.uint64)
        for j in range(n if size else 0):
            code = (code << np.uint64(8)) | data[j:size + j]
        # n-grams across the end of a text belong to none; their places are skipped.
        begins = np.minimum(offs[:-1], size)
        ends = np.clip(offs[1:] - n + 1, begins, size)
        inside = np.zeros(size + 1, np.int64)
        np.add.at(inside, begins, 1)
        np.add.at(inside, ends, -1)
        inside = np.cumsum(inside[:-1]) > 0
        counts = np.concatenate(([0], np.cumsum(ends - begins)))
        yield _fold(texts.mix(code[inside] + texts.salt(n)), buckets), counts


@dataclass
class Model:
    """``logits[bucket]`` averaged over a text's features and ``bias`` give the log odds of class 1."""

    logits: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each text; one without features has the bias alone."""
        total, count = np.zeros(len(offs) - 1), np.ones(len(offs) - 1)
        for found, rows in features(data, offs, len(self.logits)):
            sums = np.concatenate(([0.0], np.cumsum(self.logits[found], dtype=np.float64)))
            total += sums[rows[1:]] - sums[rows[:-1]]
            count += np.diff(rows)
        # The constant feature that every text has counts as one of its features.
        return 1 / (1 + np.exp(-(total + self.bias) / count))


def train(labels: list[int], counts: list[tuple[np.ndarray, np.ndarray]], buckets: int = BUCKETS, size: int = 8,
          epochs: int = 12, rate: float = 1.0, seed: int = 7) -> Model:
    """Fit vectors and softmax layer to documents given as (buckets, how often); steps shrink to zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / size, 1 / size, (buckets + 1, size)).astype(np.float32)
    layer = np.zeros((2, size), np.float32)
    steps, at = max(epochs * len(labels), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            own, often = counts[i]
            shares = (often / often.sum()).astype(np.float32)
            mean = shares @ vectors[own]
            raw = layer @ mean
            p = np.exp(raw - raw.max())
            p /= p.sum()
            p[labels[i]] -= 1
            step = rate * (1 - at / steps)
            back = p @ layer
            layer -= step * np.outer(p, mean)
            # Every feature moves by the same amount for each occurrence, whatever the length of the text.
            vectors[own] -= (step * np.minimum(shares * len(own), 4.0))[:, None] * back / 4
            at += 1
    logits = vectors @ (layer[1] - layer[0])
    return Model(logits[:-1].astype(np.float32), float(logits[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE, buckets: int = BUCKETS) -> Model:
    """A model from at most ``sample`` labelled documents, chosen by the hash of their identifier.

    Only the texts are features.  Rows without identifier or label are not
    used; without labelled rows every score is one half.
    """
    picked = (labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
              .where("__id IS NOT NULL AND __label IN (0, 1)").orderBy(F.xxhash64("__id"), "__id").limit(sample))
    # Bounded by the sample's own limit.
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(
        F.broadcast(picked), F.col("__doc") == F.col("__id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in texts.pieces(batch.column(2)):
                parts, own, often = list(features(data, offs, buckets)), [], []
                for i in range(b - a):
                    found = np.concatenate([f[rows[i]:rows[i + 1]] for f, rows in parts] + [[np.uint64(buckets)]])
                    ids, n = np.unique(found, return_counts=True)
                    own.append(ids.astype("<u4").tobytes())
                    often.append(n.astype("<u4").tobytes())
                yield pa.record_batch([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(own, pa.binary()),
                                       pa.array(often, pa.binary())], names=["doc", "label", "ids", "often"])

    found = rows.select(F.col("__doc").cast("string").alias("doc"), F.col("__label").alias("label"), "__text").mapInArrow(
        count, "doc string, label int, ids binary, often binary").collect()
    found.sort(key=lambda r: (r.doc, bytes(r.ids)))  # the order of arrival must not matter
    return train([r.label for r in found],
                 [(np.frombuffer(r.ids, "<u4"), np.frombuffer(r.often, "<u4")) for r in found], buckets)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The input with the probability of class 1; null and empty texts get that of a text without features.

    An input column named like the result is replaced.
    """
    kept = [c for c in docs.columns if c != score_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + [f"`{score_col}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(data, offs) for _, _, data, offs in texts.pieces(batch.column(batch.num_columns - 1))]
            scores = pa.array(np.concatenate(found) if found else np.zeros(0))
            yield pa.record_batch([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], score_col])

    return docs.select(*kept, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: the checksum of its identifier is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
