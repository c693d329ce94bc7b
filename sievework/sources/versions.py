"""Versions of a data set: Parquet snapshots and an append-only table about them.

A snapshot is never overwritten: a new revision goes to a folder of its own and
a newer row replaces the older one of the same key.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROW = ("key string, label string, source_key string, transform string, created_at timestamp, revision int, "
       "cleaning_applied boolean, feature_applied boolean, rows long, cols int, path string, removed boolean")
FIRST_KEY = "original"
KINDS = (None, "cleaning", "feature")


class Versions:
    """The versions stored under one root folder (one writer at a time)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._table = f"{self.root}/_versions"

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(ROW).parquet(self._table)
        except AnalysisException:
            return self.spark.createDataFrame([], ROW)

    def _newest(self) -> DataFrame:
        """Latest row of every key, removed ones included."""
        log = self._log()
        newest = F.max_by(F.struct(*[c for c in log.columns if c != "key"]), "revision").alias("r")
        return log.groupBy("key").agg(newest).select("key", "r.*")

    def current(self) -> DataFrame:
        """Latest row of every key that was not removed."""
        return self._newest().where("not removed")

    def _row(self, key: str):
        row = self.current().where(F.col("key") == key).first()
        if row is None:
            raise ValueError(f"Unknown version '{key}'")
        return row

    def _next_key(self, prefix: str) -> tuple[str, int]:
        """First free key of a prefix, and its first revision number."""
        rows = self._newest().where(F.col("key").startswith(prefix)).select("key", "revision", "removed").collect()
        last = {r["key"]: r["revision"] for r in rows}
        live = {r["key"] for r in rows if not r["removed"]}
        if prefix == FIRST_KEY and FIRST_KEY not in live:
            return FIRST_KEY, last.get(FIRST_KEY, 0) + 1
        i = 1
        while f"{prefix}_{i:02d}" in live:
            i += 1
        key = f"{prefix}_{i:02d}"
        return key, last.get(key, 0) + 1

    def _write(self, df: DataFrame, key: str, revision: int, **about) -> None:
        path = f"{self.root}/{key}/r{revision:04d}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        row = {"key": key, "revision": revision, "created_at": datetime.now(timezone.utc).replace(microsecond=0),
               "rows": seen.get["rows"], "cols": len(df.columns), "path": path, "removed": False, **about}
        self._append([row])

    def _append(self, rows: list[dict]) -> None:
        names = [part.split()[0] for part in ROW.split(", ")]
        self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ROW).coalesce(1).write.mode(
            "append").parquet(self._table)

    def register(self, df: DataFrame, prefix: str, label: str, source_key: str | None = None,
                 transform: str | None = None, kind: str | None = None) -> str:
        """Store a new version and return its key; stage flags carry over from the parent."""
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        parent = self._row(source_key) if source_key else None
        key, revision = self._next_key(prefix)
        self._write(df, key, revision, label=label, source_key=source_key, transform=transform,
                    cleaning_applied=kind == "cleaning" or bool(parent and parent["cleaning_applied"]),
                    feature_applied=kind == "feature" or bool(parent and parent["feature_applied"]))
        return key

    def overwrite(self, key: str, df: DataFrame, transform: str | None = None, kind: str | None = None) -> None:
        """Store a new revision of a version; transform texts are chained."""
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        row = self._row(key)
        texts = [t.strip() for t in (row["transform"], transform) if t and t.strip()]
        self._write(df, key, row["revision"] + 1, label=row["label"], source_key=row["source_key"],
                    transform=" | ".join(texts) or None,
                    cleaning_applied=kind == "cleaning" or row["cleaning_applied"],
                    feature_applied=kind == "feature" or row["feature_applied"])

    def load(self, key: str) -> DataFrame:
        return self.spark.read.parquet(self._row(key)["path"])

    def history(self) -> DataFrame:
        """``key, label, rows, cols, source, transform, created_at``."""
        return self.current().select(
            "key", "label", "rows", "cols", F.coalesce("source_key", F.lit("-")).alias("source"),
            F.coalesce("transform", F.lit("-")).alias("transform"), "created_at")

    def lineage(self, key: str) -> DataFrame:
        """``depth, key`` from a version up to its root; a cycle ends the walk."""
        return self.spark.sql("""
            WITH RECURSIVE walk(key, source_key, seen, depth) AS (
                SELECT key, source_key, array(key), 0 FROM {versions} WHERE key = :start
                UNION ALL
                SELECT v.key, v.source_key, array_append(w.seen, v.key), w.depth + 1
                FROM walk w JOIN {versions} v ON v.key = w.source_key
                WHERE NOT array_contains(w.seen, v.key))
            SELECT depth, key FROM walk""", args={"start": key}, versions=self.current())

    def stages(self, key: str) -> DataFrame:
        """``loaded, cleaned, feature_engineered, lineage_keys`` over the whole lineage, in one row."""
        # A lineage has a handful of rows.
        up = self.lineage(key).withColumnRenamed("key", "k")
        joined = self.current().join(F.broadcast(up), F.col("key") == F.col("k"))
        return joined.agg(
            (F.count(F.lit(1)) > 0).alias("loaded"),
            F.coalesce(F.bool_or("cleaning_applied"), F.lit(False)).alias("cleaned"),
            F.coalesce(F.bool_or("feature_applied"), F.lit(False)).alias("feature_engineered"),
            F.transform(F.sort_array(F.collect_list(F.struct("depth", "key"))), lambda s: s["key"]).alias("lineage_keys"))

    def sources(self) -> DataFrame:
        """Versions without a parent."""
        return self.current().where("source_key is null")

    def keep_source(self, key: str) -> None:
        """Keep one source version; every other version is marked as removed."""
        if self._row(key)["source_key"] is not None:
            raise ValueError(f"'{key}' is derived from another version")
        others = self.current().where(F.col("key") != key).collect()
        if others:
            self._append([{**r.asDict(), "revision": r["revision"] + 1, "removed": True} for r in others])
