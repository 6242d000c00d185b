"""Writers: a versioned search index and run results."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.session import small_frame


BUCKET = "_index_bucket"
PARTS = "ARRAY<STRUCT<bucket: INT, folder: STRING>>"


class IndexStore:
    """Documents keyed by ``doc_id`` under one folder of shared storage, for one writer at a time.

    A document's bucket is a hash of its id. Every write makes a fresh folder with a subfolder for each bucket it
    touches, and none is changed afterwards. A row appended to ``generations`` then names the subfolders that form the index,
    so readers see the old index or the new one, never a half-written one. An upsert rewrites the buckets of the
    incoming ids only. ``buckets`` is fixed by the first write; choose it so that one bucket is cheap to rewrite (about
    1 GB): the list of subfolders is what the driver holds.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.path = path
        self.buckets = buckets

    def bucket(self, buckets: int | None = None) -> Column:
        """Bucket of a row by its ``doc_id``."""
        return F.pmod(F.xxhash64("doc_id"), F.lit(buckets or self.buckets)).cast("int")

    def _current(self) -> Row | None:
        layout = f"number INT, buckets INT, columns STRING, parts {PARTS}"
        try:
            found = self.spark.read.schema(layout).parquet(f"{self.path}/generations")
            return found.agg(F.max_by(F.struct("*"), "number")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _write(self, docs: DataFrame, number: int, buckets: int) -> tuple[str, list[int]]:
        """Documents in a fresh folder by bucket; its name and the buckets it has."""
        folder = f"docs-{number}-{uuid.uuid4().hex}"
        placed = docs.withColumn(BUCKET, self.bucket(buckets)).hint("rebalance", F.col(BUCKET))  # large buckets are split over tasks
        placed.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(f"{BUCKET} INT").parquet(f"{self.path}/{folder}")
        return folder, sorted(r[0] for r in written.select(BUCKET).distinct().collect())  # names of subfolders

    def _publish(self, docs: DataFrame, keep: list[tuple[int, str]], now: Row | None, columns: T.StructType) -> None:
        number, buckets = (now["number"] + 1, now["buckets"]) if now else (1, self.buckets)
        folder, filled = self._write(docs, number, buckets)
        row = (number, buckets, columns.json(), [{"bucket": b, "folder": f} for b, f in [*keep, *((b, folder) for b in filled)]])
        frame = small_frame(self.spark, [row], f"number INT, buckets INT, columns STRING, parts {PARTS}")
        frame.coalesce(1).write.mode("append").parquet(f"{self.path}/generations")

    def _rows(self, now: Row, parts: list[tuple[int, str]]) -> DataFrame:
        columns = T.StructType.fromJson(json.loads(now["columns"]))
        if not parts:
            return small_frame(self.spark, [], columns)
        return self.spark.read.schema(columns).parquet(*[f"{self.path}/{f}/{BUCKET}={b}" for b, f in parts])

    def parts(self) -> list[tuple[int, str]]:
        """Buckets and the folders that hold their documents."""
        now = self._current()
        return [(p["bucket"], p["folder"]) for p in now["parts"]] if now else []

    def read(self) -> DataFrame | None:
        now = self._current()
        return None if now is None else self._rows(now, [(p["bucket"], p["folder"]) for p in now["parts"]])

    def is_empty(self) -> bool:
        docs = self.read()
        return docs is None or docs.isEmpty()

    def replace(self, docs: DataFrame) -> None:
        """Full rebuild: the given documents become the index."""
        self._publish(docs, [], self._current(), docs.schema)

    def append(self, docs: DataFrame) -> None:
        """Add documents whose ids the index does not hold; what is stored is not rewritten."""
        now = self._current()
        self._publish(docs, self.parts(), now, _all_columns(now, docs))

    def upsert(self, docs: DataFrame) -> None:
        """Documents of the same id are replaced, others kept; buckets without incoming ids keep their files.

        The incoming documents are written by bucket first, so they are computed once. Columns only one side has are
        NULL for the other. Of several incoming documents with one id, ``one_per_id`` says which stays.
        """
        now = self._current()
        if now is None:
            return self.replace(one_per_id(docs))
        folder, touched = self._write(one_per_id(docs), now["number"] + 1, now["buckets"])
        stale = [(b, f) for b, f in self.parts() if b in touched]
        incoming = self.spark.read.schema(docs.schema).parquet(f"{self.path}/{folder}")
        keep = [(b, f) for b, f in self.parts() if b not in touched]
        merged = upserted(self._rows(now, stale), incoming)
        self._publish(merged, keep, now, _all_columns(now, docs))

    def compact(self) -> None:
        """Rewrite the buckets that have come to lie in several folders."""
        now = self._current()
        if now is None:
            return
        parts = self.parts()
        several = {b for b, n in Counter(b for b, _ in parts).items() if n > 1}
        if several:
            columns = T.StructType.fromJson(json.loads(now["columns"]))
            docs = self._rows(now, [p for p in parts if p[0] in several])
            self._publish(docs, [p for p in parts if p[0] not in several], now, columns)


def _all_columns(now: Row | None, docs: DataFrame) -> T.StructType:
    """Stored columns, then those only the new documents have."""
    stored = T.StructType.fromJson(json.loads(now["columns"])) if now else T.StructType()
    return T.StructType([*stored.fields, *(f for f in docs.schema.fields if f.name not in stored.names)])


def one_per_id(docs: DataFrame) -> DataFrame:
    """One document for each ``doc_id``: of several, the one whose values hash lowest."""
    first = W.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    return docs.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def upserted(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    kept = existing.join(incoming.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def save_run_results(results: DataFrame, path: str, run_date: str = "run_date") -> None:
    """Case rows as JSON lines, one folder per run date."""
    results.write.mode("append").partitionBy(run_date).json(path)


def save_run_summary(metrics: DataFrame, path: str, **run_meta: str) -> None:
    """One row of run metadata and metrics as JSON."""
    meta = F.struct(*[F.lit(v).alias(k) for k, v in run_meta.items()])
    metrics.select(meta.alias("run_meta"), F.struct("*").alias("metrics")).write.mode("append").json(path)


def save_run(cases: DataFrame, metrics: Callable[[DataFrame], DataFrame], path: str, **run_meta: str) -> str:
    """A run in a folder of its own below ``path``: ``case_results`` as JSON lines, then ``summary`` with metadata and metrics.

    The metrics are worked out from the stored cases, so these are computed once. The summary is written
    last: a folder that has one is whole. Returns the folder.
    """
    folder = f"{path}/run-{uuid.uuid4().hex}"
    cases.write.json(f"{folder}/case_results")
    stored = cases.sparkSession.read.schema(cases.schema).json(f"{folder}/case_results")
    save_run_summary(metrics(stored), f"{folder}/summary", **run_meta)
    return folder
