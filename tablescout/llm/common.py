"""Helpers shared by the operators: column checks, byte batches, words and cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.session import shared_dir

BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here and the work is done once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder, for the small tables of iterative steps."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def doc_key():
    """Identity of a document row by content: rows equal in id and text share it, and share results."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def byte_batches(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches holding about ``limit`` bytes of text, with the texts as bytes (null: empty)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.zeros(batch.num_rows + 1, np.int64)
        lengths = pc.fill_null(pc.binary_length(texts), 0)
        np.cumsum(np.asarray(lengths, dtype=np.int64), out=sizes[1:])
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + limit, "right")) - 1)
            part = batch.slice(start, stop - start)
            values = part.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
            yield part, [v or b"" for v in values]
            start = stop


def word_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts: joined bytes, starts, ends and the text each belongs to."""
    joined = b" ".join(texts) + b" "
    buffer = np.frombuffer(joined, np.uint8)
    gap = (buffer == 32) | ((buffer - np.uint8(9)) < 5)
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=offsets[1:])
    owner = np.searchsorted(offsets, starts, "right") - 1
    return joined, starts, ends, owner


class Rolling:
    """64-bit polynomial hashes of any substrings of a buffer, from prefix sums modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(2**40, 2**61)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def prefix(self, buffer: np.ndarray) -> np.ndarray:
        n = len(buffer) + 1
        if len(self.powers) < n:
            self.powers = self._series(self.base, n)
            self.inverses = self._series(self.inverse, n)
        sums = np.zeros(n, np.uint64)
        np.cumsum(self.values[buffer] * self.powers[: n - 1], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.inverses[starts])

    @staticmethod
    def _series(factor: int, n: int) -> np.ndarray:
        steps = np.full(n, np.uint64(factor))
        steps[0] = 1
        return np.cumprod(steps)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the information of 64-bit values over all their bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h
