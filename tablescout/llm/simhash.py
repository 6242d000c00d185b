"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import byte_batches, doc_key, free_name, word_spans, written
from tablescout.llm.components import connected_components

SEED = 42
CHUNK = 1 << 17


def _shingles(texts: list[bytes], width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Word shingles of the texts in lower case: joined words, starts, ends and owners in text order."""
    joined, starts, ends, owner = word_spans([t.lower() for t in texts])
    if not len(starts):
        return b"", starts, ends, owner
    lengths = ends - starts
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=to[1:])
    take = np.repeat(starts - to[:-1], lengths + 1) + np.arange(to[-1])
    words = np.frombuffer(joined, np.uint8)[take]
    words[to[1:] - 1] = 32
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    last = np.append(first[1:], len(owner)) - 1
    short = last - first < width - 1
    whole = np.flatnonzero(owner[: max(0, len(owner) - width + 1)] == owner[width - 1 :])
    at = np.concatenate((whole, first[short]))
    until = np.concatenate((whole + width - 1, last[short]))
    order = np.argsort(at, kind="stable")
    at, until = at[order], until[order]
    return words.tobytes(), to[at], to[until + 1] - 1, owner[at]


def fingerprints_of(texts: list[bytes], width: int = 3) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if over half of its shingles' XXH64 values have it set."""
    words, starts, ends, owner = _shingles(texts, width)
    digest, n = xxhash.xxh64_intdigest, len(starts)
    ones, total = np.zeros((len(texts), 64), np.int64), np.bincount(owner, minlength=len(texts))
    for low in range(0, n, CHUNK):
        spans = zip(starts[low : low + CHUNK].tolist(), ends[low : low + CHUNK].tolist())
        values = np.fromiter((digest(words[s:e], SEED) for s, e in spans), np.uint64, min(CHUNK, n - low))
        bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = owner[low : low + CHUNK]
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(np.int64)


def simhash(docs: DataFrame, width: int = 3) -> DataFrame:
    """Add ``simhash`` (long, the 64 bits) to the rows of ``docs``; column ``text`` is read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_batches(batches):
            columns = [c for name, c in zip(part.schema.names, part.columns) if name != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fingerprints_of(texts, width))], names=names)

    kept = [f for f in docs.schema.fields if f.name != "text"]
    names = [*(f.name for f in kept), "simhash"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "simhash long"
    return docs.mapInArrow(run, schema)


def ball_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct values of ``prints.simhash`` at ``radius`` or fewer bits.

    Every value emits all variants within half the radius; two values within the radius meet at a variant
    between them. A variant is met by at most as many values as its own ball holds, so no group is large.
    For an even radius all values at a variant are within the radius of each other; each is linked to
    the one before it, which keeps the components and verifies the pair. Other radii compare all pairs of a ball.
    """
    if not 1 <= radius <= 4:
        raise ValueError("the radius goes from 1 to 4 bits")
    half = (radius + 1) // 2
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    masks = {0, *bits} if half == 1 else {0, *bits, *(x ^ y for i, x in enumerate(bits) for y in bits[:i])}
    flips = F.array(*[F.lit(m) for m in sorted(masks)])
    variants = prints.select("simhash").distinct().select("simhash", F.explode(flips).alias("flip"))
    variants = variants.select("simhash", F.expr("simhash ^ flip").alias("variant"))
    if radius % 2 == 0:
        before = F.lag("simhash").over(Window.partitionBy("variant").orderBy("simhash"))
        pairs = variants.select(F.col("simhash").alias("a"), before.alias("b")).where("b is not null")
    else:
        balls = variants.groupBy("variant").agg(F.collect_list("simhash").alias("s")).where("size(s) > 1")
        pairs = balls.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b")
    return pairs.where(F.bit_count(F.expr("a ^ b")) <= radius).distinct()


def _grouped(docs: DataFrame, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key, simhash`` of every row, and ``simhash, root`` for every fingerprint."""
    prints = written(simhash(docs.select("doc_id", "text", doc_key().alias("key")), width))
    nodes = prints.select("simhash").distinct()
    parts = connected_components(ball_links(nodes, radius))
    joined = nodes.join(parts, nodes.simhash == parts.node, "left")
    return prints, joined.select("simhash", F.coalesce("component", "simhash").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """Fingerprint and component of every row of ``docs(doc_id, text)``.

    Returns ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest ``doc_id`` reachable
    over links of ``radius`` or fewer differing bits. Null and wordless texts have fingerprint zero and are
    linked like any other. Rows with a null ``doc_id`` take part; a component of only such rows has a null
    id. Repeated rows stay repeated. Copies meet as one fingerprint, so a group of any size is one node.
    """
    prints, roots = _grouped(docs, width, radius)
    least = prints.groupBy("simhash").agg(F.min("doc_id").alias("least")).join(roots, "simhash")
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(ids, "root").select("simhash", "component_id")
    return prints.join(of, "simhash").select(
        "doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that with the smallest ``doc_id``.

    Null ids come last; rows with equal ids are told apart by a hash of id and text, and of rows equal in both any one stays.
    """
    prints, roots = _grouped(docs, width, radius)
    first = prints.groupBy("simhash").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("first"))
    kept = first.join(roots, "simhash").groupBy("root").agg(F.min("first").alias("first"))
    key = free_name(docs, "_key")
    kept = kept.select(F.col("first.key").alias(key))
    return docs.withColumn(key, doc_key()).join(kept, key, "left_semi").dropDuplicates([key]).select(docs.columns)
