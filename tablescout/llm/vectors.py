"""Embedding near-duplicates by an exact metric range join around pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import written
from tablescout.llm.components import connected_components

COSINE = 0.98
CELL = 2048
CELLS = 1024
ROWS = 512


def _unit(arrow: pa.Array) -> np.ndarray:
    """Rows of a list column as double vectors of length one; all lists have one length."""
    n = len(arrow)
    x = arrow.flatten().to_numpy().astype(float).reshape(n, -1) if n else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable():
    """Condition of rows that can link: a label, and a vector that is not null, empty or zero and has finite components only."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("label").isNotNull() & F.coalesce(fine & F.exists("embedding", lambda x: x != 0), F.lit(False))


def _pivots(nodes: DataFrame, cell: int, cells: int) -> dict:
    """Pivots per (label, length) with more than ``cell`` vectors; at most about ``cells`` in all."""
    sizes = nodes.groupBy("part").agg(F.count("*").alias("n"))
    total = nodes.count()
    size = max(cell, total // cells)
    large = sizes.where(F.col("n") > size).select("part", F.ceil(F.col("n") / size).alias("k"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("node"))
    first = nodes.withColumn("place", place).where(F.col("place") <= cells).join(F.broadcast(large), "part").where("place <= k")
    out: dict = {}
    for row in first.select("part", "embedding").orderBy("part", "place").collect():  # at most about 2 * cells
        out.setdefault(row.part, []).append(np.array(row.embedding, float))
    return {k: np.stack([v / np.linalg.norm(v) for v in vs]) for k, vs in out.items()}


def _cells(pivots: dict, radius: float):
    """Each vector in the cell of its nearest pivot, and in every cell it may have a neighbour in.

    A neighbour within ``radius`` whose nearest pivot is another one is at most ``radius`` away, so by the triangle inequality the other
    pivot is at most ``2 * radius`` farther than the nearest. As the neighbour lies beyond the plane halfway between the two
    pivots, the distance to that plane gives the same bound more sharply.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").to_pylist()
            for part in dict.fromkeys(parts):
                at = np.flatnonzero([p == part for p in parts])
                rows = batch.take(pa.array(at))
                if part not in pivots:
                    which, cell, own = np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), bool)
                else:
                    p, x = pivots[part], _unit(rows.column("embedding"))
                    d2 = np.maximum(2 - 2 * x @ p.T, 0)
                    near = d2.argmin(1)
                    between = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[near]
                    least = d2[np.arange(len(at)), near][:, None]
                    which, cell = np.nonzero(d2 - least <= 2 * between * (radius + 1e-7) + 1e-9)
                    own = cell == near[which]
                got = rows.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(cell), pa.array(own)], names=[*got.schema.names, "cell", "own"])

    return run


def _neighbours(left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs are at ``cosine`` or more; pairs too close to tell are computed again without rounding in the sum."""
    sims = left @ right.T
    out = sims >= cosine
    for i, j in np.argwhere(np.abs(sims - cosine) < 1e-13):
        out[i, j] = math.fsum(left[i] * right[j]) >= cosine
    return out


def _joined(cosine: float):
    """Links within one block pair of a cell: weighted numbers of links of its own vectors, and a forest of the links."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side = rows.column("side").to_numpy()
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        x = _unit(rows.column("embedding").chunk(0)) if rows.num_rows else np.zeros((0, 1))
        left, right = np.flatnonzero(side < 2), np.flatnonzero(side > 0)
        links, root = np.zeros(len(left), np.int64), np.arange(len(node))
        first, changed = True, True
        while changed:
            changed = False
            for low in range(0, len(left), ROWS):
                own = left[low : low + ROWS]
                near = _neighbours(x[own], x[right], cosine) & (node[own][:, None] != node[right])
                if first:
                    links[low : low + ROWS] = near @ copies[right]
                least = np.minimum(np.where(near, root[right], len(node)).min(1, initial=len(node)), root[own])
                back = np.where(near, least[:, None], len(node)).min(0, initial=len(node))
                if (least < root[own]).any() or (back < root[right]).any():
                    changed = True
                    root[own] = least
                    root[right] = np.minimum(root[right], back)
            first = False
        met = np.concatenate((left, np.flatnonzero(node[root] != node)))
        counted = np.concatenate((links, np.zeros(len(met) - len(left), np.int64)))
        return pa.table({"node": node[met], "other": node[root[met]], "n": counted})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, cells: int = CELLS) -> DataFrame:
    """Links between vectors of one label at ``cosine`` or more, in double precision, with all links found.

    Returns ``vec_id, n_links`` (other rows linked directly), ``component_id`` (smallest ``vec_id`` reachable, itself included) and
    ``kept`` (``vec_id = component_id``) for every row of ``vectors(vec_id, embedding, label)``. Rows with a null label, or a vector that is null,
    empty, zero or not finite, link with nothing. Only vectors of one length are compared. Equal vectors are one node with a
    number of copies, so copies cost nothing; each row of a repeated ``vec_id`` is a row of its own. Null ids link too;
    a component of them alone has a null id and is not kept.

    Cells are joined independently, those above ``cell`` rows in pairs of blocks.
    """
    keyed = vectors.select("vec_id", "embedding", "label")
    nodes = keyed.where(usable()).groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    part = F.struct("label", F.size("embedding").alias("width")).cast("string")
    nodes = written(nodes.select(F.xxhash64("label", "embedding").alias("node"), part.alias("part"), "embedding", "copies", "least"))
    radius = math.sqrt(2 - 2 * cosine)
    pivots = _pivots(nodes, cell, cells)
    kind = nodes.schema["embedding"].dataType.simpleString()
    placed = nodes.select("part", "node", "embedding", "copies").mapInArrow(
        _cells(pivots, radius), f"part string, node long, embedding {kind}, copies long, cell long, own boolean")
    placed = written(placed)
    sizes = placed.groupBy("part", "cell").agg(F.ceil(F.count("*") / cell).cast("long").alias("blocks"))
    blocks = placed.join(sizes, ["part", "cell"]).withColumn("y", F.pmod("node", "blocks"))
    # every block of a cell meets every block of its own vectors; side 0: from the left only, 2: from the right only, 1: both
    meets = blocks.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meets = meets.withColumn("side", F.when((F.col("x") == F.col("y")) & F.col("own"), 1).otherwise(2))
    lefts = blocks.where("own and blocks > 1").withColumn("x", F.col("y")).withColumn("side", F.lit(0)).withColumn(
        "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("x <> y")
    columns = ["part", "cell", "x", "y", "side", "node", "embedding", "copies"]
    found = meets.select(columns).union(lefts.select(columns)).groupBy("part", "cell", "x", "y").applyInArrow(
        _joined(cosine), "node long, other long, n long")
    found = written(found)
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    roots = nodes.select("node", "copies", "least").join(links, "node").join(parts, "node", "left")
    roots = roots.withColumn("root", F.coalesce("component", "node"))
    of = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(
        "node", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    rows = keyed.select("vec_id", usable().alias("can"), F.xxhash64("label", "embedding").alias("node"))
    linked = rows.where("can").join(of, "node").select("vec_id", "n_links", "component_id")
    single = rows.where("not can").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
