"""Exact nearest rows by cosine for two large sides: cells around pivots, joined in two rounds."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablescout.functions.vectors import TopK, arrow_matrix, similarity, unit_rows
from tablescout.session import shared_dir, small_frame

TOP_K = 5
NUMBERS = 1_000_000  # vector numbers of one side that a task holds at once, and of the pivots (8 MB)
ROUNDS = 6
ZERO = -1  # the cell of zero vectors, whose cosine is 0 with everything
SLACK = 1e-9


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, so that they are made once and survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/near-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Cells:
    """Corpus rows by their nearest pivot, with the range of angles to it that each cell covers."""

    placed: DataFrame  # id, embedding, kept columns, _cell
    keep: list[str]
    dims: int
    pivots: np.ndarray
    rows: dict[int, int]
    low: np.ndarray
    high: np.ndarray

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """Largest cosine a row of each cell can have with each unit vector, by the triangle inequality of angles."""
        angle = np.arccos(np.clip(unit @ self.pivots.T, -1, 1))
        out = np.cos(np.maximum(0, np.maximum(angle - self.high, self.low - angle)))
        out[~unit.any(axis=1)] = 0
        return out


def _parts(matrix: np.ndarray, width: int):
    step = max(1, NUMBERS // max(1, width))
    return (slice(at, at + step) for at in range(0, len(matrix), step))


def _pivots(sample: np.ndarray, cells: int) -> np.ndarray:
    """Directions of ``cells`` means of the sample, by a few rounds of assigning and averaging."""
    pivots = sample[:cells].copy()
    for _ in range(ROUNDS):
        home = np.concatenate([np.argmax(sample[p] @ pivots.T, axis=1) for p in _parts(sample, cells)])
        sums = np.zeros_like(pivots)
        np.add.at(sums, home, sample)
        moved = unit_rows(sums)
        pivots = np.where(moved.any(axis=1, keepdims=True), moved, pivots)
    return pivots


def _length(df: DataFrame, vector: str) -> int:
    first = df.select(F.size(vector).alias("n")).first()
    return first["n"] if first else 0


def _placing(pivots: np.ndarray, vector: str, dims: int):
    """Adds each row's cell and its cosine with the pivot; rows with numbers that are not finite go."""

    def run(batches):
        for batch in batches:
            given = arrow_matrix(batch.column(batch.schema.get_field_index(vector)), dims)
            finite = np.isfinite(given).all(axis=1)
            unit = unit_rows(np.where(finite[:, None], given, 0))
            cell, cos = np.zeros(len(unit), np.int32), np.zeros(len(unit))
            for p in _parts(unit, len(pivots)):
                dots = unit[p] @ pivots.T
                cell[p] = np.argmax(dots, axis=1)
                cos[p] = dots[np.arange(len(dots)), cell[p]]
            cell[~unit.any(axis=1)] = ZERO
            rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(cos)], names=[*batch.schema.names, "_cell", "_cos"])
            yield rows.filter(pa.array(finite))

    return run


def _placed(df: DataFrame, pivots: np.ndarray, vector: str, dims: int) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_cos", T.DoubleType())])
    return df.mapInArrow(_placing(pivots, vector, dims), schema)


def cells_of(corpus: DataFrame, keep: list[str] | None = None, cells: int | None = None, dims: int | None = None) -> Cells | None:
    """Cells of ``corpus(id, embedding, kept columns)``, about as many as it takes for one to fit a task; vectors have ``dims`` numbers, or as many as the first.

    Pivots come from a sample of four vectors for each cell, chosen by a hash of the id; their numbers are bounded by ``NUMBERS``, whatever the size of the
    corpus, and larger cells are joined in blocks. Every row is placed, in a table of the shared folder that serves any number of searches. Rows with a null
    vector are left out; None if no row is left.
    """
    keep = keep or []
    corpus = corpus.where("embedding IS NOT NULL").select("id", "embedding", *keep)
    corpus = stored(corpus) if cells is None else corpus
    dims = dims or _length(corpus, "embedding")
    if not dims:
        return None
    if cells is None:
        cells = -(-corpus.count() * dims // NUMBERS)
    cells = max(1, min(cells, NUMBERS // dims))
    pivots, total = np.eye(1, dims), corpus.count()
    if cells == 1:
        one = _placed(corpus, pivots, "embedding", dims).drop("_cos").withColumn("_cell", F.lit(0))
        return Cells(one, keep, dims, pivots, {0: total} if total else {}, np.zeros(1), np.full(1, np.pi))
    even = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(max(1, total // (4 * cells)))) == 0
    sample = corpus.where(even).select("embedding").limit(8 * cells).toArrow().column("embedding").combine_chunks()
    given = arrow_matrix(sample, dims)
    unit = unit_rows(given[np.isfinite(given).all(axis=1)])
    unit = np.unique(unit[unit.any(axis=1)], axis=0)
    if len(unit):
        unit = unit[np.random.default_rng(3).permutation(len(unit))]
        pivots = _pivots(unit, min(cells, len(unit)))
    placed = stored(_placed(corpus, pivots, "embedding", dims))
    seen = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_cos").alias("least"), F.max("_cos").alias("most")).collect()  # one row a cell
    low, high = np.full(len(pivots), np.pi), np.zeros(len(pivots))
    for r in seen:
        if r["_cell"] != ZERO:
            low[r["_cell"]] = np.arccos(np.clip(r["most"], -1, 1)) - 1e-7
            high[r["_cell"]] = np.arccos(np.clip(r["least"], -1, 1)) + 1e-7
    return Cells(placed.drop("_cos"), keep, dims, pivots, {r["_cell"]: r["n"] for r in seen}, low, high)


def _hit_schema(asks: DataFrame, cells: Cells) -> T.StructType:
    kept = [cells.placed.schema[c] for c in ["id", *cells.keep]]
    return T.StructType([T.StructField("qid", asks.schema["qid"].dataType), *kept, T.StructField("cos", T.DoubleType())])


def _meet(asks: DataFrame, counts: DataFrame, cells: Cells, k: int) -> DataFrame:
    """Best ``k`` rows of every part of a cell for each of ``asks(qid, vector, _cell)``; ``counts``: asks by cell.

    A cell and the queries that ask for it are each cut into parts that fit a task; every part of one side meets every part of the other.
    """
    held = max(1, NUMBERS // cells.dims)
    plan = [(r["_cell"], -(-cells.rows[r["_cell"]] // held), -(-r["n"] // held)) for r in counts.collect() if r["_cell"] in cells.rows]  # one row a cell
    plan = F.broadcast(small_frame(asks.sparkSession, plan, "_cell INT, _blocks INT, _chunks INT"))

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    key = ["_cell", "_block", "_chunk"]
    left = asks.join(plan, "_cell").select("qid", "vector", "_cell", every("_blocks").alias("_block"), F.pmod(F.xxhash64("qid"), "_chunks").cast("int").alias("_chunk"))
    right = cells.placed.join(plan, "_cell").select(
        "id", "embedding", *cells.keep, "_cell", F.pmod(F.xxhash64("id"), "_blocks").cast("int").alias("_block"), every("_chunks").alias("_chunk"))
    schema = _hit_schema(asks, cells)
    arrow_schema, keep, dims = to_arrow_schema(schema), cells.keep, cells.dims

    def search(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return arrow_schema.empty_table()
        top = TopK(unit_rows(arrow_matrix(asked.column("vector").combine_chunks(), dims)), k, "id")
        top.add(rows.select(["id", *keep]).to_pandas(), arrow_matrix(rows.column("embedding").combine_chunks(), dims))
        if top.best is None:
            return arrow_schema.empty_table()
        qids = np.array(asked.column("qid").to_pylist(), dtype=object)
        best: pd.DataFrame = top.best.assign(qid=qids[top.best["_query"].to_numpy()]).rename(columns={"_cos": "cos"})
        return pa.Table.from_pandas(best[[f.name for f in schema.fields]], arrow_schema, preserve_index=False)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, schema)


def _rank(hits: DataFrame, k: int) -> DataFrame:
    """Global top k of the hits kept by the tasks, with rank and rounded score."""
    w = W.partitionBy("qid").orderBy(F.col("cos").desc(), F.col("id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", similarity(F.col("cos")))


def _asked(queries: DataFrame, cells: Cells) -> DataFrame:
    """``qid, vector, _cell`` (home) of every query with a vector; a zero vector is at home in the first cell there is."""
    asked = _placed(queries.where("vector IS NOT NULL").select("qid", "vector"), cells.pivots, "vector", cells.dims).drop("_cos")
    if len(cells.rows) == 1:
        return asked.withColumn("_cell", F.lit(min(cells.rows)))
    held = F.col("_cell").isin([c for c in cells.rows])
    return stored(asked.withColumn("_cell", F.when(held, F.col("_cell")).otherwise(min(cells.rows))))


def _visits(asked: DataFrame, home: DataFrame, cells: Cells, k: int) -> DataFrame:
    """``qid, vector, _cells``: the other cells that may hold one of the k nearest rows of a query, given its hits at home."""
    best = _rank(home, k).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("floor"))
    floors = asked.join(best.where(F.col("n") >= k).select("qid", "floor"), "qid", "left")
    numbers = np.array(sorted(c for c in cells.rows if c != ZERO), dtype=int)
    has_zero = ZERO in cells.rows

    def run(batches):
        for batch in batches:
            unit = unit_rows(arrow_matrix(batch.column("vector"), cells_.dims))
            floor = np.nan_to_num(batch.column("floor").to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
            at, out = batch.column("_cell").to_numpy(), []
            for p in _parts(unit, len(cells_.pivots)):
                may = cells_.bounds(unit[p])[:, numbers] >= floor[p, None] - SLACK
                for i, row in enumerate(may, p.start):
                    found = numbers[row].tolist() + ([ZERO] if has_zero and floor[i] <= SLACK else [])
                    out.append([c for c in found if c != at[i]])
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("vector"), pa.array(out, pa.list_(pa.int32()))], names=["qid", "vector", "_cells"])

    cells_ = Cells(None, cells.keep, cells.dims, cells.pivots, cells.rows, cells.low, cells.high)  # what the tasks need
    schema = T.StructType([asked.schema["qid"], asked.schema["vector"], T.StructField("_cells", T.ArrayType(T.IntegerType()))])
    return floors.mapInArrow(run, schema)


def search(queries: DataFrame, cells: Cells, k: int = TOP_K) -> tuple[DataFrame, DataFrame | None]:
    """Hits of ``queries(qid, vector)`` and, if there are several cells, the cells each query looks into besides its home.

    Round one joins queries with their home cells, which gives each the cosine of a k-th row. Round two joins a query with those cells only
    whose bound reaches that cosine.
    """
    asked = _asked(queries, cells)
    # without a second round nothing else needs the queries, and their number is enough
    counts = asked.groupBy("_cell") if len(cells.rows) > 1 else queries.groupBy(F.lit(min(cells.rows)).alias("_cell"))
    home = _meet(asked, counts.agg(F.count(F.lit(1)).alias("n")), cells, k)
    if len(cells.rows) == 1:
        return _rank(home, k), None
    home = stored(home)
    visits = stored(_visits(asked, home, cells, k))
    asks = visits.select("qid", "vector", F.explode("_cells").alias("_cell"))
    counts = visits.select(F.explode("_cells").alias("_cell")).groupBy("_cell").agg(F.count(F.lit(1)).alias("n"))
    return _rank(home.union(_meet(asks, counts, cells, k)), k), visits.select("qid", "_cells")


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, keep: list[str] | None = None, cells: int | None = None) -> DataFrame:
    """The ``k`` nearest corpus rows of every query by cosine, exact; ties go to the smaller id.

    ``queries``: (qid, vector); ``corpus``: (id, embedding, further columns to ``keep``); all vectors of one length.
    Null vectors and those with numbers that are not finite are left out; a zero vector has cosine 0 with everything. Neither side passes the driver: both are written
    once to the shared folder, rows by cell (``cells_of``, for repeated searches of one corpus), and meet in two rounds (``search``).
    """
    queries = stored(queries.where("vector IS NOT NULL").select("qid", "vector"))
    dims = _length(queries, "vector")
    built = cells_of(corpus, keep, cells, dims) if dims else None
    if built is None or not built.rows:
        fields = [T.StructField("qid", queries.schema["qid"].dataType), *(corpus.schema[c] for c in ["id", *(keep or [])]), T.StructField("cos", T.DoubleType())]
        return _rank(small_frame(queries.sparkSession, [], T.StructType(fields)), k)
    return search(queries, built, k)[0]


def _probed(queries: DataFrame, cells: Cells, probes: int) -> DataFrame:
    """``qid, vector, _cells``: the ``probes`` cells whose pivots are nearest, of those that hold rows; zero vectors ask the first ones."""
    numbers = np.array(sorted(c for c in cells.rows if c != ZERO) or [ZERO], dtype=np.int32)
    pivots, dims, wanted = cells.pivots[numbers], cells.dims, max(1, min(probes, len(numbers)))

    def run(batches):
        for batch in batches:
            given = arrow_matrix(batch.column("vector"), dims)
            finite = np.isfinite(given).all(axis=1)
            unit = unit_rows(np.where(finite[:, None], given, 0))
            out = np.zeros((len(unit), wanted), np.int32)
            for p in _parts(unit, len(pivots)):
                out[p] = numbers[np.argsort(-(unit[p] @ pivots.T), axis=1, kind="stable")[:, :wanted]]
            ends = pa.array(np.arange(len(out) + 1) * wanted, pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(out.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("vector"), lists], names=["qid", "vector", "_cells"]).filter(pa.array(finite))

    schema = T.StructType([queries.schema["qid"], queries.schema["vector"], T.StructField("_cells", T.ArrayType(T.IntegerType()))])
    return queries.where("vector IS NOT NULL").select("qid", "vector").mapInArrow(run, schema)


def search_probed(queries: DataFrame, cells: Cells, probes: int, k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
    """Nearest rows among those of the ``probes`` learned cells nearest to each query, and the cells each query looked into.

    ``queries``: (qid, vector); ``cells`` from ``cells_of`` serve any number of searches. Every row lies in one cell, so a pair is scored once at
    most. More probes find more of the true neighbours; as many as there are cells give the exact result, but for zero vectors of the corpus,
    which are looked at only if there are no others. Queries with null vectors or numbers that are not finite have no hits.
    """
    probed = stored(_probed(queries, cells, probes))
    asks = probed.select("qid", "vector", F.explode("_cells").alias("_cell"))
    counts = probed.select(F.explode("_cells").alias("_cell")).groupBy("_cell").agg(F.count(F.lit(1)).alias("n"))
    return _rank(_meet(asks, counts, cells, k), k), probed.select("qid", "_cells")


def scored_share(visits: DataFrame, cells: Cells) -> float:
    """Share of all pairs of queries and rows that a search looked at; ``visits``: ``qid, _cells``."""
    rows = small_frame(visits.sparkSession, sorted(cells.rows.items()), "_cell INT, n BIGINT")
    looked = visits.select(F.explode("_cells").alias("_cell")).join(rows, "_cell").agg(F.sum("n").alias("n")).first()["n"]
    total = visits.count() * sum(cells.rows.values())
    return (looked or 0) / total if total else 0.0


def probes_for(queries: DataFrame, cells: Cells, recall: float = 0.95, k: int = TOP_K, asked: int = 200) -> int:
    """Fewest probes that find this share of the exact ``k`` nearest rows of a sample of ``queries``: about ``asked``, chosen by a hash of ``qid``.

    Every exact hit needs as many probes as its cell's place among the cells nearest to its query; the answer is the quantile of these places.
    On unclustered vectors it comes near the number of cells, which tells that an index saves little there. 1 without queries or rows.
    """
    queries = queries.where("vector IS NOT NULL").select("qid", "vector")
    total = queries.count()
    if not total or not cells.rows:
        return 1
    few = stored(queries.where(F.pmod(F.xxhash64("qid", F.lit(5)), F.lit(max(1, total // asked))) == 0))
    places = _probed(few, cells, len(cells.rows)).select("qid", F.posexplode("_cells").alias("place", "_cell"))
    hits = search(few, cells, k)[0].select("qid", "id").join(cells.placed.select("id", "_cell"), "id")
    # rows of zeros have no place; they count as found last
    needed = hits.join(places, ["qid", "_cell"], "left").groupBy(F.coalesce("place", F.lit(len(cells.rows) - 1)).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    found = sorted((r["place"], r["n"]) for r in needed.collect())  # a row for each cell at most
    wanted, seen = recall * sum(n for _, n in found), 0
    for place, n in found:
        seen += n
        if seen >= wanted:
            return place + 1
    return 1
