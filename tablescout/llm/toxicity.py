"""Toxicity of documents by their nearest labelled examples, by exact TF-IDF cosine on a block-max inverted index.

Terms are words and the stems of longer words. Vectors hold the terms that tell the labels apart, those whose
occurrence in the labelled examples depends on the label by a chi-square test, and one term that stands for any word. Inverse document frequencies are
counted over all documents. The index has a list of (example, weight) for each term, cut into blocks of
neighbouring examples, and the largest weight of each block. A search adds up the block maxima of its terms, looks
into blocks from the highest bound down, and ends where no later block can hold an example before the ``k``-th found: the result is exact.

The neighbours vote, weighted by their cosine; a logistic curve fitted to the votes the examples get from each other turns a vote into a
probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import byte_batches, written

LABELLED_ROWS = 6_000
TERMS = 1 << 15
MIN_EXAMPLES = 3
CHI_SQUARE = 15.0
STEM = 6
ANY = b"*"
NEIGHBOURS = 15
BLOCK = 64
DIGITS = 10
PREDICT_FROM = 0.7

# Bytes of a word: ASCII letters in lower case, digits and everything beyond ASCII; others are gaps.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: bytes) -> dict[bytes, int]:
    """Terms of a text with their counts.

    A stem is the first ``STEM`` bytes of a longer word, marked by a star. The term ``ANY`` counts all words, so that a vector tells how much
    of a text its telling terms are.
    """
    counts: dict[bytes, int] = {}
    for word in text.translate(_WORDS).split():
        counts[word] = counts.get(word, 0) + 1
    more = {ANY: sum(counts.values())} if counts else {}
    for word, n in counts.items():
        if len(word) > STEM:
            stem = b"*" + word[:STEM]
            more[stem] = more.get(stem, 0) + n
    return counts | more


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``begin`` to ``begin + size`` of every pair, one after another."""
    return np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Index:
    """Block-max inverted index over the unit vectors of the examples."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        self.examples, self.block = len(vectors), block
        sizes = np.array([len(t) for t, _ in vectors], np.int64)
        owner = np.repeat(np.arange(len(vectors)), sizes)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((owner, term))
        self.owner, self.weight, term = owner[order], weight[order], term[order]
        # one entry for each term and block: where its postings begin, and the largest weight among them
        key = term * (len(vectors) // block + 1) + self.owner // block
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.begin, self.end = first, np.append(first[1:], len(key))
        self.where = self.owner[first] // block if len(key) else first
        self.most = np.maximum.reduceat(self.weight, first) if len(key) else np.zeros(0)
        self.entries = np.searchsorted(term[first], np.arange(terms + 1)) if len(key) else np.zeros(terms + 1, np.int64)
        self.looked = 0  # blocks read so far

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the ``k`` nearest examples with a positive cosine; smaller numbers first among equals.

        Cosines are rounded to ``DIGITS`` digits, and so are bounds, so that blocks of equal bounds can be left by their numbers.
        ``without`` are example numbers to pass over.
        """
        sizes = self.entries[terms + 1] - self.entries[terms]
        if not sizes.sum():
            return np.zeros(0, np.int64), np.zeros(0)
        entry, factor = _ranges(self.entries[terms], sizes), np.repeat(weights, sizes)
        where = self.where[entry]
        bound = np.round(np.bincount(where, factor * self.most[entry]) + 10.0 ** -DIGITS / 100, DIGITS)
        ranked = np.argsort(-bound, kind="stable")  # of equal bounds the smallest number comes first
        ranked = ranked[: np.count_nonzero(bound > 10.0 ** -DIGITS / 2)]
        numbers, cosines = np.zeros(0, np.int64), np.zeros(0)
        low, few, chosen = 0, 4, np.zeros(len(bound), bool)
        while low < len(ranked):
            ahead = ranked[low]
            if len(cosines) >= k and (bound[ahead], -ahead * self.block) < (cosines[k - 1], -numbers[k - 1]):
                break
            now = ranked[low : low + few]
            chosen[:] = False
            chosen[now] = True
            mine = chosen[where]
            some = entry[mine]
            counts = self.end[some] - self.begin[some]
            post = _ranges(self.begin[some], counts)
            cos = np.round(np.bincount(self.owner[post], np.repeat(factor[mine], counts) * self.weight[post]), DIGITS)
            if without is not None:
                cos[without[without < len(cos)]] = 0
            found = np.flatnonzero(cos)
            numbers, cosines = np.concatenate((numbers, found)), np.concatenate((cosines, cos[found]))
            best = np.lexsort((numbers, -cosines))[:k]
            numbers, cosines = numbers[best], cosines[best]
            self.looked += len(now)
            low, few = low + few, min(2 * few, 64)
        return numbers, cosines


class Examples:
    """What the tasks need: vocabulary, idf, index, labels and ids of the examples, and the curve."""

    def __init__(self, terms: list[bytes], idf: np.ndarray, rows: list[dict]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.idf = idf
        self.toxic = np.array([r["toxic"] for r in rows], float)
        self.ids = [r["doc_id"] for r in rows]
        self.vectors = [self._unit(np.array(r["terms"], np.int64), np.array(r["counts"], float)) for r in rows]
        self.index = Index(self.vectors, len(terms))
        copies: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            copies.setdefault(r["copy"], []).append(i)
        self.copies = [np.array(copies[r["copy"]]) for r in rows]
        self.base = float(self.toxic.mean()) if rows else 0.0
        self.curve = np.zeros(3)

    def _unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(np.maximum(counts, 1))) * self.idf[terms]
        return terms, weights / max(float(np.sqrt((weights * weights).sum())), 1e-300)

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        found = sorted((self.number[t], n) for t, n in terms_of(text).items() if t in self.number)
        return self._unit(np.array([t for t, _ in found], np.int64), np.array([n for _, n in found], float))

    def features(self, numbers: np.ndarray, cosines: np.ndarray) -> tuple[float, float]:
        """The neighbours' vote by weights, pulled to the base rate by one more vote, and the largest cosine."""
        return (float((cosines * self.toxic[numbers]).sum()) + self.base) / (float(cosines.sum()) + 1), float(cosines.max(initial=0.0))

    def score(self, vote: float, nearest: float) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-(a + b * _logit(vote) + c * nearest))))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fitted_curve(votes: np.ndarray, nearest: np.ndarray, toxic: np.ndarray, steps: int = 50) -> np.ndarray:
    """Coefficients of a logistic curve in the log-odds of the vote and the largest cosine, by damped Newton steps."""
    x = np.stack([np.ones(len(votes)), _logit(votes), nearest], 1)
    w = np.array([0.0, 1.0, 0.0])
    ridge = np.diag([0.01, 0.1, 0.1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ (w - [0.0, 1.0, 0.0]))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of the examples, counted by label within a batch."""
    for part, texts in byte_batches(batches):
        sums: dict[bytes, list[int]] = {}
        for toxic, text in zip(part.column("toxic").to_pylist(), texts):
            for t in terms_of(text):
                sums.setdefault(t, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1] for s in sums.values()], pa.int64())],
                                         names=["term", "clean", "toxic"])


def examples(docs: DataFrame, known: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Examples | None:
    """The index over at most ``rows`` labelled documents, those with the smallest hashes of their ids (of rows with one id, the least text).

    ``known`` are the documents labels may be learned from, ``labels(doc_id, toxic)`` their labels of 0 and 1 (1 if a document
    has both); document frequencies are counted over all ``docs``. None if either label is missing.
    """
    spark = docs.sparkSession
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # ids alone are sorted; the texts of the chosen ones come after
    chosen = written(known.select("doc_id").distinct().join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = known.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = written(texts.withColumn("copy", F.xxhash64(F.coalesce("text", F.lit("")))))
    size = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return None
    clean_rows, toxic_rows = size[0], size[1]
    counts = texts.mapInArrow(_pairs, "term binary, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n, all_rows = F.col("clean") + F.col("toxic"), clean_rows + toxic_rows
    spread = F.abs(F.col("toxic") * F.lit(float(clean_rows)) - F.col("clean") * F.lit(float(toxic_rows)))
    chi = F.pow(F.greatest(spread - all_rows / 2, F.lit(0.0)), 2) * all_rows / (n * (all_rows - n) * F.lit(float(clean_rows) * toxic_rows))
    telling = counts.where((n >= MIN_EXAMPLES) & (n < all_rows) & (F.col("term") != ANY)).withColumn("chi", chi).where(F.col("chi") >= CHI_SQUARE)
    terms = sorted(bytes(r["term"]) for r in telling.orderBy(F.col("chi").desc(), "term").limit(TERMS).select("term").collect()) + [ANY]
    number = {t: i for i, t in enumerate(terms)}
    sent = spark.sparkContext.broadcast(number)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        found, total = np.zeros(len(number), np.int64), 0
        for _, texts in byte_batches(batches):
            total += len(texts)
            for text in texts:
                for t in terms_of(text):
                    i = number.get(t)
                    if i is not None:
                        found[i] += 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(found))], pa.int64()), pa.array([total, *found.tolist()], pa.int64())], names=["term", "n"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for part, texts in byte_batches(batches):
            found = [sorted((number[t], n) for t, n in terms_of(text).items() if t in number) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "copy", "toxic")), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.int64())),
                 pa.array([[c for _, c in f] for f in found], pa.list_(pa.int64()))], names=["doc_id", "copy", "toxic", "terms", "counts"])

    sums = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row per term
    frequency = {r["term"]: r["n"] for r in sums}
    idf = np.log((frequency[-1] + 1) / (np.array([frequency[i] for i in range(len(terms))], float) + 1)) + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = texts.mapInArrow(vectors, f"doc_id {kind}, copy long, toxic int, terms array<long>, counts array<long>").toArrow().to_pylist()
    # examples with like terms stand together, so that few blocks have high bounds
    held.sort(key=lambda r: (sorted(r["terms"], key=lambda t: -idf[t])[:3], r["copy"], r["doc_id"]))
    out = Examples(terms, idf, held)
    out.curve = _curve(texts, out)
    return out


def _curve(texts: DataFrame, built: Examples) -> np.ndarray:
    """The curve from the votes each example gets from the others; examples of equal text do not vote."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(built)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = sent.value
        for batch in batches:
            rows = []
            for i in batch.column("id").to_pylist():
                terms, weights = built.vectors[i]
                rows.append((*built.features(*built.index.nearest(terms, weights, NEIGHBOURS, built.copies[i])), built.toxic[i]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows)], names=["vote", "nearest", "toxic"])

    each = spark.range(len(built.ids)).mapInArrow(run, "vote double, nearest double, toxic double").toArrow()  # at most LABELLED_ROWS rows
    return fitted_curve(*(each.column(c).to_numpy() for c in ("vote", "nearest", "toxic")))


def scored(docs: DataFrame, labels: DataFrame, held_out: str, rows: int = LABELLED_ROWS) -> DataFrame:
    """Toxicity of every whole text of ``docs(doc_id, text)`` by its nearest examples.

    ``held_out`` is an SQL condition over ``docs``; labels are learned from the other rows, at most ``rows`` of them, and not from null
    ids. Returns ``doc_id, held_out, score, predicted`` (1 from a score of 0.7) and the evidence: ``nearest`` (largest
    cosine), ``evidence`` (ids of the three nearest examples) and ``evidence_terms`` (up to five terms that
    weigh most in the cosine with the nearest one; a star marks a stem, a star alone any word). Null and empty texts have no neighbour and get what
    such examples get. Repeated rows are scored alike. Without labels of both kinds scores are 0. Every row is scored by itself, in one pass.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.select("doc_id", "text", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    known = held.where("not held_out and doc_id is not null").select("doc_id", "text")
    sent = spark.sparkContext.broadcast(examples(held, known, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = sent.value
        names = [t.decode(errors="replace") for t in built.number] if built else []
        plain = None  # neighbours of texts without a telling term, which all have one vector
        for part, texts in byte_batches(batches):
            out = []
            for text in texts:
                if built is None:
                    out.append((0.0, 0.0, [], []))
                    continue
                terms, weights = built.vector(text)
                if len(terms) != 1 or names[terms[0]] != ANY.decode():
                    numbers, cosines = built.index.nearest(terms, weights, NEIGHBOURS)
                else:
                    plain = numbers, cosines = plain or built.index.nearest(terms, weights, NEIGHBOURS)
                why = []
                if len(numbers):
                    own = dict(zip(*map(np.ndarray.tolist, built.vectors[numbers[0]])))
                    shared = sorted((-w * own[t], t) for t, w in zip(terms.tolist(), weights.tolist()) if t in own)
                    why = [names[t] for _, t in shared[:5]]
                vote, nearest = built.features(numbers, cosines)
                out.append((built.score(vote, nearest), nearest, [built.ids[i] for i in numbers[:3]], why))
            score, nearest, ids, why = (list(c) for c in zip(*out)) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= PREDICT_FROM) for s in score], pa.int32()),
                 pa.array(nearest, pa.float64()), pa.array(ids, pa.list_(part.schema.field("doc_id").type)), pa.array(why, pa.list_(pa.string()))],
                names=["doc_id", "held_out", "score", "predicted", "nearest", "evidence", "evidence_terms"])

    return held.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, nearest double, evidence array<{kind}>, evidence_terms array<string>")
