"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.llm.common import byte_batches, mixed
from tablescout.session import small_frame

SLOT_BITS = 15
ORDERS = (1, 2, 3)
TRAIN_ROWS = 6_000
MAX_LANGUAGES = 512
PASSES = 3
BATCH = 64
TOGETHER = 256
UNDETERMINED = "und"


@dataclass(frozen=True)
class Weights:
    """Languages, slot weights with IDF in them (sparse rows are zero), biases, temperature, and logs of true over learned shares."""

    languages: list[str]
    slots: np.ndarray
    bias: np.ndarray
    temperature: float
    prior: np.ndarray


def slots_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of whole texts in lower case: slot and owner of every occurrence."""
    clean = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(clean).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in clean])
    slots, owners, value = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        size = max(0, len(codes) - n + 1)
        value = value[:size] * np.uint64(1 << 21) + codes[n - 1 : n - 1 + size]
        if n in ORDERS:
            inside = owner[:size] == owner[n - 1 : n - 1 + size]
            slots.append((mixed(value[inside] * np.uint64(4) + np.uint64(n)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
            owners.append(owner[:size][inside])
    return np.concatenate(slots), np.concatenate(owners)


def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, slot) pairs in order with their counts, for at most ``TOGETHER`` texts."""
    slots, owners = slots_of(texts)
    counts = np.bincount(owners << SLOT_BITS | slots, minlength=0)
    pairs = np.flatnonzero(counts)
    return pairs >> SLOT_BITS, pairs & ((1 << SLOT_BITS) - 1), counts[pairs]


def _few(texts: list[bytes]) -> Iterator[list[str]]:
    for low in range(0, len(texts), TOGETHER):
        yield [t.decode() for t in texts[low : low + TOGETHER]]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(1 << SLOT_BITS, np.int64)
    for _, texts in byte_batches(batches, limit=1 << 20):
        for few in _few(texts):
            totals += np.bincount(_rows(few)[1], minlength=len(totals))
    at = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], names=["slot", "n"])


class Follower:
    """Follow-the-regularised-leader with elastic-net penalties, for one weight row per slot."""

    def __init__(self, rows: int, columns: int, rate: float = 0.5, l1: float = 0.02, l2: float = 0.01):
        self.z, self.n = np.zeros((rows, columns)), np.zeros((rows, columns))
        self.rate, self.l1, self.l2 = rate, l1, l2

    def weights(self, rows: np.ndarray | slice) -> np.ndarray:
        z = self.z[rows]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((1 + np.sqrt(self.n[rows])) / self.rate + self.l2))

    def step(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        """One update of distinct ``rows``."""
        grown = self.n[rows] + gradient**2
        sigma = (np.sqrt(grown) - np.sqrt(self.n[rows])) / self.rate
        self.z[rows] += gradient - sigma * self.weights(rows)
        self.n[rows] = grown


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _normalised(owner: np.ndarray, slot: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF values of unit length per text."""
    values = count * idf[slot]
    return values / np.sqrt(np.maximum(np.bincount(owner, values**2, n), 1e-12))[owner]


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many texts each language gives, ``rows`` in all: equal parts, and what small languages leave goes to the others."""
    out, left = {}, rows
    for k, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = min(counts[lang], max(1, left // (len(counts) - k)))
        left -= out[lang]
    return out


def fitted(texts: list[str], labels: list[str], idf: np.ndarray, counts: dict[str, int]) -> Weights:
    """Fit on texts in the given order; the last fifth of each language is kept for the temperature.

    ``counts`` are the texts of each language in the whole table: the sample's shares are corrected to theirs.
    """
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    sampled = np.bincount(y, minlength=len(languages))
    place = np.zeros(len(y), np.int64)
    for k in range(len(languages)):
        place[y == k] = np.arange(sampled[k])
    kept = place >= (sampled - sampled // 5)[y]
    order = np.argsort(kept, kind="stable")
    texts, y, cut = [texts[i] for i in order], y[order], int((~kept).sum())
    true = np.array([counts[x] for x in languages], float)
    weight = true / true.sum() / (sampled / sampled.sum())
    prior = np.log(weight)
    model, bias = Follower(1 << SLOT_BITS, len(languages)), Follower(1, len(languages), l1=0)
    logits = []
    for turn in range(PASSES + 1):
        bounds = (0, cut) if turn < PASSES else (cut, len(texts))
        for low in range(*bounds, BATCH):
            high = min(low + BATCH, bounds[1])
            owner, slot, count = _rows(texts[low:high])
            value = _normalised(owner, slot, count, idf, high - low)
            rows, where = np.unique(slot, return_inverse=True)
            x = np.zeros((high - low, len(rows)))
            x[owner, where] = value
            logit = x @ model.weights(rows) + bias.weights(slice(0, 1))
            if turn == PASSES:
                logits.append(logit)
                continue
            error = _softmax(logit)
            error[np.arange(len(error)), y[low:high]] -= 1
            model.step(rows, x.T @ error)
            bias.step(np.array([0]), error.sum(0, keepdims=True))
    temperature = 1.0
    if cut < len(texts):
        held, target = np.concatenate(logits), y[cut:]
        tried = np.geomspace(0.05, 20, 121)
        losses = [-np.average(np.log(np.maximum(_softmax(held / t + prior)[np.arange(len(target)), target], 1e-12)), weights=weight[target]) for t in tried]
        temperature = float(tried[int(np.argmin(losses))])
    return Weights(languages, model.weights(slice(None)) * idf[:, None], bias.weights(slice(0, 1))[0], temperature, prior)


def predicted(texts: list[str], weights: Weights, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language number and calibrated probability of each whole text."""
    owner, slot, count = _rows(texts)
    length = np.sqrt(np.maximum(np.bincount(owner, (count * idf[slot]) ** 2, len(texts)), 1e-12))
    used = weights.slots.any(1)[slot]
    owner, slot, count = owner[used], slot[used], count[used]
    logit = np.stack([np.bincount(owner, count * weights.slots[slot, k], len(texts)) for k in range(len(weights.languages))], 1)
    p = _softmax((logit / length[:, None] + weights.bias) / weights.temperature + weights.prior)
    best = p.argmax(1)
    return best, p[np.arange(len(p)), best]


def identified(docs: DataFrame, held_out: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """Language of every whole text of ``docs(doc_id, text, lang)``.

    ``held_out`` is an SQL condition over ``docs``; only other rows with a text and a language are learned from: their document
    frequencies and the shares of the languages from all of them, the weights from at most ``rows`` (one for each language at least). Every language gives
    as many texts, or all it has, those with the smallest hashes of id and text; the true shares come in as priors. Returns
    ``doc_id, held_out, lang_pred, score``. ``lang_pred`` is ``und`` with score 0 for null texts, texts without
    a letter, and if there is nothing to learn from. ``lang`` is never read for a prediction. Repeated rows are learned from and judged each.
    """
    spark = docs.sparkSession
    held = docs.select("doc_id", "text", "lang", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    known = held.where("not held_out and text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = known.select("text").mapInArrow(_document_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found, total = counts.toArrow(), known.count()  # at most one row per slot
    frequency = np.zeros(1 << SLOT_BITS)
    frequency[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    idf = np.log((total + 1) / (frequency + 1)) + 1
    languages = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    place = F.xxhash64("doc_id", "text")
    # hashes are even: enough lie below a bound for each language, of which its quota is taken
    shares = [(lang, n, -(1 << 63) + min((1 << 64) - 1, (n + 6 * math.isqrt(n) + 10) * (1 << 64) // languages[lang])) for lang, n in quotas(languages, rows).items()]
    bounds = F.broadcast(small_frame(spark, shares, "lang string, quota long, below long"))
    sample = known.withColumn("place", place).join(bounds, "lang").where("place <= below")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    sample = sample.withColumn("number", number).where("number <= quota").orderBy("place", "text").select("text", "lang")
    weights = _fit_in_a_task(sample, idf, languages) if languages else None
    sent = spark.sparkContext.broadcast((idf, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, plain = sent.value
        weights = Weights(*plain) if plain else None
        for part, texts in byte_batches(batches, limit=1 << 20):
            letters = part.column("letters").to_numpy(zero_copy_only=False)
            names, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            if weights:
                best, p = map(np.concatenate, zip(*(predicted(few, weights, idf) for few in _few(texts))))
                names[letters] = np.array(weights.languages, object)[best[letters]]
                scores[letters] = p[letters]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores)],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = held.select("doc_id", "text", "held_out", F.coalesce(F.expr(r"text rlike '\\p{L}'"), F.lit(False)).alias("letters"))
    return read.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _fit_in_a_task(sample: DataFrame, idf: np.ndarray, counts: dict[str, int]) -> tuple:
    """Weights as plain values, fitted by one task to the bounded sample."""
    sent = sample.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            labels += b.column("lang").to_pylist()
        w = fitted(texts, labels, sent.value, counts)
        yield pa.RecordBatch.from_arrays([pa.array([w.languages]), pa.array([w.slots.tobytes()]), pa.array([w.bias.tobytes()]), pa.array([w.temperature]),
                                          pa.array([w.prior.tobytes()])], names=["languages", "slots", "bias", "temperature", "prior"])

    row = sample.coalesce(1).mapInArrow(run, "languages array<string>, slots binary, bias binary, temperature double, prior binary").first()
    slots = np.frombuffer(row.slots).reshape(1 << SLOT_BITS, -1)
    return row.languages, slots, np.frombuffer(row.bias), row.temperature, np.frombuffer(row.prior)
