"""Quality rules: document statistics, two fixed rules, and boosted trees fitted to quality labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import Rolling, byte_batches, mixed, word_spans, written
from tablescout.llm.trees import Trees, grown

LABELLED_ROWS = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5

# Counts every document gets, in the order of the columns.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_bytes", "n_lines", "n_upper", "n_lower", "n_digits", "n_stops", "n_shouts", "n_distinct_words", "n_wide", "n_quiet_ends"]

# Features of the trees; quality may only fall with those of sign -1.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "digit_share": 0, "stop_rate": 0, "shout_rate": -1, "distinct_share": 0, "wide_share": 0, "words_per_line": 0, "quiet_lines": 0,
}


def _members(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_SYMBOLS, _UPPER, _LOWER = _members(b"#*$%&|<>"), _members(bytes(range(65, 91))), _members(bytes(range(97, 123)))
_DIGITS, _STOPS, _SHOUTS = _members(b"0123456789"), _members(b".?;:"), _members(b"!")


def _repeats(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each item whether its hash occurs more than once with the same owner."""
    tagged = mixed(hashes + mixed(owner.astype(np.uint64) + np.uint64(1)))
    _, where, counts = np.unique(tagged, return_inverse=True, return_counts=True)
    return counts[where] > 1


def counts_of(texts: list[bytes], rolling: Rolling) -> dict[str, np.ndarray]:
    """All counts of ``COUNTS`` and ``MORE`` for each text."""
    n = len(texts)
    joined, starts, ends, owner = word_spans(texts)
    buffer = np.frombuffer(joined, np.uint8)
    lengths = np.array([len(t) for t in texts])
    begin = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    sums = rolling.prefix(buffer)

    def per_text(mask):
        return np.add.reduceat(mask, begin, dtype=np.int64)

    def per_owner(own, weights=None):
        return np.bincount(own, weights, n).astype(np.int64)

    gap = (buffer == 32) | ((buffer - np.uint8(9)) < 5)
    words = rolling.of(sums, starts, ends)
    three = np.flatnonzero(owner[:-2] == owner[2:]) if len(owner) > 2 else np.zeros(0, np.int64)
    grams = words[three] + mixed(words[three + 1] + np.uint64(7)) * np.uint64(3) + mixed(words[three + 2] + np.uint64(11)) * np.uint64(5)
    found = three[_repeats(owner[three], grams)] if len(three) else three
    repeated = np.zeros(len(starts), bool)
    for step in range(3):
        repeated[found + step] = True

    breaks = np.flatnonzero(buffer == 10)
    line_start = np.sort(np.concatenate((begin, breaks + 1)))
    line_end = np.sort(np.concatenate((begin + lengths, breaks)))
    solid = np.concatenate(([0], np.cumsum(~gap)))
    full = solid[line_end] > solid[line_start]
    line_start, line_end = line_start[full], line_end[full]
    line_owner = np.searchsorted(begin, line_start, "right") - 1
    lines = mixed(rolling.of(sums, line_start, line_end) + (line_end - line_start).astype(np.uint64))
    distinct_lines = np.unique(np.stack((line_owner.astype(np.uint64), lines), 1), axis=0)[:, 0].astype(np.int64) if len(lines) else line_owner
    distinct_words = np.unique(mixed(words + mixed(owner.astype(np.uint64) + np.uint64(1))), return_index=True)[1] if len(words) else starts
    quiet = ~(_STOPS | _SHOUTS)[buffer[np.maximum(line_end - 1, 0)]]
    return {
        "n_words": per_owner(owner), "word_chars": per_text(~gap & ((buffer & 0xC0) != 0x80)), "n_symbols": per_text(_SYMBOLS[buffer]),
        "n_dup_lines": per_owner(line_owner) - per_owner(distinct_lines), "n_repeat_words": per_owner(owner, repeated),
        "n_bytes": lengths, "n_lines": per_owner(line_owner), "n_upper": per_text(_UPPER[buffer]), "n_lower": per_text(_LOWER[buffer]),
        "n_digits": per_text(_DIGITS[buffer]), "n_stops": per_text(_STOPS[buffer]), "n_shouts": per_text(_SHOUTS[buffer]),
        "n_distinct_words": per_owner(owner[distinct_words]), "n_wide": per_text(buffer > 127), "n_quiet_ends": per_owner(line_owner, quiet),
    }


def features_of(c: dict[str, np.ndarray]) -> np.ndarray:
    """Feature rows in the order of ``FEATURES`` from the counts."""
    def share(a, b):
        return a / np.maximum(b, 1)

    words, chars, lines = c["n_words"], c["word_chars"], c["n_lines"]
    columns = {
        "log_words": np.log1p(words), "word_length": share(chars, words), "symbol_share": share(c["n_symbols"], chars),
        "dup_line_share": share(c["n_dup_lines"], lines), "repeat_share": share(c["n_repeat_words"], words),
        "upper_share": share(c["n_upper"], c["n_upper"] + c["n_lower"]), "digit_share": share(c["n_digits"], chars),
        "stop_rate": share(c["n_stops"], words), "shout_rate": share(c["n_shouts"], words),
        "distinct_share": share(c["n_distinct_words"], words), "wide_share": share(c["n_wide"], c["n_bytes"]),
        "words_per_line": share(words, lines), "quiet_lines": share(c["n_quiet_ends"], lines),
    }
    return np.stack([columns[f] for f in FEATURES], 1).astype(float)


def _base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of ``COUNTS`` and ``MORE`` for every whole text (null: no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(5)
        for part, texts in byte_batches(batches):
            counts = counts_of(texts, rolling)
            columns = [part.column("doc_id"), *(pa.array(counts[c]) for c in names)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names])

    names = [*COUNTS, *MORE]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names))


def fitted(stats: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Trees | None:
    """Trees for ``labels(doc_id, quality)`` of 0 and 1, fitted to at most ``rows`` labelled documents.

    The documents with the smallest hashes of their ids are taken, so the choice depends on nothing else. Rows
    with null ids or other labels are left out. None if either label is missing: the rules then decide alone.
    """
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    taken = stats.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(rows).toArrow()
    counts = {c: taken.column(c).to_numpy() for c in [*COUNTS, *MORE]}
    y = taken.column("quality").to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    return grown(features_of(counts), y, np.array(list(FEATURES.values())))


def _verdict(counts: dict[str, np.ndarray], trees: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = _base_failed(counts)
    quality = trees.probability(features_of(counts)) if trees else np.ones(len(failed))
    return failed, quality, ~failed & (quality >= KEEP_FROM)


def quality_report(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """Counts, rules and the verdict of the trees for every row of ``docs(doc_id, text)``.

    Returns ``doc_id``, the columns of ``COUNTS``, ``base_failed``, ``quality`` (probability of a good document) and
    ``kept``. Null and empty texts have no words and fail the rules. Repeated rows are judged alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            counts = {c: part.column(c).to_numpy() for c in [*COUNTS, *MORE]}
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(part.column(c) for c in COUNTS), *map(pa.array, _verdict(counts, trees))],
                names=["doc_id", *COUNTS, "base_failed", "quality", "kept"])

    stats = written(statistics(docs))
    trees = fitted(stats, labels, rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality double, kept boolean"
    return stats.mapInArrow(run, schema)


def good_documents(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """The rows of ``docs`` the report keeps, with all their columns; the text is read twice and never shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(5)
        for part, texts in byte_batches(batches):
            yield part.filter(pa.array(_verdict(counts_of(texts, rolling), trees)[2]))

    trees = fitted(written(statistics(docs)), labels, rows)
    return docs.mapInArrow(run, docs.schema)
