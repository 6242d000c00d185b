"""Packing tokenised documents into sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import math
import re
import sys
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablescout.llm.common import byte_batches, written

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE = 4096
GROUP = 768
END = 2
CACHED = 250_000
# A remainder's last tokens are a piece of their own, so that windows have small pieces to even them out.
TAIL_FROM, TAIL_TO = 32, 512

# What the tokenizer cuts text into before merging; fixed by its file.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Beyond these, lower case or composed forms may need more than one word, so whole texts go to the tokenizer.
_ODD = re.compile(r"[^\x00-\x1b\x20-ɏ‐-‧€]")

_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, place long"


class WordIds:
    """Ids of white-space separated words as little-endian 32-bit bytes, kept for words seen before.

    The tokenizer cuts text at white space before anything else, so a text's ids are those of its words in turn.
    Texts where that could fail (special tokens, characters with context-dependent lower case) are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = regex.compile(_PARTS)
        # words and their parts, in lower case; when the young are CACHED, the old ones not met since are forgotten
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def text(self, text: str) -> bytes:
        if "<|" in text or _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, new = self.young.get, self._ids
        return b"".join([known(w) or new(w) for w in text.lower().split()])

    def _ids(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isalpha():
                ids = self._merged(word)
            else:
                parts = [word[:-1], word[-1]] if word[:-1].isalpha() and word[-1] in ".,;:!?" else self.parts.findall(word)
                ids = b"".join([self.young.get(p) or self._ids(p) for p in parts]) if len(parts) > 1 else self._merged(word)
        if len(self.young) >= CACHED:
            self.old, self.young = self.young, {}
        self.young[word] = ids
        return ids

    def _merged(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isprintable() else "".join(map(self.letters.__getitem__, part.encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(shown)])


def word_ids(path: str) -> WordIds:
    """One ``WordIds`` per Python worker and file, so that later tasks find the words of earlier ones."""
    kept = sys.modules.setdefault("_tablescout_word_ids", ModuleType("_tablescout_word_ids"))
    if path not in kept.__dict__:
        kept.__dict__[path] = WordIds(path)
    return kept.__dict__[path]


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Documents as token ids with an end id, cut into full sequences, a remainder and its tail.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens`` and ``place``, a hash of the text that deals
    pieces out to groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer).text
        for part, texts in byte_batches(batches):
            rows: list[tuple] = []
            for i, text in enumerate(texts):
                ids = ids_of(text.decode()) + END.to_bytes(4, "little")
                n, crc = len(ids) // 4, zlib.crc32(ids)
                starts = list(range(0, n, sequence))
                tail = TAIL_FROM + crc % (TAIL_TO - TAIL_FROM)
                if n - starts[-1] > 2 * tail and n % sequence:
                    starts.append(n - tail)
                for start, end in zip(starts, [*starts[1:], n]):
                    rows.append((i, start, end - start, zlib.crc32(ids[4 * start : 4 * end]), n, crc))
            owner, *columns = np.array(rows, np.int64).T
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner)), *map(pa.array, columns)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_PIECES}")


def differenced(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: item numbers in ``ways`` parts of near-equal sums.

    A partial partition is kept as its parts' sums, largest first, and as many tree nodes that hold the parts' items. The two
    with the largest spread are merged again and again, the largest part of one with the smallest of the other.
    """
    n, heap = len(sizes), []
    halves = np.zeros((2 * n, 2), np.int64)
    for i, size in enumerate(sizes):
        sums, nodes = np.zeros(ways, np.int64), np.full(ways, -1)
        sums[0], nodes[0] = size, i
        heapq.heappush(heap, (-size, i, sums, nodes))
    free = n
    while len(heap) > 1:
        _, i, sums, nodes = heapq.heappop(heap)
        _, _, more, other = heapq.heappop(heap)
        other = other[::-1]
        both = np.flatnonzero((nodes >= 0) & (other >= 0))
        new = np.arange(free, free + len(both))
        halves[new, 0], halves[new, 1] = nodes[both], other[both]
        free += len(both)
        nodes = np.maximum(nodes, other)
        nodes[both] = new
        sums = sums + more[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), i, sums, nodes[order]))
    parts = []
    for node in heap[0][3].tolist() if heap else []:
        items, open_ = [], [node] if node >= 0 else []
        while open_:
            node = open_.pop()
            if node < n:
                items.append(node)
            else:
                open_ += halves[node].tolist()
        parts.append(items)
    return parts


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers in few near-equal windows that hold them; their number rises whenever one runs over.

    It rises at once to where the largest window would fit if it exceeded the mean as much again.
    """
    total = sum(sizes)
    ways = -(-total // capacity)
    while True:
        parts = differenced(sizes, ways)
        largest = max((sum(sizes[i] for i in p) for p in parts), default=0)
        if largest <= capacity:
            return [p for p in parts if p]
        room = capacity - (largest - total / ways)
        ways = max(ways + 1, math.floor(total / room) if room > capacity / 2 else 0)


def packed(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in sequences of at most ``sequence`` tokens.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: the piece holds ids ``start`` to
    ``start + length`` of its document and lies at ``offset`` of its sequence. Full sequences are cut off
    each document first, and a short tail off the remainder; the pieces are dealt by a hash (of their row too where id and text are repeated) into groups with about ``group`` remainders, and each group
    is packed by differencing. Only lengths are shuffled, from a written table, so the groups are the same if a task
    runs again. Null texts count as empty and give a piece with the end id.
    Null ids are kept; repeated rows are packed each.
    """

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in ("doc_id", "doc_tokens", "place", "start")]
        rows = rows.sort_by(order)
        lengths = rows.column("length").to_numpy()
        full = lengths == sequence
        rest = np.flatnonzero(~full)
        number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        filled = windows(lengths[rest].tolist(), sequence)
        for w, part in enumerate(filled):
            own = rest[sorted(part)]
            number[own] = w
            offset[own] = np.cumsum(lengths[own]) - lengths[own]
        number[full] = len(filled) + np.arange(full.sum())
        at = key[0].as_py() * (1 << 32) + number
        return rows.drop_columns(["place", "bin"]).append_column("sequence_id", pa.array(at)).append_column("offset", pa.array(offset))

    cut = written(pieces(docs, tokenizer, sequence))
    bins = max(1, round(cut.where("start = 0").count() / group))
    same = ["doc_id", "doc_tokens", "place", "start"]
    repeated = cut.groupBy(*same).count().where("count > 1 and doc_id is not null").select(*same, F.lit(True).alias("repeated"))
    dealt = cut.withColumn("row", F.monotonically_increasing_id()).join(repeated, same, "left")
    spread = F.xxhash64(F.coalesce("doc_id", "row"), "doc_tokens", "place", "start", F.when(F.col("repeated"), F.col("row")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.select(*cut.columns, F.pmod(spread, F.lit(bins)).alias("bin")).groupBy("bin").applyInArrow(fill, schema)
