"""Repeated passages by a depth-limited radix sort of suffixes.

A suffix is ordered through its first ``length`` bytes only, by passes that go from the coarsest digit to the finest:

1. Digit one of a window of ``length`` bytes is the smallest hash among its ``DIGIT``-byte substrings: windows with
   equal text have it in common. Neighbouring windows mostly share it too and form a *run*, one row for about
   a hundred suffixes.
2. Digit two is the text common to ``BLOCK`` neighbouring windows of a run, counted from where digit one lies.
3. Digit three is the whole window. Equal groups are exactly the repeated windows.

Before each finer pass, groups of one member are dropped with all their suffixes, members with equal text are
settled at once, and only one member for each different text of a group goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import Rolling, byte_batches, doc_key, free_name, mixed, removed, word_spans, written

LENGTH = 400
DIGIT = 200
BLOCK = 16
BATCH = 1 << 20
PASSAGE = 50
WORD_BYTES = 4

_RUNS = "key long, digit long, body long, start long, windows long, again boolean"
_TEXTS = "key long, digit long, start long, windows long, many boolean, periodic boolean, text binary"
_BLOCKS = "key long, digit long, run long, group long, body long, start long, windows long, many boolean"
_WINDOWS = "digit long, body long, key long, start long, many boolean"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, from running minima within blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _pieces(texts: list[bytes], length: int, size: int) -> Iterator[tuple[int, int, bytes]]:
    """Texts cut into pieces of at most ``size`` window starts: (text, offset, bytes)."""
    for i, text in enumerate(texts):
        for low in range(0, len(text) - length + 1, size):
            yield i, low, text[low : low + size + length - 1]


def _joined(pieces: Iterator[tuple[int, int, bytes]], size: int) -> Iterator[list[tuple[int, int, bytes]]]:
    group, held = [], 0
    for piece in pieces:
        group.append(piece)
        held += len(piece[2])
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def _runs(group: list[tuple[int, int, bytes]], length: int, digit: int, first: Rolling, second: Rolling):
    """Runs of the pieces: piece, first window, digit value, hash of the whole run, windows, value met twice."""
    sizes = np.array([len(p[2]) for p in group])
    buffer = np.frombuffer(b"".join(p[2] for p in group), np.uint8)
    begin = np.cumsum(sizes) - sizes
    sums = first.prefix(buffer)
    at = np.arange(len(buffer) - digit + 1)
    grams = first.of(sums, at, at + digit)
    width = length - digit + 1
    least = _sliding_min(grams, width)
    inside = np.ones(len(least), bool)
    for end in begin[1:]:
        inside[max(0, end - length + 1) : end] = False
    change = np.flatnonzero((least[1:] != least[:-1]) | (inside[1:] != inside[:-1])) + 1
    starts = np.concatenate(([0], change))
    counts = np.diff(np.append(starts, len(least)))
    real = inside[starts]
    starts, counts = starts[real], counts[real]
    value = least[starts]
    body = second.of(second.prefix(buffer), starts, starts + counts + length - 1)
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    again = np.zeros(len(starts), bool)
    for low in range(0, len(starts), 4096):
        part = slice(low, low + 4096)
        left = starts[part] + (views[starts[part]] == value[part, None]).argmax(1)
        ends = starts[part] + counts[part] - 1
        right = ends + width - 1 - (views[ends][:, ::-1] == value[part, None]).argmax(1)
        again[part] = left != right
    piece = np.searchsorted(begin, starts, "right") - 1
    return piece, starts - begin[piece], value, body, counts, again


def _rows(schema: str, **columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n]) for n in names], names=names)


def _run_rows(length: int, digit: int):
    """Pass one: the runs of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Rolling(1), Rolling(2)
        for part, texts in byte_batches(batches):
            keys = part.column("key").to_numpy()
            for group in _joined(_pieces(texts, length, BATCH), BATCH):
                owner = np.array([p[0] for p in group])
                offset = np.array([p[1] for p in group])
                piece, start, value, body, counts, again = _runs(group, length, digit, first, second)
                yield _rows(_RUNS, key=keys[owner[piece]], digit=value.view(np.int64), body=body.view(np.int64),
                            start=start + offset[piece], windows=counts, again=again)

    return run


def _text_rows(length: int):
    """The text of each run that goes on to a finer pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_batches(batches):
            keys, lists = part.column("key").to_pylist(), part.column("runs").to_pylist()
            for key, text, runs in zip(keys, texts, lists):
                for low in range(0, len(runs), 4096):
                    some = runs[low : low + 4096]
                    yield _rows(
                        _TEXTS, key=[key] * len(some), text=[text[r["start"] : r["start"] + r["windows"] + length - 1] for r in some],
                        **{n: [r[n] for r in some] for n in ("digit", "start", "windows", "many", "periodic")})

    return run


def _block_rows(length: int, digit: int, block: int):
    """Pass two: blocks of neighbouring windows, by the text all windows of a block share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Rolling(1), Rolling(2)
        for part, texts in byte_batches(batches):
            buffer = np.frombuffer(b"".join(texts), np.uint8)
            begin = np.cumsum([0, *map(len, texts)])
            grams, sums = first.prefix(buffer), second.prefix(buffer)
            digits, windows = part.column("digit").to_numpy(), part.column("windows").to_numpy()
            row, at, low, high = [], [], [], []
            for i, n in enumerate(windows):
                spots = np.arange(begin[i], begin[i + 1] - digit + 1)
                place = int((first.of(grams, spots, spots + digit).view(np.int64) == digits[i]).argmax())
                number = np.arange(max(0, (place - n + 1) // block), place // block + 1)
                row.append(np.full(len(number), i))
                at.append(place - block * number)  # where the block's last window would begin
                low.append(np.maximum(place - block * number - block + 1, 0))
                high.append(np.minimum(place - block * number, n - 1))
            row, at, low, high = map(np.concatenate, (row, at, low, high))
            base = begin[row]
            core = first.of(grams, base + at, base + at + length - block + 1)
            body = second.of(sums, base + low, base + high + length)
            pick = lambda name: part.column(name).to_numpy(zero_copy_only=False)[row]
            yield _rows(_BLOCKS, key=pick("key"), digit=digits[row], run=pick("start"),
                        group=mixed(core ^ digits[row].view(np.uint64)).view(np.int64), body=body.view(np.int64),
                        start=pick("start") + low, windows=high - low + 1, many=pick("many"))

    return run


def _window_rows(length: int):
    """Pass three: every window of the parts given, by its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, held = Rolling(2), []

        def rows() -> pa.RecordBatch:
            digit, body, key, start, many = map(np.concatenate, zip(*held))
            held.clear()
            return _rows(_WINDOWS, digit=digit, body=body, key=key, start=start, many=many)

        for part, texts in byte_batches(batches):
            columns = [part.column(n).to_pylist() for n in ("key", "digit", "start", "parts")]
            for key, digit, start, parts, text in zip(*columns, texts):
                whole = np.frombuffer(text, np.uint8)
                for p in parts:
                    for low in range(p["start"], p["start"] + p["windows"], BATCH):
                        n = min(BATCH, p["start"] + p["windows"] - low)
                        buffer, at = whole[low - start : low - start + n + length - 1], np.arange(n)
                        body = second.of(second.prefix(buffer), at, at + length)
                        held.append((np.full(n, digit), body.view(np.int64), np.full(n, key), at + low, np.full(n, p["many"])))
                        if n >= BATCH // 8 or len(held) >= 2000:
                            yield rows()
        if held:
            yield rows()

    return run


def _settled(members: DataFrame, group: str, one: list[str], many) -> tuple[DataFrame, DataFrame]:
    """Per group and text: how many members and one of them; and the groups with several texts."""
    bodies = written(members.groupBy(group, "body").agg(
        (many | (F.count("*") > 1)).alias("many"), F.min(F.struct(*one)).alias("one")))
    several = bodies.groupBy(group).agg(F.count("*").alias("texts")).where("texts > 1").select(group)
    return bodies, several


def repeated_spans(docs: DataFrame, length: int = LENGTH, digit: int = DIGIT, block: int = BLOCK) -> DataFrame:
    """Byte spans ``key, start, end`` (end excluded) covered by windows that start anywhere else as well.

    ``docs`` has ``key`` (a long given by the content of the row, see ``doc_key``) and ``text``. Spans may overlap.
    Texts are compared by pairs of independent 64-bit hashes.
    """
    if not 2 * block < digit < length - block:
        raise ValueError("a digit must be longer than two blocks and shorter than a window without a block")
    everything = written(docs.mapInArrow(_run_rows(length, digit), _RUNS))
    digits = everything.groupBy("digit").agg(F.count("*").alias("n"), F.max("again").alias("periodic"))
    digits = digits.where("n > 1 or periodic").select("digit", "periodic")
    runs = written(everything.join(digits, "digit"))
    removed(everything)

    bodies, several = _settled(runs, "digit", ["key", "start", "windows", "periodic"], F.lit(False))
    spans = [runs.join(bodies.where("many").select("digit", "body"), ["digit", "body"], "left_semi")
             .select("key", "start", F.expr(f"start + windows + {length - 1}").alias("end"))]
    further = bodies.where("one.periodic").join(several, "digit", "left_anti").where("not many").union(
        bodies.join(several, "digit", "left_semi")).select("digit", "many", "one.*")
    lists = further.groupBy("key").agg(F.collect_list(F.struct("digit", "start", "windows", "many", "periodic")).alias("runs"))
    texts = written(docs.join(lists, "key").mapInArrow(_text_rows(length), _TEXTS))

    blocks = written(texts.where("not periodic").mapInArrow(_block_rows(length, digit, block), _BLOCKS))
    bodies, several = _settled(blocks, "group", ["key", "run", "start", "windows"], F.max("many"))
    spans.append(blocks.where("not many").join(bodies.where("many").select("group", "body"), ["group", "body"], "left_semi")
                 .select("key", "start", F.expr(f"start + windows + {length - 1}").alias("end")))
    parts = bodies.join(several, "group", "left_semi").select("one.key", "one.run", "one.start", "one.windows", "many")
    whole = texts.where("periodic").select("key", F.col("start").alias("run"), "start", "windows", "many")
    parts = parts.union(whole).groupBy("key", "run").agg(F.collect_list(F.struct("start", "windows", "many")).alias("parts"))
    fine = texts.join(parts.withColumnRenamed("run", "start"), ["key", "start"])
    windows = written(fine.select("key", "digit", "start", "parts", "text").mapInArrow(_window_rows(length), _WINDOWS))

    place = F.struct("key", "start")
    equal = windows.groupBy("digit", "body").agg(F.max("many").alias("many"), (F.min(place) != F.max(place)).alias("more"))
    equal = equal.where("many or more").select("digit", "body")
    spans.append(windows.where("not many").join(equal, ["digit", "body"], "left_semi")
                 .select("key", "start", F.expr(f"start + {length}").alias("end")))
    return spans[0].union(spans[1]).union(spans[2])


def _merged(lists: pa.ListArray) -> list[list[list[int]]]:
    """For each list of spans the maximal runs they cover, in order; a text may have as many spans as bytes, so in numpy."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    spans = lists.flatten()
    start, end = (pc.struct_field(spans, n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "end"))
    out: list[list[list[int]]] = [[] for _ in range(len(lists))]
    if not len(start):
        return out
    apart = int(end.max()) + 2
    owner = np.repeat(np.arange(len(lists)), sizes) * apart
    order = np.argsort(start + owner, kind="stable")
    low, high = (start + owner)[order], np.maximum.accumulate((end + owner)[order])
    first = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1])))
    last = np.append(first[1:], len(low)) - 1
    for i, s, e in zip((low[first] // apart).tolist(), (low[first] % apart).tolist(), (high[last] % apart).tolist()):
        out[i].append([s, e])
    return out


def _kept(text: bytes, spans: list[list[int]]) -> bytes:
    at, out = 0, []
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])


def _whole_characters(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The largest part of a span that does not cut a character."""
    while start < end and text[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def with_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, str]:
    """``docs`` with the list of repeated byte spans of its text (null: none) in one more column, and that column's name."""
    return _with_spans(docs, lambda keyed: repeated_spans(keyed, length))


def _with_spans(docs: DataFrame, spans_of) -> tuple[DataFrame, str]:
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, doc_key())
    column = free_name(keyed, "_spans")
    spans = spans_of(keyed.select(F.col(key).alias("key"), "text"))
    spans = spans.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("start", "end")).alias(column))
    return keyed.join(spans, key, "left").drop(key), column


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """What removing every repeated window of ``length`` bytes leaves of each row of ``docs(doc_id, text)``.

    Returns ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs) and ``kept_sha256`` of the remaining
    bytes. A null text counts as empty; texts shorter than a window stay whole. Rows equal in id and text are
    copies of each other like any others; null ids are kept as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_batches(batches):
            spans = _merged(part.column("spans"))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(map(len, texts), pa.int64()),
                pa.array((sum(e - s for s, e in x) for x in spans), pa.int64()), pa.array(map(len, spans), pa.int64()),
                pa.array(hashlib.sha256(_kept(t, x)).hexdigest() for t, x in zip(texts, spans)),
            ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked, column = with_spans(docs.select("doc_id", "text"), length)
    marked = marked.select("doc_id", "text", F.col(column).alias("spans"))
    return marked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated windows cut out of ``text``, in whole characters; other columns as they are.

    A character that lies only partly in a removed span stays. Null texts stay null.
    """
    def whole(texts: list[bytes], lists: list[list[list[int]]]) -> list[list[tuple[int, int]]]:
        return [[_whole_characters(t, s, e) for s, e in spans] for t, spans in zip(texts, lists)]

    return _cut(docs, *with_spans(docs, length), whole)


def _cut(docs: DataFrame, marked: DataFrame, column: str, spans_of) -> DataFrame:
    """``docs`` without the byte spans that ``spans_of`` makes of the texts and the merged lists in ``column``."""
    names = docs.columns
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_batches(batches):
            given, lists = part.column(part.schema.get_field_index("text")), _merged(part.column(at))
            out = [_kept(t, s).decode() if g.is_valid else None for g, t, s in zip(given, texts, spans_of(texts, lists))]
            columns = [pa.array(out, pa.string()) if n == "text" else c for n, c in zip(names, part.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.select(*names, column).mapInArrow(run, docs.schema)


def _word_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as binary: ``WORD_BYTES`` bytes of a hash for each word."""
    rolling = Rolling(3)
    for part, texts in byte_batches(batches):
        joined, starts, ends, owner = word_spans(texts)
        sums = rolling.prefix(np.frombuffer(joined, np.uint8))
        words = (rolling.of(sums, starts, ends) >> np.uint64(64 - 8 * WORD_BYTES)).astype("<u4")
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        yield pa.RecordBatch.from_arrays(
            [part.column("key"), pa.array([words[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], names=["key", "text"])


def without_passages(docs: DataFrame, words: int = PASSAGE) -> DataFrame:
    """``docs`` without passages of ``words`` or more words that occur anywhere else as well, word for word; other columns as they are.

    The radix passes run over texts of ``WORD_BYTES``-byte hashes of words, so a window is ``words`` hashes long and neither white space nor
    the length of words matters. Every word of a repeated window is cut, in all places, with the white space between them; overlaps
    count, and windows are judged on the texts as given. Passages never cross rows; they may repeat within one. Words are
    ``[^\\x20\\x09-\\x0D]+``, compared with their case. Null texts stay null, empty ones empty; rows equal in id and text are copies
    of each other like any others. An empty table stays empty. Texts are read whole, in one task each.
    """
    length = words * WORD_BYTES

    def spans_of(keyed: DataFrame) -> DataFrame:
        hashed = written(keyed.mapInArrow(_word_texts, "key long, text binary"))
        return repeated_spans(hashed, length, length // 2, min(BLOCK, length // 6))

    def whole(texts: list[bytes], lists: list[list[list[int]]]) -> list[list[tuple[int, int]]]:
        _, starts, ends, owner = word_spans(texts)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(owner, np.arange(len(texts)))
        out = []
        for i, spans in enumerate(lists):
            rounded = ((first[i] - (-s // WORD_BYTES), first[i] + e // WORD_BYTES - 1) for s, e in spans)
            out.append([(int(starts[a] - offsets[i]), int(ends[b] - offsets[i])) for a, b in rounded])
        return out

    return _cut(docs, *_with_spans(docs, spans_of), whole)
