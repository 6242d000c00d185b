"""Language-model scores by online logistic context mixing.

A text is its words in lower case and an end. The words most frequent in the training texts are coded by the bits of their
rank. Others are coded by an escape, the bits of how often they were met, and then by their place among the words met that often; words
never met are one symbol, as for add-one unigrams, and can be spelled by the bits of their bytes on top of that. The bits of ranks and of the
escape are predicted from the class of the text, the last word, the last two words, and the last word with the class, each with the bits of the word so far; the last three are
hashed contexts. The bits of bytes are predicted from hashed contexts of the bytes before. The predictions are added up in the logistic domain by weights chosen by a gate
and learned (for bytes online), and for bytes the sum is refined by the shares of ones met before. A text also tells its class, one of 16,
by its commonest kind of non-ASCII character; the class is paid for once.

Counts of all contexts come from all training texts: words are counted by Spark, and each different word gives its bits
once, with its count. The contexts of words are counted over all training texts in turn. The weights of their predictions are learned
from all of these as well: a second pass counts every occurrence by the levels of its predictions, and the weights are those under which these
counts are likeliest. Every occurrence is learned as if it were new, without itself: a word met once counts as unknown. Tables and
weights have a fixed size; only the words themselves grow with the corpus, and they stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import Rolling, byte_batches, doc_key, mixed, word_spans, written
from tablescout.llm.mixing_model import CONTEXTS, GATES, LIMIT, SLOT_BITS, STEPS, Mixer, Refinement, Spelling, confidence, inputs_of, predictions, squashed, stretched

RANK_BITS = 17
BUCKETS = 64
COMMON = (1 << RANK_BITS) - BUCKETS
COMMON_RANKS = COMMON
COMMON_FROM = 8
CLASSES = 16
WORDS_AT_ONCE = 20_000
WORDS_HELD = 600_000  # counted rows of a task before they are added up
ESCAPE_DEPTH = RANK_BITS - 6  # the buckets are the last ranks, behind as many bits that are all set
PAST = 3
FIRST_BITS = 18
PAST_BITS = 19
PAST_GATES = RANK_BITS * 16
GROUPS = [0, 4, 8, ESCAPE_DEPTH, ESCAPE_DEPTH + 4, RANK_BITS]  # of bits of a rank
WORDS_IN_TURN = 16_384  # worked on at once
TEXT_AT_ONCE = 1 << 20  # bytes, as the hashes of a text take about 40 times its bytes
BLOCK = 1 << 12  # counts in a row
LEVEL_EDGES = np.array([-4.5, -2.5, -1.2, -0.2, 0.2, 1.2, 2.5, 4.5])
LEVELS = len(LEVEL_EDGES) + 1  # of a prediction, by which occurrences are counted
CELLS = LEVELS * 4 * LEVELS * 4 * LEVELS * LEVELS * 2  # of a depth
FIRM = 20.0  # occurrences by which the weights to begin with count

_COUNTED = "word string, class long, train long, texts long"


def _classes(texts: list[bytes]) -> np.ndarray:
    """Class of each text: 0 if few bytes are beyond ASCII, else from the commonest second byte of its characters."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    at = np.flatnonzero((joined & 0xC0) == 0x80)
    owner = np.searchsorted(np.cumsum(lengths), at, "right")
    kinds = np.bincount(owner * 64 + (joined[at] & 63), minlength=64 * len(texts)).reshape(-1, 64)
    return np.where(200 * kinds.sum(1) > lengths, 1 + kinds.argmax(1) % (CLASSES - 1), 0)


@dataclass
class _Batch:
    """Words of a few texts: hashes, owners, and the bytes behind them."""

    joined: bytes
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    hashes: np.ndarray
    classes: np.ndarray

    @staticmethod
    def of(texts: list[bytes], rolling: Rolling) -> _Batch:
        joined, starts, ends, owner = word_spans([t.lower() for t in texts])
        sums = rolling.prefix(np.frombuffer(joined, np.uint8))
        return _Batch(joined, starts, ends, owner, rolling.of(sums, starts, ends), _classes(texts))

    def words(self, at: np.ndarray) -> pa.Array:
        sizes = self.ends[at] - self.starts[at]
        to = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=to[1:])
        data = np.frombuffer(self.joined, np.uint8)[np.repeat(self.starts[at] - to[:-1], sizes) + np.arange(to[-1])]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data))


def _word_hashes(words: list[bytes], rolling: Rolling) -> np.ndarray:
    end = np.cumsum([len(w) for w in words], dtype=np.int64)
    start = end - np.array([len(w) for w in words], np.int64)
    return rolling.of(rolling.prefix(np.frombuffer(b"".join(words), np.uint8)), start, end)


def word_counts(docs: DataFrame) -> DataFrame:
    """Tokens of ``docs(text, train)`` by word and class: how often in training texts, and in all.

    The end of a text counts as the empty word.
    """

    def merged(held: list[tuple]) -> tuple:
        keys, words, classes, train, texts = zip(*held)
        _, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        sums = [np.bincount(where, np.concatenate(n), len(first)).astype(np.int64) for n in (train, texts)]
        return pa.concat_arrays(words).take(pa.array(first)), np.concatenate(classes)[first], *sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held = Rolling(6), []

        def rows() -> pa.RecordBatch:
            columns = merged(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "class", "train", "texts"])

        for part, texts in byte_batches(batches, limit=TEXT_AT_ONCE):
            b = _Batch.of(texts, rolling)
            train = part.column("train").to_numpy(zero_copy_only=False)
            own = b.classes[b.owner]
            keys, first, where = np.unique(b.hashes + mixed(own.astype(np.uint64) + np.uint64(1)), return_index=True, return_inverse=True)
            counts = [np.bincount(where, train[b.owner], len(first)).astype(np.int64), np.bincount(where, minlength=len(first))]
            ends = np.unique(b.classes)
            closed = [np.array([w[b.classes == c].sum() for c in ends], np.int64) for w in (train, np.ones(len(train)))]
            held.append((
                np.concatenate((keys, _EMPTY + mixed(ends.astype(np.uint64) + np.uint64(1)))),
                pa.concat_arrays([b.words(first), pa.array([""] * len(ends), pa.string())]), np.concatenate((own[first], ends)),
                *(np.concatenate(x) for x in zip(counts, closed)),
            ))
            if sum(len(h[0]) for h in held) >= WORDS_HELD:
                yield rows()
        if held:
            yield rows()

    found = docs.select("text", "train").mapInArrow(run, _COUNTED)
    return found.groupBy("word", "class").agg(F.sum("train").alias("train"), F.sum("texts").alias("texts"))


@dataclass
class _Sequence:
    """Words of a few texts with the end of each in its place: owners, hashes, and hashes of what precedes them."""

    owner: np.ndarray
    hashes: np.ndarray
    classes: np.ndarray
    past: list[np.ndarray]

    @staticmethod
    def of(b: _Batch) -> _Sequence:
        texts = np.arange(len(b.classes))
        at = np.searchsorted(b.owner, texts, "right")
        owner, hashes = np.insert(b.owner, at, texts), np.insert(b.hashes, at, _EMPTY)
        first = np.concatenate(([True], owner[1:] != owner[:-1]))[: len(owner)]
        last = np.where(first, np.uint64(1), np.concatenate(([np.uint64(1)], hashes[:-1]))[: len(owner)])
        before = np.where(first, np.uint64(1), np.concatenate(([np.uint64(1)], last[:-1]))[: len(owner)])
        classes = b.classes[owner]
        two = mixed(last + before * np.uint64(0x9E3779B97F4A7C15))
        return _Sequence(owner, hashes, classes, [last, two, mixed(last + classes.astype(np.uint64) + np.uint64(1))])


def _steps(sequence: _Sequence, ranks: np.ndarray, part: slice):
    """Groups of bits of the ranks (-1: escape) of some of the words: depths, the words that have them, by depth and word the bits so far behind a one, of the rank
    and of the group, and the place of the group in the table of each context.

    Without their last bit, bits behind a one are a node. Slots of a group lie within neighbours, in an order of their own for each context, so that a context is hashed once for a group
    and read from one or two lines of the cache: place ^ node is a slot, and 2 * place ^ bits that of a bit.
    """
    ranks = ranks[part]
    ranks = np.where(ranks < 0, COMMON_RANKS, ranks) | (1 << RANK_BITS)
    past = [p[part] for p in sequence.past]
    for low, high in pairwise(GROUPS):
        rows = slice(None) if high <= ESCAPE_DEPTH else np.flatnonzero(ranks < COMMON_RANKS + (1 << RANK_BITS))
        own, depth = ranks[rows], np.arange(low, high)[:, None]
        spread = (own >> (RANK_BITS - low)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        bits, one = own >> (RANK_BITS - 1 - depth), 2 << (depth - low)
        places = [(mixed(p[rows] + spread) >> np.uint64(64 - PAST_BITS)).view(np.int64) for p in past]
        yield depth, rows, bits, (bits & (one - 1)) | one, places


def _all_so_far(here: np.ndarray, before: np.ndarray) -> np.ndarray:
    """By depth and word, whether it holds here, at all depths above, and before."""
    return np.broadcast_to(before, here.shape) if here.all() else np.logical_and.accumulate(here, axis=0) & before


def _parts(n: int) -> Iterator[slice]:
    for low in range(0, n, WORDS_IN_TURN):
        yield slice(low, low + WORDS_IN_TURN)


def _past_mixer() -> Mixer:
    """Weights that trust the class alone until others are learned."""
    mixer = Mixer(PAST_GATES, PAST + 2)
    mixer.weights[:] = 0
    mixer.weights[:, 0] = 1
    return mixer


@dataclass(frozen=True)
class Model:
    """What scoring needs on every executor: common words with their log10 probabilities, the counts and weights of preceding words, and the spelling model."""

    tokens: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray
    bucket: np.ndarray
    escape: np.ndarray
    places: np.ndarray
    at_home: np.ndarray
    places_of: np.ndarray
    nodes: np.ndarray
    past: np.ndarray
    past_mixer: Mixer
    tables: np.ndarray
    mixer: Mixer
    refinement: Refinement

    def plain(self, *names: str) -> dict:
        """Some fields and tables as numbers and arrays, as broadcasts are read where this package may be missing."""
        own = {name: getattr(self, name) for name in names}
        own |= {"mixer": self.mixer.weights} if "mixer" in names else {}
        return own | ({"refinement": (self.refinement.ones, self.refinement.seen)} if "refinement" in names else {})

    @staticmethod
    def of(plain: dict) -> Model:
        own = dict.fromkeys((f.name for f in fields(Model))) | plain
        if "mixer" in plain:
            own["mixer"] = Mixer(GATES, CONTEXTS + 1)
            own["mixer"].weights = plain["mixer"]
        if "refinement" in plain:
            own["refinement"] = Refinement(*plain["refinement"])
        tables = {name: own.pop(name) for name in ("stretched_past", "found") if name in own}
        model = Model(**own)
        vars(model).update(tables)
        return model

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.distinct + 1))

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words in the common list, -1 for others."""
        return _found(self.hashes, hashes, self.first)

    @cached_property
    def first(self) -> np.ndarray:
        return _first(self.hashes)

    @cached_property
    def stretched_past(self) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
        """Flat nodes, stretched prediction of every slot, confidence of the slots of the last word (four times) and the last two words, and by gate the weights and what the constant gives, in single precision."""
        seen = self.past[:, :, 0] + self.past[:, :, 1]
        steps = [confidence(seen[0]).astype(np.uint8) * np.uint8(4), confidence(seen[1]).astype(np.uint8)]
        weights = self.past_mixer.weights.astype(np.float32)
        constant = (self.past_mixer.weights[:, -1] * 0.3).astype(np.float32)
        return self.nodes.ravel(), [stretched(n[:, 0], n[:, 1]).astype(np.float32) for n in self.past], steps, np.ascontiguousarray(weights[:, :-1]), constant

    def in_turn(self, sequence: _Sequence, at: np.ndarray) -> np.ndarray:
        """log10 probability of each word (its place in the common list, -1: the escape) after the words before it.

        Where the last word was never met before the bits so far, the class alone predicts the others.
        """
        ranks = np.where(at >= 0, self.places_of[at], -1) if len(self.places_of) else at
        odds = np.ones(len(ranks))  # one over the probability
        for part in _parts(len(ranks)):
            odds[part] = self._odds(sequence, ranks, part)
        return -np.log10(odds)

    def _odds(self, sequence: _Sequence, ranks: np.ndarray, part: slice) -> np.ndarray:
        nodes, stretch, steps, weights, constant = self.stretched_past
        weights = weights.view(np.complex128).ravel()  # the four of a gate are read at once
        home = sequence.classes[part] * (1 << RANK_BITS)
        odds, open_ = np.ones(len(home)), np.ones(len(home), bool)
        for depth, rows, bits, within, places in _steps(sequence, ranks, part):
            node = within >> 1
            slots = [place ^ node for place in places]
            np.right_shift(bits, 1, out=node)
            node += home[rows]
            p, gate = nodes.take(node), steps[0].take(slots[0])
            still = _all_so_far(gate > 0, open_[rows])
            gate += steps[1].take(slots[1])
            gate = depth * 16 + gate
            weight = weights.take(gate).view(np.float32).reshape(*gate.shape, PAST + 1)
            logit = weight[:, :, 0] * p
            for j, slot in enumerate(slots):
                logit += weight[:, :, 1 + j] * stretch[j].take(slot)
            logit += constant.take(gate)
            if not still.all():
                logit = np.where(still, logit, p)
            np.clip(logit, np.float32(-LIMIT), np.float32(LIMIT), out=logit)
            turned = bits.astype(np.uint32)
            turned <<= np.uint32(31)  # the sign changes with the bit
            turned ^= logit.view(np.uint32)
            np.exp(turned.view(np.float32), out=logit)
            logit += np.float32(1)
            for factor in logit:
                odds[rows] *= factor
            open_[rows] = still[-1]
        return odds

    def rare(self, counts: np.ndarray, own: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 probability, after the escape, of uncommon words met ``counts`` times, ``own`` times of these in texts of the class."""
        at = _bucket(counts)
        within, all_of = self.places[classes, at], self.places[CLASSES, at]
        place = np.where(own > 0, self.at_home[classes] / np.maximum(within, 1), 0) + (1 - self.at_home[classes]) / np.maximum(all_of, 1)
        return self.bucket[classes, at] - self.escape[classes] + np.where(counts > 0, np.log10(place), 0)

    @cached_property
    def found(self) -> tuple[list[np.ndarray], np.ndarray]:
        return predictions(self.tables)

    def spelled(self, words: list[bytes], classes: np.ndarray) -> np.ndarray:
        """log10 probability of the bytes of each word and their end, in a text of the class."""
        spelling, total = Spelling(words, classes, Rolling(7)), np.zeros(len(words))
        for bit, slots, head in spelling.bits():
            inputs, known = inputs_of(slots, self.found)
            gate = head + 256 * known
            p = self.refinement.refined(self.mixer.mix(inputs, gate), gate)
            total += np.bincount(spelling.word, np.log10(np.where(bit == 1, p, 1 - p)), len(words))
        return total


def _first(sorted_hashes: np.ndarray) -> np.ndarray:
    """Where hashes with the same first bits begin among the sorted ones."""
    return np.searchsorted(sorted_hashes >> np.uint64(64 - FIRST_BITS), np.arange((1 << FIRST_BITS) + 1, dtype=np.uint64)).astype(np.int32)


def _found(sorted_hashes: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the hashes stand among the sorted ones, -1 for others."""
    out, top = np.full(len(hashes), -1), (hashes >> np.uint64(64 - FIRST_BITS)).astype(np.int64)
    at, end = first.take(top), first.take(top + 1)
    left = np.flatnonzero(at < end)
    at, end = at[left], end[left]
    while len(left):
        hit = sorted_hashes.take(at) == hashes[left]
        out[left[hit]] = at[hit]
        more = ~hit & (at + 1 < end)
        left, at, end = left[more], at[more] + 1, end[more]
    return out


def _node_logits(probabilities: np.ndarray) -> np.ndarray:
    """Logits of a set bit at every node (class, node) of the tree over the ranks; the children of node n are 2n and 2n + 1."""
    out = np.zeros((len(probabilities), 1 << RANK_BITS), np.float32)
    level = 10**probabilities
    for depth in range(RANK_BITS - 1, -1, -1):
        pair = np.maximum(level.reshape(len(level), -1, 2), 1e-300)
        out[:, 1 << depth : 2 << depth] = np.log(pair[:, :, 1] / pair[:, :, 0])
        level = pair.sum(2)
    return out


def _places(ranks_of):
    """Texts of a part as a sequence of words with their ranks, -1 for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Sequence, np.ndarray]]:
        hashes, places_of = ranks_of
        rolling, first = Rolling(6), _first(hashes)
        for _, texts in byte_batches(batches, limit=TEXT_AT_ONCE):
            sequence = _Sequence.of(_Batch.of(texts, rolling))
            at = _found(hashes, sequence.hashes, first)
            yield sequence, np.where(at >= 0, places_of[at], -1) if len(places_of) else at

    return run


def _sums(totals: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbouring counts, where there are any, as rows: one for each count would be as many rows as the texts have words."""
    blocks = np.pad(totals, (0, -len(totals) % BLOCK)).reshape(-1, BLOCK)
    at = np.flatnonzero(blocks.any(1))
    for low in range(0, len(at), 128):
        some = at[low : low + 128]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([b.astype("<i8").tobytes() for b in blocks[some]], pa.binary())], names=["at", "counts"])


_ONE = np.int32(1)
_MANY_WORDS = 1 << 26  # a word adds at most one for each bit


def _past_counts(ranks_of):
    """Counts of bits by slot over one part of the training texts; slots count on over the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, words = np.zeros((PAST, 2 << PAST_BITS), np.int32), 0
        for sequence, ranks in _places(ranks_of())(batches):
            for part in _parts(len(ranks)):
                for _, _, _, within, places in _steps(sequence, ranks, part):
                    for count, place in zip(totals, places):
                        np.add.at(count, (2 * place ^ within).ravel(), _ONE)
            words += len(ranks)
            if words >= _MANY_WORDS:
                yield from _sums(totals.ravel())
                totals[:], words = 0, 0
        yield from _sums(totals.ravel())

    return run


def _level(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVEL_EDGES, x, "right")


def _without_one(past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (slot, bit): what a slot predicts, and how often it was met, without one occurrence of the bit; by slot and bit."""
    n0, n1 = past[:, 0], past[:, 1]
    less0, less1 = np.maximum(n0 - 1, 0), np.maximum(n1 - 1, 0)
    x = np.stack([stretched(less0, n1), stretched(n0, less1)], 1).ravel()
    return x, np.stack([less0 + n1, n0 + less1], 1).ravel()


def _past_codes(past: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each context: the level of an occurrence of a bit in a slot, for the first two with how often it was met; and the mean prediction of each level over all occurrences."""
    codes, means = [], np.zeros((PAST, LEVELS))
    for j, counts in enumerate(past):
        x, met = _without_one(counts)
        level, n = _level(x), counts.ravel().astype(float)
        means[j] = np.bincount(level, x * n, LEVELS) / np.maximum(np.bincount(level, n, LEVELS), 1)
        codes.append((level + LEVELS * confidence(met) if j < 2 else level).astype(np.uint8))
    return codes, means


def _past_cells(known_of):
    """Occurrences of bits in one part of the training texts, by depth, the levels of their predictions, how often the last and the last two words were met, and the bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks_of, levels, (last_codes, two_codes, homely_codes) = known_of()
        inner = LEVELS * 2  # by level of the class and bit
        flat = (2 * levels.ravel()[:, None] + np.arange(2, dtype=np.uint8)).ravel()
        homely_codes = homely_codes.astype(np.uint16) * np.uint16(4 * LEVELS)
        totals, words = np.zeros(RANK_BITS * CELLS, np.int32), 0
        for sequence, ranks in _places(ranks_of)(batches):
            for part in _parts(len(ranks)):
                home = sequence.classes[part] * (2 << RANK_BITS)
                open_ = np.ones(len(home), bool)
                for depth, rows, bits, within, places in _steps(sequence, ranks, part):
                    last, two, homely = (code.take(2 * place ^ within) for code, place in zip((last_codes, two_codes, homely_codes), places))
                    # words go on while the last word was met without this occurrence
                    still = _all_so_far(last >= LEVELS, open_[rows])
                    own = np.multiply(last, inner, dtype=np.uint16)
                    own += flat.take(bits + home[rows])
                    homely += two
                    cell = np.multiply(homely, 4 * LEVELS * inner, dtype=np.int64)
                    cell += own
                    cell += depth * CELLS
                    np.add.at(totals, cell.ravel() if still.all() else cell[still], _ONE)
                    open_[rows] = still[-1]
            words += len(ranks)
            if words >= _MANY_WORDS:
                yield from _sums(totals)
                totals[:], words = 0, 0
        yield from _sums(totals)

    return run


def _past_weights(cells: np.ndarray, base_means: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Weights of the predictions for each gate: those under which the bits of all counted occurrences are likeliest, by Newton's method."""
    weights = _past_mixer().weights
    at = np.flatnonzero(cells)
    n, depth, code = cells[at], at // CELLS, at % CELLS
    parts = []
    for size in (2, LEVELS, LEVELS, 4, LEVELS, 4, LEVELS):
        parts.append(code % size)
        code = code // size
    bit, own, last, met, two, met_two, homely = parts
    inputs = np.stack([base_means[depth, own], means[0, last], means[1, two], means[2, homely], np.full(len(n), 0.3)], 1)
    gate = depth * 16 + met * 4 + met_two
    order = np.argsort(gate, kind="stable")
    ends = np.searchsorted(gate[order], np.arange(PAST_GATES + 1))
    for g, (low, high) in enumerate(pairwise(ends)):
        rows, start, w = order[low:high], weights[g].copy(), weights[g].copy()
        if low == high:
            continue
        x, y, m = inputs[rows], bit[rows], n[rows]

        def loss(w, x=x, y=y, m=m, start=start):
            z = np.clip(x @ w, -LIMIT, LIMIT)
            return (m * np.logaddexp(0, np.where(y == 1, -z, z))).sum() + FIRM / 2 * ((w - start) ** 2).sum()

        now = loss(w)
        for _ in range(20):
            p = squashed(x @ w)
            slope = x.T @ (m * (p - y)) + FIRM * (w - start)
            step = np.linalg.solve((x * (m * p * (1 - p))[:, None]).T @ x + FIRM * np.eye(len(w)), slope)
            while (then := loss(w - step)) > now and np.abs(step).max() > 1e-6:
                step = step / 2
            if then >= now:
                break
            w, now, gain = w - step, then, now - then
            if gain < 1e-6 * now:
                break
        weights[g] = w
    return weights


def _bucket(counts: np.ndarray) -> np.ndarray:
    """Counts to 8 by themselves, larger ones by powers of two."""
    return np.where(counts <= 8, counts, 6 + np.floor(np.log2(np.maximum(counts, 1)))).astype(np.int64)


def _bucket_of(count):
    return F.when(count <= 8, count).otherwise(6 + F.floor(F.log2(count.cast("double")))).cast("int")


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and how often each is there."""
    rows = rows[np.lexsort(rows.T)]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(1))))
    return rows[first], np.diff(np.append(first, len(rows)))


def _rank_model(counts: np.ndarray) -> np.ndarray:
    """log10 probabilities of ranks for each class, from counts (class, rank).

    The bits of a rank are predicted from its class and from all texts together.
    """
    nodes = []
    for c in [*counts, counts.sum(0)]:
        level, levels = c, []
        for _ in range(RANK_BITS):
            levels.append(level.reshape(-1, 2))
            level = level.reshape(-1, 2).sum(1)
        nodes.append(levels[::-1])
    mixer = Mixer(RANK_BITS * 4, 3)

    def events(parts: list[np.ndarray], depth: int, bit: int | None):
        """Inputs and gates at nodes with these counts in the class and in all; given a bit, without one occurrence of it."""
        out, gate = [], None
        for n in parts:
            n0, n1 = (n[:, 0], n[:, 1]) if bit is None else (np.maximum(n[:, 0] - (bit == 0), 0), np.maximum(n[:, 1] - (bit == 1), 0))
            out.append(stretched(n0, n1))
            gate = confidence(n0 + n1) if gate is None else gate
        return np.stack([*out, np.full(len(out[0]), 0.3)], 1), gate + 4 * depth

    present = [c for c in range(CLASSES) if counts[c].sum()]
    learned = []  # all nodes, those with equal counts at once
    for cls in present:
        for depth in range(RANK_BITS):
            for value in (0, 1):
                rows = np.flatnonzero(nodes[cls][depth][:, value])
                if len(rows):
                    both = np.concatenate([nodes[s][depth][rows] for s in (cls, CLASSES)], 1)
                    both, many = _distinct(both)
                    inputs, gate = events([both[:, :2], both[:, 2:]], depth, value)
                    learned.append((inputs, gate, value, both[:, value] * many))
    for _ in range(40):
        for inputs, gate, value, weight in learned:
            mixer.learn(inputs, gate, np.full(len(gate), value), weight.astype(float))
    out = np.zeros((CLASSES, 1 << RANK_BITS))
    for cls in range(CLASSES):
        total = np.zeros(1)
        for depth in range(RANK_BITS):
            inputs, gate = events([nodes[s][depth] for s in (cls, CLASSES)], depth, None)
            p = np.clip(squashed(mixer.mix(inputs, gate)), 1e-6, 1 - 1e-6)
            total = (total[:, None] + np.log10(np.stack([1 - p, p], 1))).ravel()
        out[cls] = total
    return out


def _table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of bits by slot over one part of the words; slots count on over the contexts."""
    totals, rolling = np.zeros((CONTEXTS, 2 << SLOT_BITS), np.int64), Rolling(7)
    for words, classes, weight in _spelled_words(batches):
        spelling = Spelling(words, classes, rolling)
        n = weight[spelling.word].astype(np.int64)
        for bit, slots, _ in spelling.bits():
            for count, slot in zip(totals, slots):
                slot *= 2
                slot += bit
                np.add.at(count, slot, n)
    yield from _sums(totals.ravel())


def _spelled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, WORDS_AT_ONCE):
            part = batch.slice(low, WORDS_AT_ONCE)
            words = part.column("word").cast(pa.binary()).to_pylist()
            yield words, part.column("class").to_numpy(), part.column("train").to_numpy()


def _mixer_rows(tables_of):
    """Weights and shares of ones learned online over one part of the words, to be averaged over the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, mixer, rolling = predictions(tables_of(), True), Mixer(GATES, CONTEXTS + 1), Rolling(7)
        seen, ones, cells = np.zeros(GATES), np.zeros(4 * STEPS), np.zeros(4 * STEPS)
        for words, classes, weight in _spelled_words(batches):
            spelling = Spelling(words, classes, rolling)
            n = weight[spelling.word].astype(float)
            for bit, slots, head in spelling.bits():
                inputs, known = inputs_of(slots, found, bit)
                gate = head + 256 * known
                logit = mixer.learn(inputs, gate, bit, n)
                cell = Refinement.cell(logit, gate)
                seen += np.bincount(gate, n, GATES)
                ones += np.bincount(cell, n * bit, len(ones))
                cells += np.bincount(cell, n, len(cells))
        values = np.concatenate(((mixer.weights * seen[:, None]).ravel(), seen, ones, cells))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "n"])

    return run


def _gathered(parts: DataFrame, size: int) -> np.ndarray:
    """Sums by position as an array; the positions are bounded by the model's fixed size."""
    rows = parts.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out


_BLOCKS = "at int, counts binary"


def _one_block(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_buffer(), "<i8") for c in rows.column("counts"))
    return pa.table([rows.column("at").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["at", "counts"])


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """Sums of blocks of counts as an array of the model's fixed size."""
    rows = parts.groupBy("at").applyInArrow(_one_block, _BLOCKS).toArrow()
    out = np.zeros((-(-size // BLOCK), BLOCK))
    for at, counts in zip(rows.column("at").to_pylist(), rows.column("counts")):
        out[at] = np.frombuffer(counts.as_buffer(), "<i8")
    return out.ravel()[:size]


def trained(counts: DataFrame, texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model for counted words and the training ``texts(text, key)`` in turn, and the words it spells: ``word, class, train, c`` (training count in all classes)."""
    spark = counts.sparkSession
    by_word = counts.groupBy("word").agg(F.sum("train").alias("c"), F.collect_list(F.struct("class", "train")).alias("by"))
    by_word = written(by_word)
    tokens, distinct = by_word.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    step = F.floor(F.log2(F.col("c").cast("double")) * 64)
    sizes = by_word.where(f"c >= {COMMON_FROM}").groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # 64 for each doubling
    sizes = [(r["step"], r["count"]) for r in sizes]
    fit = [s for i, (s, _) in enumerate(sizes) if sum(n for _, n in sizes[: i + 1]) <= COMMON]
    top = by_word.where(f"c >= {COMMON_FROM}").where(step >= (fit[-1] if fit else 1 << 30)).orderBy(F.desc("c"), "word")
    rows = top.toArrow()  # at most COMMON words
    words = [w.encode() for w in rows.column("word").to_pylist()]
    common = spark.createDataFrame(rows.select(["word"])) if words else by_word.select("word").limit(0)
    rest = by_word.join(F.broadcast(common), "word", "left_anti").select("word", "c", F.inline("by"))
    rest = written(rest)

    by_rank = np.zeros((CLASSES, 1 << RANK_BITS))
    by = rows.column("by").combine_chunks()
    by = by.chunk(0) if isinstance(by, pa.ChunkedArray) and by.num_chunks else by
    if len(words):
        each = by.flatten()
        ranks = np.repeat(np.arange(len(words)), by.value_lengths().to_numpy())
        np.add.at(by_rank, (each.field("class").to_numpy(), ranks), each.field("train").to_numpy())
    # the rest by bucket; an occurrence of a word met c times is one of a word met c - 1 times otherwise
    met = rest.where("c > 0")
    for r in met.groupBy("class", _bucket_of(F.col("c") - 1).alias("at")).agg(F.sum("train").alias("n")).collect():
        by_rank[r["class"], COMMON_RANKS + r["at"]] += r["n"]
    places = np.zeros((CLASSES + 1, BUCKETS))
    for r in met.groupBy("class", _bucket_of(F.col("c")).alias("at")).agg(F.count_if(F.col("train") > 0).alias("n")).collect():
        places[r["class"], r["at"]] = r["n"]
    for r in met.dropDuplicates(["word"]).groupBy(_bucket_of(F.col("c")).alias("at")).count().collect():
        places[CLASSES, r["at"]] = r["count"]
    at_home = np.full(CLASSES, 0.9)
    again = F.sum(F.when(F.col("train") > 1, F.col("train")).otherwise(0))
    for r in met.where("c > 1").groupBy("class").agg(F.sum("train").alias("n"), again.alias("m")).collect():
        at_home[r["class"]] = (r["m"] + 9) / (r["n"] + 10)
    probabilities = _rank_model(by_rank)

    known = rest.where("train > 0")
    tasks = spark.sparkContext.defaultParallelism  # one table for each, as a table is as large as the counts of many texts
    size = 2 << SLOT_BITS
    tables = _added(known.coalesce(tasks).mapInArrow(_table_rows, _BLOCKS), CONTEXTS * size)
    tables = tables.reshape(CONTEXTS, size // 2, 2).astype(np.float32)
    sent = spark.sparkContext.broadcast(tables)
    learned = _gathered(known.mapInArrow(_mixer_rows(lambda: sent.value), "at long, n double"), GATES * (CONTEXTS + 2) + 8 * STEPS)
    sums, seen, ones, cells = np.split(learned, np.cumsum([GATES * (CONTEXTS + 1), GATES, 4 * STEPS]))
    mixer = Mixer(GATES, CONTEXTS + 1)
    met = seen > 0
    mixer.weights[met] = sums.reshape(GATES, -1)[met] / seen[met, None]

    hashes = _word_hashes(words, Rolling(6)) if words else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    nodes, bucket = _node_logits(probabilities), probabilities[:, COMMON_RANKS:]
    del probabilities
    ranked = spark.sparkContext.broadcast((hashes[order], order))
    size = PAST * 2 << PAST_BITS
    texts = texts.select("text").coalesce(tasks)
    past = _added(texts.mapInArrow(_past_counts(lambda: ranked.value), _BLOCKS), size)
    past = past.reshape(PAST, -1, 2).astype(np.float32)
    # every occurrence in all training texts by its cell, so that the weights depend neither on a sample nor on the cluster
    codes, means = _past_codes(past)
    levels = _level(nodes)
    base_means = np.zeros((RANK_BITS, LEVELS))
    for depth in range(RANK_BITS):
        at = slice(1 << depth, 2 << depth)
        met, level = by_rank.reshape(CLASSES, 1 << depth, -1).sum(2).ravel(), levels[:, at].ravel()
        base_means[depth] = np.bincount(level, met * nodes[:, at].ravel(), LEVELS) / np.maximum(np.bincount(level, met, LEVELS), 1)
    del by_rank
    known_past = spark.sparkContext.broadcast(((hashes[order], order), levels.astype(np.uint8), codes))
    occurrences = _added(texts.mapInArrow(_past_cells(lambda: known_past.value), _BLOCKS), RANK_BITS * CELLS)
    known_past.destroy()
    past_mixer = _past_mixer()
    past_mixer.weights = _past_weights(occurrences, base_means, means)
    del occurrences, codes, levels

    escape = np.log10((10**bucket).sum(1))
    model = Model(tokens, distinct, hashes[order], rows.column("c").to_numpy()[order].astype(np.int64), bucket, escape, places, at_home, order, nodes, past, past_mixer,
                  tables, mixer, Refinement(ones, cells))
    return model, rest


def _word_scores(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rolling = model_of(), Rolling(6)
        for batch in batches:
            for low in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.slice(low, WORDS_AT_ONCE)
                words = part.column("word").cast(pa.binary()).to_pylist()
                classes, c, train = (part.column(n).to_numpy() for n in ("class", "c", "train"))
                spelled, new = np.zeros(len(words)), np.flatnonzero(c == 0)
                spelled[new] = model.spelled([words[i] for i in new], classes[new])
                yield pa.RecordBatch.from_arrays([
                    pa.array(_word_hashes(words, rolling).view(np.int64)), *map(pa.array, (classes, c, model.base(c), model.rare(c, train, classes), spelled)),
                ], names=["hash", "class", "c", "word_base", "word_score", "spelled"])

    return run


_SUMS = "key long, hash long, class long, times long, n_tokens long, n_known long, base double, score double"


def _text_rows(model_of):
    """A row per text with what its common words and escapes give in turn, and a row for each of its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rolling = model_of(), Rolling(6)
        base = model.base(model.counts)
        for part, texts in byte_batches(batches, limit=TEXT_AT_ONCE):
            b, n = _Batch.of(texts, rolling), len(texts)
            keys = part.column("key").to_numpy()
            sequence = _Sequence.of(b)
            rank = model.rank(sequence.hashes)
            common, tail = rank >= 0, rank < 0
            owner = sequence.owner[common]
            sums = [np.bincount(owner, minlength=n), np.bincount(owner, base[rank[common]], n),
                    np.bincount(sequence.owner, model.in_turn(sequence, rank), n) - np.log10(CLASSES)]
            hashes, who = sequence.hashes[tail], sequence.owner[tail]
            _, first, times = np.unique(hashes + mixed(who.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
            none = np.zeros(len(first), np.int64)
            # a text's own row meets no word: its key stands where the hash would, in a class no text has
            columns = [
                np.concatenate((keys, keys[who[first]])), np.concatenate((keys, hashes[first].view(np.int64))),
                np.concatenate((np.full(n, -1), b.classes[who[first]])), np.concatenate((np.zeros(n, np.int64), times)),
                np.concatenate((sums[0], times)), np.concatenate((sums[0], none)),
                np.concatenate((sums[1], none.astype(float))), np.concatenate((sums[2], none.astype(float))),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _SUMS.split(", ")])

    return run


_EMPTY = Rolling(6).of(np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64))[0]


def scores(docs: DataFrame, held_out: str) -> DataFrame:
    """Model and unigram scores of every whole text of ``docs(doc_id, text)``.

    ``held_out`` is an SQL condition over ``docs``; all other rows are learned from. Returns ``doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score, unknown_spelled, bits_per_byte``: ``base_score`` is the log10 probability of the tokens by
    add-one unigrams and ``score`` by the mixed model, both with one symbol for all unknown words; ``unknown_spelled`` is what spelling
    these adds, and ``bits_per_byte`` has both parts. Null texts count as empty, which is one end.
    ``score`` depends on the order of the words. Rows equal in id and text get equal scores. With nothing to learn from, all counts are zero.
    """
    spark = docs.sparkSession
    held = docs.select("doc_id", "text", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), doc_key().alias("key"))
    counts = written(word_counts(held.select("text", (~F.col("held_out")).alias("train"))))
    model, rest = trained(counts, held.where("not held_out").select("text", "key"))
    # each kind of row gets its part of the model only, with tables made ready once
    by_word = spark.sparkContext.broadcast(model.plain("tokens", "distinct", "bucket", "escape", "places", "at_home", "mixer", "refinement", "found"))
    by_text = spark.sparkContext.broadcast(model.plain("tokens", "distinct", "hashes", "counts", "places_of", "stretched_past"))
    words = rest.mapInArrow(_word_scores(lambda: Model.of(by_word.value)), "hash long, class long, c long, word_base double, word_score double, spelled double")
    rows = held.select("key", "text").mapInArrow(_text_rows(lambda: Model.of(by_text.value)), _SUMS)
    joined = rows.join(words, ["hash", "class"], "left")

    def added(column: str):
        return F.coalesce(F.col("times") * F.col(column), F.lit(0.0))

    sums = joined.groupBy("key").agg(
        F.sum((F.col("class") < 0).cast("long")).alias("rows"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + added("word_base")).alias("base_score"), F.sum(F.col("score") + added("word_score")).alias("score"),
        F.sum(added("spelled")).alias("unknown_spelled"))
    sums = sums.select("key", *((F.col(c) / F.col("rows")).cast("long").alias(c) for c in ("n_tokens", "n_known")),
                       *((F.col(c) / F.col("rows")).alias(c) for c in ("base_score", "score", "unknown_spelled")))
    bits = -(F.col("score") + F.col("unknown_spelled")) * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))
    held = held.select("doc_id", "held_out", "key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    return held.join(sums, "key").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        "unknown_spelled", bits.alias("bits_per_byte"))
