import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import WORD, frame, prose

from tablescout.llm import lm
from tablescout.llm.mixing_model import Mixer, squashed

HELD = "crc32(cast(doc_id AS string)) % 7 = 2"


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


def base(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(t for i, x in rows if not held[i] for t in tokens(x))
    n, v = sum(c.values()), len(c)
    out = {}
    for i, x in rows:
        ts = tokens(x)
        out[i, x] = (held[i], len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts))
    return out


def compare(got, rows):
    want = base(rows)
    assert len(got) == len(rows)
    texts = {}
    for i, x in rows:
        texts.setdefault(i, []).append(x)
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4], rel=1e-12)
                   for w in (want[r.doc_id, x] for x in texts[r.doc_id]))


ROWS = [
    (1, None), (2, ""), (3, "One one ONE \x1cone é É"), (4, prose(1, 300)), (5, prose(1, 300)), (6, prose(2, 4000)), (6, prose(2, 4000)), (None, "lost words here"),
    (None, None), *((10 + i, prose(i % 7, 60) + " " + prose(50 + i, 5) + " ñandú" * (i % 3)) for i in range(40)),
]


def test_awkward_rows(spark):
    compare(lm.scores(frame(spark, ROWS), HELD).collect(), ROWS)


def test_with_few_common_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 7)
    compare(lm.scores(frame(spark, ROWS), HELD).collect(), ROWS)


def test_beats_unigrams_on_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    got = lm.scores(docs, HELD).collect()
    compare(got, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nothing_to_learn_from(spark):
    got = lm.scores(frame(spark, [(1, "a b"), (2, None)]), "true").collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score < 0 for r in got)
    assert lm.scores(frame(spark, []), HELD).collect() == []


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    counts = np.zeros((lm.CLASSES, 1 << lm.RANK_BITS))
    counts[:2, :50] = rng.integers(0, 90, (2, 50))
    assert (10 ** lm._rank_model(counts)).sum(1) == pytest.approx(np.ones(lm.CLASSES))


def test_mixer_learns_which_input_to_trust():
    rng = np.random.default_rng(2)
    mixer, gate = Mixer(2, 3), rng.integers(0, 2, 4000)
    p = rng.random(4000)
    x = np.stack([np.log(p / (1 - p)), rng.normal(size=4000), np.full(4000, 0.3)], 1)
    bit = (rng.random(4000) < p).astype(int)
    for low in range(0, 4000, 40):
        mixer.learn(x[low : low + 40], gate[low : low + 40], bit[low : low + 40], np.ones(40))
    assert np.abs(mixer.weights[:, 0] - 1).max() < 0.35 and np.abs(mixer.weights[:, 1]).max() < 0.3
    assert np.mean((squashed(mixer.mix(x, gate)) - p) ** 2) < 0.02


def test_preceding_words_decide(spark):
    rng = np.random.default_rng(3)
    words = [prose(900 + i, 1) + str(i) for i in range(60)]
    follows = {w: list(rng.choice(words, 2, replace=False)) for w in words}

    def chain(n):
        out = [words[rng.integers(60)]]
        while len(out) < n:
            out.append(follows[out[-1]][rng.integers(2)])
        return out

    rows = [(i, " ".join(chain(200))) for i in range(60)]
    held = [chain(200) for _ in range(4)]
    rows += [(1000 + i, " ".join(w)) for i, w in enumerate(held)] + [(2000 + i, " ".join(rng.permutation(w))) for i, w in enumerate(held)]
    got = {r.doc_id: r for r in lm.scores(frame(spark, rows), "doc_id >= 1000").collect()}
    for i in range(4):
        turned, mixed_up = got[1000 + i], got[2000 + i]
        assert turned.base_score == pytest.approx(mixed_up.base_score)
        assert turned.score > 0.5 * turned.base_score and turned.score > mixed_up.score + 100


def test_words_in_turn_add_up():
    rng = np.random.default_rng(4)
    past = rng.integers(0, 5, (lm.PAST, 1 << lm.PAST_BITS, 2)).astype(np.float32)
    counts = np.zeros((lm.CLASSES, 1 << lm.RANK_BITS))
    counts[0, :50] = rng.integers(0, 90, 50)
    nodes = lm._node_logits(lm._rank_model(counts))
    mixer = lm._past_mixer()
    mixer.weights += rng.normal(size=mixer.weights.shape) / 3
    n = lm.COMMON_RANKS + 1  # every rank, and the escape, after one and the same word
    turn = lm._Sequence(np.zeros(n, int), np.zeros(n, np.uint64), np.zeros(n, int), [np.full(n, k, np.uint64) for k in (5, 6, 7)])
    model = lm.Model(0, 0, *[np.zeros(0)] * 6, np.arange(n - 1), nodes, past, mixer, past, mixer, None)
    assert (10 ** model.in_turn(turn, np.append(np.arange(n - 1), -1))).sum() == pytest.approx(1, abs=1e-3)


def test_weights_are_learned_from_every_training_text(spark, monkeypatch):
    given, learn = [], lm._past_weights
    monkeypatch.setattr(lm, "_past_weights", lambda cells, *means: given.append(cells) or learn(cells, *means))
    rows = [(i, prose(i // 2, 40)) for i in range(60)]  # in copies, so that every last word was met elsewhere
    lm.scores(frame(spark, rows), "doc_id >= 50").collect()
    n_tokens = sum(len(tokens(x)) for i, x in rows if i < 50)
    assert given[0].reshape(lm.RANK_BITS, -1).sum(1)[: lm.ESCAPE_DEPTH].tolist() == [n_tokens] * lm.ESCAPE_DEPTH


def test_rank_model_learns_from_every_node(monkeypatch):
    rng = np.random.default_rng(5)
    counts = np.zeros((lm.CLASSES, 1 << lm.RANK_BITS))
    counts[1, :20000] = rng.integers(1, 9, 20000)
    monkeypatch.setattr(np.random, "default_rng", None)  # nothing is drawn
    assert (10 ** lm._rank_model(counts)[1]).sum() == pytest.approx(1)


def test_weights_make_the_counted_bits_likeliest():
    rng = np.random.default_rng(6)
    means = np.stack([np.linspace(-4, 4, lm.LEVELS)] * lm.PAST)
    base_means = np.stack([means[0]] * lm.RANK_BITS)
    want, cells = np.array([0.3, 0.8, -0.2, 0.5, 0.4]), np.zeros(lm.RANK_BITS * lm.CELLS)
    level = rng.integers(0, lm.LEVELS, (4, 200_000))
    x = np.stack([*means[0][level], np.full(level.shape[1], 0.3)], 1)
    bit = rng.random(len(x)) < squashed(x @ want)
    n = lm.LEVELS
    at = ((((level[3] * 4 + 2) * n + level[2]) * 4 + 1) * n + level[1]) * n + level[0]
    np.add.at(cells, 3 * lm.CELLS + 2 * at + bit, 1)
    weights = lm._past_weights(cells, base_means, means)
    assert weights[3 * 16 + 1 * 4 + 2] == pytest.approx(want, abs=0.05)
    assert (np.delete(weights, 3 * 16 + 6, 0) == lm._past_mixer().weights[0]).all()


def test_counts_travel_in_blocks(spark):
    totals = np.zeros(2 * lm.BLOCK + 9, np.int32)
    totals[[0, 5, lm.BLOCK - 1, 2 * lm.BLOCK + 8]] = 1, 2, 3, 2**31 - 1
    rows = [r for b in lm._sums(totals) for r in b.to_pylist()]
    assert [r["at"] for r in rows] == [0, 2]  # a row for a block, none for an empty one
    parts = spark.createDataFrame([(r["at"], r["counts"]) for r in rows * 3], lm._BLOCKS)
    assert (lm._added(parts, len(totals)) == 3 * totals.astype(float)).all()
    assert not lm._added(parts.limit(0), len(totals)).any()


def test_counts_sent_on_before_they_overflow(spark, monkeypatch):
    ranks_of = np.sort(lm._word_hashes([w.encode() for w in set(prose(1, 900).split())], lm.Rolling(6))), np.zeros(0, int)
    batch = pa.RecordBatch.from_pylist([{"text": prose(i % 9, 900)} for i in range(40)])

    def sums(run):
        found = Counter()
        for b in run(iter([batch] * 3)):
            for r in b.to_pylist():
                found.update({(r["at"], i): n for i, n in enumerate(np.frombuffer(r["counts"], "<i8").tolist()) if n})
        return found

    whole = sums(lm._past_counts(lambda: ranks_of))
    monkeypatch.setattr(lm, "_MANY_WORDS", 1)
    assert sums(lm._past_counts(lambda: ranks_of)) == whole and sum(whole.values()) > 3 * 36_000 * 3 * lm.ESCAPE_DEPTH


def test_rows_get_their_part_of_the_model():
    past = np.arange(lm.PAST * 8 << lm.PAST_BITS, dtype=np.float32)[: lm.PAST * 2 << lm.PAST_BITS].reshape(lm.PAST, -1, 2)
    nodes, places = np.zeros((lm.CLASSES, 1 << lm.RANK_BITS), np.float32), np.zeros(0, int)
    spelled = np.ones((lm.CONTEXTS, 1 << lm.SLOT_BITS, 2), np.float32)
    model = lm.Model(3, 2, *[np.zeros(0)] * 6, places, nodes, past, lm._past_mixer(), spelled, Mixer(lm.GATES, lm.CONTEXTS + 1), lm.Refinement(np.zeros(132), np.zeros(132)))
    texts = lm.Model.of(model.plain("tokens", "places_of", "stretched_past"))
    assert texts.past is None and texts.tables is None and texts.stretched_past is model.stretched_past
    words = lm.Model.of(model.plain("mixer", "refinement", "found"))
    assert words.nodes is None and words.tables is None and words.mixer.weights is model.mixer.weights
    assert words.spelled([b"ab", b""], np.zeros(2, int)) == pytest.approx(model.spelled([b"ab", b""], np.zeros(2, int)))
