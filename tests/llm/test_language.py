import zlib

import numpy as np
import pytest
from brute import frame

from tablescout.llm.language import SLOT_BITS, Follower, identified, quotas, slots_of

HELD = "crc32(cast(doc_id AS string)) % 3 = 1"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_languages(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = identified(docs, HELD).collect()
    assert len(got) == len(lang) and all(r.held_out == held(r.doc_id) for r in got)
    rest = [r for r in got if r.held_out]
    right = np.array([r.lang_pred == lang[r.doc_id] for r in rest])
    assert right.mean() > 0.97
    assert abs(np.mean([r.score for r in rest]) - right.mean()) < 0.03
    blind = docs.selectExpr("doc_id", "text", f"if({HELD}, 'xx', lang) AS lang", "'s' AS source")
    assert sorted((tuple(r) for r in identified(blind, HELD).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_awkward_rows(spark):
    rows = [(i, "the and of with that this " * (1 + i % 5), "en", "x") for i in range(40)] + [(50 + i, "der die das und nicht ist ü " * (1 + i % 5), "de", "x") for i in range(40)]
    rows += [(200, None, "en", "a"), (201, "", "en", "a"), (202, "123 ?!", "de", "a"), (203, "THE", None, None), (None, "ist das nicht", None, "b"), (204, "x" * 50000, "en", "b"), (3, "the and", "en", "x")]
    docs = frame(spark, rows, "doc_id long, text string, lang string, score string")
    got = identified(docs, HELD).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and all(by[i].score == 0 for i in (200, 201, 202))
    assert by[203].lang_pred == "en" and by[None].lang_pred == "de" and not by[None].held_out
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in got)


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in identified(docs, HELD).collect()} == {("und", 0.0)}
    assert identified(docs.limit(0), HELD).collect() == []


def test_grams_do_not_cross_texts():
    slots, owners = slots_of(["ab", "", "É"])
    assert np.bincount(owners).tolist() == [4 + 3 + 2, 2 + 1, 3 + 2 + 1]
    assert (slots < 1 << SLOT_BITS).all()
    alone = np.concatenate([slots_of([t])[0] for t in ("ab", "", "É")])
    assert sorted(slots) == sorted(alone)


def test_follower_finds_sparse_weights():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 6))
    y = (x[:, 0] * 2 - x[:, 1] > 0).astype(float)
    model = Follower(6, 1, l1=0.6)
    for low in range(0, 4000, 20):
        part = x[low : low + 20]
        p = 1 / (1 + np.exp(-part @ model.weights(slice(None))[:, 0]))
        model.step(np.arange(6), (part.T @ (p - y[low : low + 20]))[:, None])
    w = model.weights(slice(None))[:, 0]
    assert w[0] > 0.5 and w[1] < -0.2 and w[0] == pytest.approx(-2 * w[1], rel=0.4)
    assert np.abs(w[2:]).max() < 0.2 * abs(w[1])


def test_rare_language_is_learned(spark):
    few = "ez da hau etxe bat baina gizon handia dago han eta hemen"
    rows = [(i, f"the house of that man is big and this one stands here {i % 97}", "en") for i in range(3000)]
    rows += [(5000 + i, f"{few} {i}", "eu") for i in range(12)] + [(6000 + i, few[i:], None) for i in range(0, 30, 3)]
    got = identified(frame(spark, rows, "doc_id long, text string, lang string"), "doc_id >= 6000", rows=40).collect()
    assert {r.lang_pred for r in got if r.doc_id >= 6000} == {"eu"}
    assert {r.lang_pred for r in got if r.doc_id < 3000} == {"en"}


def test_quotas():
    assert quotas({"a": 5, "b": 1000, "c": 1000}, 101) == {"a": 5, "b": 48, "c": 48}
    assert quotas({"a": 10, "b": 10}, 1) == {"a": 1, "b": 1} and quotas({}, 9) == {}
