import duckdb
import numpy as np
import pandas as pd
from brute import frame, prose

from tablescout.llm.mixture import MARGINS, SHARE, margins, mixed, oracle, raked_probabilities

ROWS = [(i, prose(i, 5 + i % 90), ["en", "de", None][i % 3] if i % 7 else "en", ["a", "b", "c", None][min(3, i % 9)], i) for i in range(400)]
ROWS += [(7, prose(7, 30), "en", "a", 1), (7, prose(7, 30), "en", "a", 1), (None, "one two", "fr", "a", 2), (None, None, None, None, None), (900, None, "en", "a", 0), (901, "", "xx", "z", 0)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_same_rows_as_the_sql(spark):
    docs = frame(spark, ROWS, SCHEMA)
    names = {"mix_source": "source", "mix_lang": "lang", "mix_topic": "topic", "mix_tokens": "tokens"}
    got = mixed(docs).select("doc_id", *MARGINS, "mix_tokens", "mix_probability").collect()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(ROWS, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"}))
    want = con.sql(oracle()).fetchall()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((*r[:4], float(r[4]), r[5]) for r in want), key=repr)
    assert set(names.values()) <= {"source", "lang", "topic", "tokens"}


def test_margins_come_to_their_targets(spark):
    rng = np.random.default_rng(1)
    cells = [(f"s{i}", f"l{j}", f"t{k}", float(rng.integers(1, 1000) * (50 if i == 0 else 1))) for i in range(6) for j in range(3) for k in range(3)]
    share = 0.02
    got = raked_probabilities(frame(spark, cells, "mix_source string, mix_lang string, mix_topic string, w double"), 0.5, share, 12).collect()
    p = {tuple(r)[:3]: r.probability for r in got}
    w = {c[:3]: c[3] for c in cells}
    expected = {c: w[c] * p[c] for c in w}
    total = sum(w.values())
    assert abs(sum(expected.values()) / total - share) < 1e-4
    for m in range(3):
        sums, kept = {}, {}
        for c in w:
            sums[c[m]] = sums.get(c[m], 0) + w[c]
            kept[c[m]] = kept.get(c[m], 0) + expected[c]
        goal = {v: s**0.5 for v, s in sums.items()}
        for v in goal:
            assert abs(kept[v] / sum(kept.values()) - goal[v] / sum(goal.values())) < 2e-3


def test_rows_keep_their_columns(spark):
    docs = frame(spark, [(1, "a b", "en", "s", "w", 1.5), (2, None, None, None, None, None)], "doc_id long, text string, lang string, source string, w string, probability double")
    assert set(docs.columns) <= set(mixed(docs).columns)
    assert mixed(docs, share=1.0).select(docs.columns).count() == 2
    assert mixed(docs.limit(0)).collect() == []


def test_reached_margins_at_the_registered_share(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {(r.margin, r.value): r for r in margins(docs).collect()}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    # every text's expected tokens, from the rows' probabilities in SQL, whether taken or not
    everything = oracle().replace("WHERE u < probability", "")
    for m, key in (("source", "source"), ("lang", "lang"), ("topic", "topic")):
        rows = con.sql(f"SELECT {key}, sum(tokens), sum(tokens * probability) FROM ({everything}) GROUP BY 1 HAVING sum(tokens) > 0").fetchall()
        given, kept, powers = sum(r[1] for r in rows), sum(r[2] for r in rows), sum(r[1] ** 0.7 for r in rows)
        assert abs(kept / given - SHARE) < 1e-6
        for value, w, k in rows:
            r = got.pop((m, value))
            assert abs(r.given - w / given) + abs(r.target - w**0.7 / powers) + abs(r.reached - k / kept) < 1e-6
    assert not got
    held = {(r.margin, r.value): r for r in margins(docs, share=0.02).collect()}
    assert all(abs(r.reached - r.target) < 2e-3 for r in held.values())


def test_no_window_over_all_cells(spark):
    cells = frame(spark, [("a", "b", "c", 2.0), ("a", "d", "c", 1.0)], "mix_source string, mix_lang string, mix_topic string, w double")
    plan = raked_probabilities(cells)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_columns_called_like_added_ones(spark):
    rows = [(i, "word " * (i % 9), "en", f"s{i % 3}", -i) for i in range(60)]
    df = frame(spark, rows, "doc_id long, text string, lang string, source string, mix_tokens long")
    plain = mixed(df.drop("mix_tokens"))
    got = mixed(df)
    assert {r.doc_id: r.mix_tokens for r in got.collect()} == {r.doc_id: -r.doc_id for r in plain.collect()}
    assert sorted(got.columns) == sorted(plain.columns)
    assert mixed(df.limit(0)).collect() == []
