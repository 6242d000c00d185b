"""Each stage of the pipeline on what the stage before kept, against plain versions."""

import duckdb
import pytest
import test_packing as packing_test
import test_quality as quality_test
import test_simhash
from test_suffixes import without_passages

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tablescout.llm import mixture
from tablescout.llm.quality import quality_report


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    place = tmp_path_factory.mktemp("stages")
    rows = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows[-1], sf_dir).write.parquet(f"{place}/{k}")
        rows.append(spark.read.parquet(f"{place}/{k}"))
    return rows


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_quality_rules(spark, sf_dir, stages):
    report = quality_report(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    given = texts(stages[0])
    assert texts(stages[1]) == {r.doc_id: given[r.doc_id] for r in report if r.kept}
    assert not any(quality_test.failed(quality_test.counts(t)) for t in texts(stages[1]).values())


def test_near_duplicates(stages):
    given = texts(stages[1])
    want = [i for i, _, component in test_simhash.expected(list(given.items())) if i == component]
    assert texts(stages[2]) == {i: given[i] for i in want}


def test_repeated_passages(stages):
    given = texts(stages[2])
    want = without_passages(given)
    assert texts(stages[3]) == want
    assert want != given
    assert {r.doc_id: r.n_chars for r in stages[3].collect()} == {i: len(t) for i, t in want.items()}


def test_source_mixing(stages):
    con = duckdb.connect()
    con.register("documents", stages[3].toPandas())
    want = {r[0] for r in con.sql(mixture.oracle(share=corpus_pipeline.MIX_SHARE)).fetchall()}
    given = texts(stages[3])
    assert texts(stages[4]) == {i: given[i] for i in want}


def test_packing(spark, stages):
    packing_test.check_packing(spark, stages[4], list(texts(stages[4]).items()), 0.9)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[5].collect()))


def test_registered_queries():
    names = [n for n in queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()) == sorted(f"op{k}" for k in range(1, 14))
    assert "pipeline" in names and "pipeline" not in oracle_sql()
