import pytest
from helpers import rows
from pyspark.sql import functions as F

from tablescout.operators import questions as Q
from tablescout.operators.skew import hot_keys, salted_join


@pytest.fixture(scope="module")
def facts(spark):
    # key 1 holds more than a third of the rows, some keys have no partner, one is NULL
    data = [(i, 1 if i % 5 < 2 else i % 97) for i in range(3000)] + [(3000, None)]
    return spark.createDataFrame(data, "id INT, k INT")


@pytest.fixture(scope="module")
def dims(spark):
    return spark.createDataFrame([(i, f"n{i}") for i in range(0, 90)], "k INT, name STRING")


def test_hot_keys_are_few(facts):
    assert [tuple(r) for r in hot_keys(facts, ["k"], task_rows=300).collect()] == [(1, 5)]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("task_rows", [7, 300, 1_000_000])
def test_salted_join_equals_plain_join(facts, dims, how, task_rows):
    half = facts.withColumn("k", F.when(F.col("id") % 2 == 0, F.col("k")))  # half of the keys are NULL
    for left in (facts, half):
        want = left.join(dims, "k", how)
        got = salted_join(left, dims, ["k"], how, spread_by=["id"], task_rows=task_rows)
        assert rows(got, "id", "k", "name") == rows(want, "id", "k", "name")


def test_salted_join_with_repeated_right_keys(facts, dims):
    twice = dims.unionAll(dims)
    assert salted_join(facts, twice, ["k"], task_rows=100).count() == facts.join(twice, "k").count()


def test_null_keys_are_not_shuffled(facts, dims):
    plan = salted_join(facts, dims, ["k"], "left", spread_by=["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(k" in plan and "isnotnull(k" in plan


def test_decode_needs_the_dictionary(spark):
    debts = spark.createDataFrame([(1, "F"), (2, "O"), (3, "?")], "id INT, st STRING")
    codes = spark.createDataFrame([(6, "F", "finished"), (9, "F", "female"), (6, "O", "open")], "dict_code INT, code STRING, name STRING")
    assert rows(Q.decode(debts, "st", codes, 6), "id", "st_name") == [(1, "finished"), (2, "open"), (3, None)]


def test_years_count_boundaries(spark):
    df = spark.sql("SELECT DATE'2000-12-31' AS d UNION ALL SELECT DATE'2000-01-01'")
    assert rows(df.select(Q.age_years(F.col("d"), F.lit("2001-01-01").cast("date")))) == [(1,), (1,)]


def test_latest(spark):
    df = spark.createDataFrame([(1, 10, 5), (2, 10, 7), (3, 10, 7), (4, 11, 1)], "id INT, g INT, t INT")
    assert rows(Q.latest_per_key(df, "g", "t", "id")) == [(10, 7, 3), (11, 1, 4)]
    assert rows(Q.latest_n_per_key(df, "g", "t", "id", 2), "g", "id", "rank") == [(10, 2, 1), (10, 3, 2), (11, 4, 1)]
    assert [r.id for r in Q.latest_n(df, "t", "id", 2).collect()] == [2, 3]


def test_links(spark, facts):
    links = facts.where("k IS NOT NULL").select("id", F.lit("a").alias("obj"), F.col("k").cast("bigint").alias("r_id"))
    targets = Q.tagged_union({
        "a": (spark.range(90).withColumn("n", F.concat(F.lit("a"), "id")), "id", "n"),
        "b": (spark.range(5).withColumn("n", F.lit("b")), "id", "n"),
    })
    resolved = Q.resolve_links(links, targets)
    assert resolved.count() == 3000
    dangling = Q.dangling_links(links, targets)
    assert dangling.agg(F.sum("n_links")).first()[0] == resolved.where("target_name IS NULL").count() > 0


def test_group_limit_runs_before_the_shuffle(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = Q.latest_n_per_key(orders, "o_custkey", "o_orderdate", "o_orderkey", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def walked(links):
    """Plain walk up from every row."""
    out = {}
    for key in links:
        at, seen = key, []
        while at not in seen and links[at] is not None and links[at] in links:
            seen.append(at)
            at = links[at]
        if at in seen:
            out[key] = (None, None, "cycle" if at == key else "into_cycle")
        else:
            root = links[at] is None
            out[key] = (at, len(seen), ("root" if root else "orphan") if at == key else "linked" if root else "under_orphan")
    return out


def test_hierarchy_as_walked(spark):
    links = {0: None, 1: 0, 2: 1, 3: 2, 4: 3, 5: 99, 6: 5, 7: 6, 8: 8, 9: 8, 10: 11, 11: 12, 12: 10, 13: 12, 14: 13, 15: None}
    links |= {i: i - 1 if i > 100 else 4 for i in range(100, 170)}  # a long chain
    links |= {i: 3 for i in range(200, 500)}  # one parent of many
    df = spark.createDataFrame([*links.items(), (None, 0), (15, None)], "k INT, p INT")
    assert {r.id: (r.root, r.depth, r.status) for r in Q.hierarchy(df, "k", "p").collect()} == walked(links)
    assert Q.hierarchy(df.limit(0), "k", "p").count() == 0
    pair = spark.createDataFrame([(1, 2), (2, 1)], "k INT, p INT")
    assert [r.status for r in Q.hierarchy(pair, "k", "p").collect()] == ["cycle", "cycle"]
