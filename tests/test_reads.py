import pytest
from helpers import rows

from tablescout.operators.reads import bounded_read, scalar_read


@pytest.fixture(scope="module", autouse=True)
def numbers(spark):
    spark.range(250).createOrReplaceTempView("numbers")
    yield
    spark.catalog.dropTempView("numbers")


@pytest.mark.parametrize("sql, status, count, truncated, more", [
    ("SELECT id FROM numbers ORDER BY id", "success", 100, True, True),
    ("SELECT id FROM numbers WHERE id < 100", "success", 100, True, False),
    ("SELECT id FROM numbers WHERE id < 0", "empty", 0, False, False),
    ("WITH n AS (SELECT id FROM numbers) SELECT id FROM n", "success", 100, False, True),
    ("SELECT id, id FROM numbers -- comment", "success", 100, True, True),
    ("SELECT 'delete' AS word", "success", 1, False, False),
])
def test_status(spark, sql, status, count, truncated, more):
    result = bounded_read(spark, sql)
    r = result.status.first()
    assert (r.status, r.row_count, r.truncated, r.more_rows) == (status, count, truncated, more)
    assert result.rows.count() == count


@pytest.mark.parametrize("sql", [
    "DROP VIEW numbers", "CREATE TABLE x (a INT)", "INSERT INTO numbers VALUES (1)", "SET a=b", "SELECT 1; DROP VIEW numbers",
    "SELECT 1) AS b; DROP VIEW numbers --", "FROM numbers INSERT INTO t SELECT *", "WITH c AS (SELECT 1) INSERT INTO t SELECT * FROM c",
    "SELECT nothing FROM numbers", "SELECT * FROM no_such_table", "/* open",
    "SELECT java_method('java.lang.System', 'setProperty', 'tablescout', 'x')", "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
    "SELECT id FROM numbers WHERE id = (SELECT length(REFLECT('java.lang.System', 'setProperty', 'tablescout', 'x')))",
    "WITH a AS (SELECT `try_reflect`('java.lang.System', 'setProperty', 'tablescout', 'x') AS v) SELECT * FROM a",
    "SELECT * FROM numbers JOIN json.`/tmp` ON true", "SELECT TRANSFORM(id) USING 'cat' AS (x STRING) FROM numbers",
    "SELECT * FROM IDENTIFIER('parquet.`/tmp`')",
])
def test_refused(spark, sql):
    result = bounded_read(spark, sql)
    r = result.status.first()
    assert result.rows is None and r.status == "error" and r.error
    assert spark.catalog.tableExists("numbers")
    assert spark._jvm.java.lang.System.getProperty("tablescout") is None


def test_cap_holds_whatever_the_text_says(spark):
    assert bounded_read(spark, "SELECT id FROM numbers LIMIT 200", max_rows=7).rows.count() == 7
    assert bounded_read(spark, "SELECT id FROM numbers) AS a CROSS JOIN (SELECT 1", max_rows=7).rows.count() == 7


def test_order_is_kept(spark):
    assert [r.id for r in bounded_read(spark, "SELECT id FROM numbers ORDER BY id DESC", max_rows=2).rows.collect()] == [249, 248]


def test_parameters(spark):
    assert rows(bounded_read(spark, "SELECT id FROM numbers WHERE id BETWEEN ? AND ?", args=[3, 4]).rows) == [(3,), (4,)]


def test_scalar(spark):
    assert scalar_read(spark, "SELECT max(id), min(id) FROM numbers").first().value == 249
    assert rows(scalar_read(spark, "SELECT id, id FROM numbers WHERE id < 0")) == [(None,)]
