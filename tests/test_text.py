import pytest
from helpers import rows
from pyspark.sql import functions as F

from tablescout.functions import text as X
from tablescout.operators import audit as A


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x STRING").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("sql, words", [
    ("SELECT TOP 10 * FROM debt", []),
    ("delete from t", ["DELETE"]),
    ("update x; insert y; UPDATE z; drop a", ["DROP", "INSERT", "UPDATE"]),
    ("SELECT R_CREATE_USER_ID, UPDATED_AT FROM t", []),
    ("SELECT яUPDATE FROM t", []),
    ("SELECT 'merge' AS a", ["MERGE"]),
])
def test_write_words(spark, sql, words):
    assert one(spark, sql, X.write_words) == words


def test_every_write_word_is_found(spark):
    df = spark.createDataFrame([(w, w.lower() + " something") for w in X.WRITE_WORDS], "w STRING, sql STRING")
    assert all(r.w in r.mutations for r in A.find_mutations(df).collect())


def test_audit_readonly(spark):
    df = spark.createDataFrame(
        [("SELECT 1", True), ("SELECT 1", False), ("DROP TABLE t", True), (None, None), ("EXEC p", True)],
        "sql STRING, is_safe BOOLEAN",
    )
    assert [r.readonly for r in A.audit_readonly(df, is_safe="is_safe").collect()] == [True, False, False, True, True]


@pytest.mark.parametrize("sql, limit, capped, limited", [
    ("SELECT * FROM t", 100, "SELECT TOP 100 * FROM t", True),
    ("SELECT TOP 10 * FROM t", 100, "SELECT TOP 10 * FROM t", False),
    ("SELECT TOP 500 * FROM t", 100, "SELECT TOP 100 * FROM t", True),
    ("select * from t", 50, "select TOP 50 * from t", True),
    ("WITH c AS (SELECT 1 AS a) SELECT * FROM c", 100, "WITH c AS (SELECT 1 AS a) SELECT * FROM c", False),
    ("  SELECT DISTINCT a FROM t", 5, "  SELECT TOP 5 DISTINCT a FROM t", True),
    ("SELECT TOP 99999999999999999999 * FROM t", 100, "SELECT TOP 100 * FROM t", True),
    ("SELECT\u00a0* FROM t", 100, "SELECT\u00a0TOP 100 * FROM t", True),
    ("\u00a0SELECT TOP\u2003500 a FROM t", 100, "\u00a0SELECT TOP 100 a FROM t", True),
    (None, 100, None, False),
])
def test_row_cap(spark, sql, limit, capped, limited):
    df = spark.createDataFrame([(sql,)], "sql STRING")
    row = df.select(
        X.with_row_cap(F.col("sql"), limit).alias("capped"), X.needs_row_cap(F.col("sql"), limit).alias("limited")
    ).first()
    assert (row.capped, row.limited) == (capped, limited)


@pytest.mark.parametrize("text, seconds, strict, limited", [
    ("429 Too Many Requests, retry-after: 12", 12.0, 12.0, True),
    ("Rate limit reached, try again in 2.5s", 2.5, 2.5, True),
    ("timeout: 5 servers down", 5.0, None, False),
    ("wait 3 seconds", 3.0, 3.0, False),
    ("nothing to see", None, None, False),
    (None, None, None, False),
])
def test_error_triage(spark, text, seconds, strict, limited):
    r = A.error_triage(spark.createDataFrame([(text,)], "error_text STRING")).first()
    assert (r.retry_after_s, r.retry_after_strict_s, r.rate_limited) == (seconds, strict, limited)


def test_keywords(spark):
    found = one(spark, "Где хранится статус должника?", X.keywords)
    assert "статус" in found and "должника" in found and "где" not in found
    assert one(spark, "где найти", X.keywords) == ["где найти"]
    assert one(spark, "статус?", X.keywords) == ["статус"]
    assert one(spark, "", X.keywords) == [""]
    assert one(spark, "order status,\tnation", X.keywords) == ["order", "status", "nation"]


def test_escape_like(spark):
    assert one(spark, "a_b%c/d", X.escape_like) == "a/_b/%c//d"
    assert one(spark, "debt", X.escape_like) == "debt"


@pytest.mark.parametrize("text", [
    "", "  ", "short", "  x\x1f\n", "a" * 600, "a" * 601, "b" * 595 + "      tail", None, "\n" + "я" * 700,
])
def test_truncate(spark, text):
    def expected(t, limit=600):
        if not t:
            return t
        t = t.strip()
        return t if len(t) <= limit else t[:limit].rstrip() + " …"

    assert one(spark, text, X.truncate) == expected(text)


@pytest.mark.parametrize("kind, length, precision, scale, printed", [
    ("varchar", "255", None, None, "varchar(255)"), ("nvarchar", "MAX", None, None, "nvarchar(MAX)"),
    ("decimal", None, 18, 2, "decimal(18,2)"), ("int", None, 10, 0, "int"), ("decimal", None, None, None, "decimal"),
])
def test_format_type(spark, kind, length, precision, scale, printed):
    df = spark.createDataFrame([(kind, length, precision, scale)], "a STRING, b STRING, c INT, d INT")
    assert df.select(X.format_type(*map(F.col, "abcd"))).first()[0] == printed


def test_char_length(spark):
    df = spark.createDataFrame([("nvarchar", -1), ("nchar", 20), ("varbinary", 8), ("int", 4)], "a STRING, b INT")
    assert [r[0] for r in df.select(X.char_length_text(F.col("a"), F.col("b"))).collect()] == ["MAX", "10", "8", None]


def test_blank_concat_reads_null_as_empty(spark):
    df = spark.createDataFrame([("a", None, "c")], "f STRING, i STRING, o STRING")
    assert rows(df.select(X.blank_concat(*map(F.col, "fio"))))[0] == ("a  c",)
