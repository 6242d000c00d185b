"""What people know about the given tables: descriptions, synonyms, relationships, codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.session import small_frame
from tablescout.sources.tables import KNOWLEDGE_SCHEMA

SERVER, DATABASE = "local", "main"

DESCRIPTIONS = {
    "region": "Parts of the world", "nation": "Countries", "customer": "Buyers and their balances",
    "supplier": "Sellers of parts", "part": "Goods on offer", "orders": "Purchase orders with status and total",
    "lineitem": "Positions of an order", "events": "User actions over time", "documents": "Long texts with language",
    "embeddings": "Text vectors", "pages": "Raw web pages", "labels": "Quality marks of documents",
    "conversations": None, "benchmark": None,
}

COLUMN_NOTES = {
    "c_acctbal": "balance of the account", "o_orderstatus": "status code F, O or P", "o_totalprice": "price of the whole order",
    "l_discount": "discount as a fraction", "s_acctbal": "balance of the account", "event_type": "kind of action",
    "quality": "1 for good text", "lang": "language code",
}

# (table, business description, synonyms, relationships, {enum field: description})
KNOWLEDGE = [
    ("customer", "People and firms that buy.", ["клиент", "должник", "buyer"],
     ["customer.c_nationkey -> nation.n_nationkey", "customer.c_custkey <- orders.o_custkey"],
     {"c_mktsegment": "line of business"}),
    ("orders", "What was bought, when and for how much.", ["заказ", "долг", "purchase"],
     ["orders.o_custkey -> customer.c_custkey"],
     {"o_orderpriority": "urgency", "o_orderstatus": "state of the order, see the code dictionary"}),
    ("lineitem", "One good in one order.", ["позиция"],
     ["lineitem.l_orderkey -> orders.o_orderkey", "lineitem.l_partkey -> part.p_partkey",
      "lineitem.l_suppkey -> supplier.s_suppkey"], {"l_returnflag": "returned or not"}),
    ("supplier", "Firms that sell.", ["поставщик", "seller"], ["supplier.s_nationkey -> nation.n_nationkey"], {}),
    ("part", "", ["товар"], [], {"p_type": "kind of good"}),
    ("nation", "Country of a customer or supplier.", [], ["nation.n_regionkey -> region.r_regionkey"], {}),
    ("region", None, ["регион"], [], {}),
]

RELATIONSHIPS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("events", "user_id", "customer", "c_custkey"),
    ("events", "user_id", "supplier", "s_suppkey"),
]

# Column order and printed types of the given tables, for the SQL side.
TABLE_COLUMNS = {
    "region": "r_regionkey int, r_name varchar",
    "nation": "n_nationkey int, n_name varchar, n_regionkey int",
    "customer": "c_custkey bigint, c_name varchar, c_nationkey int, c_acctbal double, c_mktsegment varchar",
    "supplier": "s_suppkey bigint, s_name varchar, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name varchar, p_brand varchar, p_type varchar, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus varchar, o_totalprice double, o_orderdate timestamp, o_orderpriority varchar",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag varchar, l_linestatus varchar, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar",
    "documents": "doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url varchar, html varchar",
    "benchmark": "item_id bigint, text varchar",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role varchar, text varchar",
}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ", 1)) for c in TABLE_COLUMNS[table].split(", ")]


def knowledge(spark: SparkSession) -> DataFrame:
    rows = [
        (t, biz, syn, rel, [(k, {"description": v, "how_to_decode": None}) for k, v in enums.items()], None)
        for t, biz, syn, rel, enums in KNOWLEDGE
    ]
    return small_frame(spark, rows, KNOWLEDGE_SCHEMA)


def descriptions(spark: SparkSession) -> DataFrame:
    return small_frame(spark, list(DESCRIPTIONS.items()), "table_name STRING, table_description STRING")


def sql_text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def sql_values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(sql_text(v) if not isinstance(v, int) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


def catalog_sql(observed: bool = True) -> str:
    """The catalog as SQL; ``observed`` adds nullability and text lengths seen in the data."""
    parts = []
    for t in TABLE_COLUMNS:
        for i, (c, kind) in enumerate(columns_of(t), 1):
            fixed = f"'{t}' AS table_name, {i} AS column_id, '{c}' AS column_name, '{kind}' AS data_type, {sql_text(COLUMN_NOTES.get(c))} AS description"
            if observed:
                length = f"CAST(max(length({c})) AS VARCHAR)" if kind == "varchar" else "NULL"
                parts.append(f"SELECT {fixed}, count(*) > count({c}) AS is_nullable, {length} AS char_max_length FROM {t}")
            else:
                parts.append(f"SELECT {fixed}")
    return "catalog AS (" + " UNION ALL ".join(parts) + ")"


def descriptions_sql() -> str:
    return "descriptions AS " + sql_values(DESCRIPTIONS.items(), "table_name, table_description")
