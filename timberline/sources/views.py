"""Log lines rendered from relational tables; each has SQL of its own that gives the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order keys of item lines that share a block.
ITEM_BLOCK = 1_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, line): `date time LEVEL user=.. k=.. cents=.. id=..`."""
    e = _table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" "), F.upper("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" k="),
        F.get_json_object("props", "$.k"), F.lit(" cents="), cents.cast("string"), F.lit(" id="), F.col("event_id").cast("string"),
    )
    return e.select(F.col("event_id").alias("line_no"), line.alias("line"))


EVENT_LOG = """
SELECT event_id AS line_no,
       strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' ' || upper(event_type) || ' user=' || user_id || ' k=' || json_extract_string(props, '$.k')
       || ' cents=' || CAST(round(value * 100) AS BIGINT) || ' id=' || event_id AS line
FROM events
"""


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, line): `date priority order=.. cust=.. status=..`; priorities hold spaces and digits."""
    o = _table(spark, sf_dir, "orders")
    line = F.concat(
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), F.col("o_orderpriority"), F.lit(" order="), F.col("o_orderkey").cast("string"),
        F.lit(" cust="), F.col("o_custkey").cast("string"), F.lit(" status="), F.col("o_orderstatus"),
    )
    return o.select(F.col("o_orderkey").alias("line_no"), line.alias("line"))


ORDER_LOG = """
SELECT o_orderkey AS line_no,
       strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority || ' order=' || o_orderkey || ' cust=' || o_custkey || ' status=' || o_orderstatus AS line
FROM orders
"""


def item_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns in record order: block_id and the order columns o1..o6, then part, supp, qty, price."""
    i = _table(spark, sf_dir, "lineitem")
    qty, price = F.round("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long")
    return i.select(
        F.floor(F.col("l_orderkey") / ITEM_BLOCK).cast("long").alias("block_id"), F.col("l_orderkey").alias("o1"), F.col("l_linenumber").cast("long").alias("o2"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), qty.alias("qty"), price.alias("price"),
    )


ITEM_ORDER = ("o1", "o2", "part", "supp", "qty", "price")
ITEM_VALUES = f"""
SELECT CAST(floor(l_orderkey / {ITEM_BLOCK}) AS BIGINT) AS block_id, l_orderkey AS o1, CAST(l_linenumber AS BIGINT) AS o2, l_partkey AS part, l_suppkey AS supp,
       CAST(round(l_quantity) AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS price
FROM lineitem
"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line): the lines of documents."""
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


DOC_LINES = """
SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, LATERAL (SELECT unnest(range(1, len(d.parts) + 1)) AS i) u
"""
