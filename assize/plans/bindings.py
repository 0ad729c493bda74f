"""The star schema in the roles of decision records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with SQL where SQL can say the same."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.sql[query.__name__] = sql
            return query

        return keep


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as decisions: event_id, case_id, d, y, cls, theme, member, outcome, fav (1, 0 or null), price."""
    orders = read_table(spark, folder, "orders")
    customers = read_table(spark, folder, "customer").join(F.broadcast(read_table(spark, folder, "nation")), F.expr("c_nationkey = n_nationkey"))
    status = F.col("o_orderstatus")
    return orders.join(customers, F.expr("o_custkey = c_custkey")).select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("case_id"), F.to_date("o_orderdate").alias("d"), F.year("o_orderdate").alias("y"),
        F.col("o_orderpriority").alias("cls"), F.col("c_mktsegment").alias("theme"), F.col("n_name").alias("member"),
        F.when(status == "F", "favorable").when(status == "O", "unfavorable").otherwise("neutral").alias("outcome"),
        F.when(status == "F", 1).when(status == "O", 0).alias("fav"), F.col("o_totalprice").alias("price"),
    )


DECISIONS = """dec AS (
  SELECT o_orderkey AS event_id, o_custkey AS case_id, CAST(o_orderdate AS DATE) AS d, year(o_orderdate)::INT AS y, o_orderpriority AS cls,
         c_mktsegment AS theme, n_name AS member, CASE o_orderstatus WHEN 'F' THEN 'favorable' WHEN 'O' THEN 'unfavorable' ELSE 'neutral' END AS outcome,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS fav, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def velocities(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with the days from order to shipment where these are not negative: cls, y, line_id, days."""
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    days = F.datediff("l_shipdate", "o_orderdate")
    rows = lines.join(orders, F.expr("l_orderkey = o_orderkey")).withColumn("days", days).where("days >= 0")
    return rows.select(F.col("o_orderpriority").alias("cls"), F.year("o_orderdate").alias("y"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"), F.col("days").cast("double").alias("days"))


VELOCITIES = """vel AS (
  SELECT o_orderpriority AS cls, year(o_orderdate)::INT AS y, l_orderkey || '-' || l_linenumber AS line_id,
         CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) >= 0)"""


def supply_links(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct supplier and part pairs as links of members and hubs."""
    return read_table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("member"), F.col("l_partkey").alias("hub")).distinct()
