"""Revenue by region and order year: the smoke query over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.tables import read_table

ORACLE_SQL = """
SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS order_year,
       count(*) AS line_count,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
GROUP BY 1, 2
"""


def revenue_by_region_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per region and order year.

    Only the columns used reach the scans. The dimension tables are joined by
    plain equi-joins: Spark broadcasts them while they are under its size
    threshold and sorts and merges beyond it. One shuffle serves the
    aggregation, after partial sums in each task.
    """
    table = lambda name, *columns: read_table(spark, sf_dir, name).select(*columns)
    places = table("nation", "n_nationkey", "n_regionkey").join(
        table("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = table("customer", "c_custkey", "c_nationkey").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table("orders", "o_orderkey", "o_custkey", "o_orderdate").join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    )
    lines = table("lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("r_name", F.year("o_orderdate").alias("order_year"))
        .agg(
            F.count("*").alias("line_count"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        )
    )
