"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Rows that a task writes at least, where tables are small: each file costs an executor more than its rows do.
ROWS_A_TASK = 100_000


def in_few_files(table: DataFrame, rows: int) -> DataFrame:
    """As ``written``, of a table with about so many rows."""
    return written(table.coalesce(max(1, -(-rows // ROWS_A_TASK))))


def _distinct(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) -> (node, root): the smallest node that each linked node reaches.

    Nodes without links to others do not come back. Every step is an aggregation that finds each
    node's smallest neighbour and a join that moves links to it; link tables are written between
    steps, so that a lost executor costs one step at most, and the smallest neighbours are written
    before their join, so that adaptive execution can split a hub's links.
    """
    spark = links.sparkSession
    now = written(_distinct(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    rows, state = now.count(), None
    while True:
        # Large star: every larger neighbour of a node moves to the node's smallest neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = in_few_files(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), rows)
        large = in_few_files(_distinct(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))), rows)
        # Small star: a node and its smaller neighbours move to the smallest of these.
        least = in_few_files(large.groupBy("a").agg(F.min("b").alias("m")), rows)
        moved = large.join(least, "a")
        now = in_few_files(_distinct(moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))), rows)
        new = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new
