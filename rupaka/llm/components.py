"""Connected components of a link table, by rounds of small joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rupaka.llm.common import Scratch, written


def components(links: DataFrame, table_of=written) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of ``links`` (a, b), as a table written by ``table_of``.

    Alternates two steps until nothing changes: every node links its larger
    neighbours to its smallest one, then its smaller neighbours and itself to the
    smallest. Each round is a table in the shared folder; nothing reaches the driver
    but the number of links that still aren't direct. A node's smallest neighbour is a
    written table as well, so that its join is one of two plain shuffles, which Spark
    splits where a node has very many links.
    """
    tall = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    with Scratch(links.sparkSession) as kept:
        e = kept(tall(links))
        while True:
            both = e.union(e.select("b", "a"))
            least = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
            large = kept(both.join(least, both.a == least.u).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
            least = kept(large.groupBy("a").agg(F.min("b").alias("m")))
            small = large.join(least.withColumnRenamed("a", "u"), large.a == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            e = kept(tall(small.union(least.select("a", F.col("m").alias("b")))))
            # done when every node has one link and no end of a link has one of its own
            ends = e.select(F.col("a").alias("x"), F.lit(1).alias("n")).union(e.select("b").distinct().select(F.col("b").alias("x"), F.lit(1).alias("n")))
            if ends.groupBy("x").agg(F.sum("n").alias("n")).filter("n > 1").isEmpty():
                break
        roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        return table_of(e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots))
