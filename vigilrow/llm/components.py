"""Connected components of a link table, as joins and group-bys.

Large-star and small-star steps alternate until every node points at the
smallest id of its component.  Each step's links are written to the checkpoint
folder, so a lost executor repeats one step only.  No node's links are gathered
in one task: minima are partial aggregates, and the joins that hand them out
can be split where a node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import Scratch
from vigilrow.session import materialize


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0))).first()
    return int(row[0]), int(row[1])


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to one row (node, component) for each node with a link to another node.

    Directions, repeats and self-links do not matter; rows with a null end are no links.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    scratch = Scratch(links.sparkSession)
    links = scratch.keep(links, "links")
    before = _state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: neighbours above a node get the smallest id around it.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.keep(large, "large-star")
        # Small star: what lies below a node is tied to the smallest of it.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        scratch.drop("links")
        links = scratch.keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        scratch.drop("large-star")
        after = _state(links)
        if after == before:
            break
        before = after
    node = links.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    found = materialize(node.unionByName(node.select(F.col("component").alias("node"), "component").distinct()), "components")
    scratch.drop()
    return found
