"""Cycles of a permutation, by pointer doubling: how rings are put together from links without walking them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut_lineage


def cycles(links: DataFrame, node: str = "node", to: str = "next") -> DataFrame:
    """(node, cycle, place) of links that lead from each node to one other, and to each node from one.

    cycle is its least node, place the number of links from there. After round k each node knows the least of the 2^k
    nodes from it on, how far that is, and the node 2^k further on; both halves of the next round's stretch are rows of
    this table, so a round is one join of unique keys, and a cycle of n nodes takes log2(n) + 1 of them. It ends when no
    node learns of a lesser one: those that start up to 2^k before a cycle's least node know it, and one of them is in
    reach of each node by steps of 2^k. Each round is a checkpoint.
    """
    at = cut_lineage(links.select(F.col(node).alias("node"), F.col(to).alias("to"), F.col(node).alias("cycle"), F.lit(0).cast("long").alias("steps")))
    width = 1
    while True:
        ahead = at.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("cycle").alias("other"), F.col("steps").alias("more"))
        less = F.col("other") < F.col("cycle")
        after = at.join(ahead, "to").select("node", F.col("further").alias("to"), F.least("cycle", "other").alias("cycle"), F.when(less, F.col("more") + width).otherwise(F.col("steps")).alias("steps"), less.alias("news"))
        at = cut_lineage(after)
        width *= 2
        if at.where("news").isEmpty():
            break
    size = at.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"))
    return at.join(size, "cycle").select("node", "cycle", ((F.col("n") - F.col("steps")) % F.col("n")).alias("place"))


def ordered(rows: DataFrame, keys: list[str], place: str, value: F.Column) -> DataFrame:
    """(keys, ring): the values of each key as an array, by place."""
    one = rows.select(*keys, F.struct(F.col(place).alias("k"), value.alias("v")).alias("s"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("ring"))
