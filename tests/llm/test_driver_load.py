"""How many broadcast tables and queries the loops of the pipeline's stages leave to the driver: it keeps a table, threads
and a plan for each, whatever the input's size.
"""

import pytest
from pyspark.sql import functions as F

from pointweave.llm import mixing, near_duplicates


def _plans(spark, run) -> list[str]:
    """The final plans of all queries that run() makes."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before = {x.executionId() for x in _all(store)}
    run()
    bus.waitUntilEmpty()
    return [x.physicalPlanDescription().split("== Initial Plan ==")[0] for x in _all(store) if x.executionId() not in before]


def _all(store) -> list:
    found = store.executionsList()
    return [found.apply(i) for i in range(found.size())]


def _nodes(plan: str, name: str) -> int:
    return plan.split("\n\n")[0].count(f"{name} (")


def test_mixture_broadcasts_each_sources_table_once_a_step(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    plans = _plans(spark, lambda: mixing.mixed_documents(docs).collect())
    assert len(plans) > 10  # the store keeps them
    # Three for each of the rounds, and some around them; 22 when each round joined all those before it.
    assert 3 * mixing.SETTLING <= sum(_nodes(p, "BroadcastExchange") for p in plans) <= 14, [_nodes(p, "BroadcastExchange") for p in plans]


@pytest.mark.parametrize("edges", [[(7, 1), (8, 1), (9, 2)], []])
def test_components_of_stars_take_one_round_without_broadcast(spark, edges):
    found = []
    plans = _plans(spark, lambda: found.extend(near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert sorted(tuple(r) for r in found) == sorted(edges)
    assert sum(_nodes(p, "BroadcastExchange") for p in plans) == 0
    assert sum("InsertIntoHadoopFsRelationCommand (" in p for p in plans) == 1
