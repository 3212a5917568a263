"""Pruning of hyperedges against brute force."""

import random

import pandas as pd

from pointweave import registry
from pointweave.operators.sets import prune_hyperedges


def plain(edges):
    return {e: sorted(s) for e, s in edges.items() if not any(len(b) == len(s) + 1 and s < b for b in edges.values())}


def test_prune_against_brute_force(spark):
    r = random.Random(2)
    edges = {i: {r.randrange(9) for _ in range(r.randrange(1, 6))} for i in range(300)}
    df = spark.createDataFrame([(i, r.sample(sorted(s), len(s))) for i, s in edges.items()], "edge_id long, origins array<int>")
    assert {x["edge_id"]: sorted(x["origins"]) for x in prune_hyperedges(df).collect()} == plain(edges)


def test_every_order_counts(spark, tmp_path):
    orders = {1: [1, 2], 3: [1, 2, 3], 10: [2, 3], 11: [4, 5], 20: [4, 5, 6, 7]}
    rows = [(o, s) for o, own in orders.items() for s in own]
    pd.DataFrame(rows, columns=["l_orderkey", "l_suppkey"]).to_parquet(tmp_path / "lineitem.parquet")
    found = {r["edge_id"]: r["origins"] for r in registry.QUERIES["hyperedge_prune"](spark, str(tmp_path)).collect()}
    assert found == {k: str(v) for k, v in plain({o: set(s) for o, s in orders.items()}).items()} == {3: "[1, 2, 3]", 11: "[4, 5]", 20: "[4, 5, 6, 7]"}
