"""A source with one very long document meets its target."""

import numpy as np
import pytest

from pointweave.llm import mixing


@pytest.mark.parametrize("seed", [1, 2])
def test_a_very_long_document(spark, seed):
    r = np.random.default_rng(seed)
    sizes = [*r.integers(50, 151, 6000).tolist(), 300_000]
    docs = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)], "doc_id long, text string, source string").repartition(8)
    rows = mixing.mix(docs, weights=(1.0,), share=1.5, seed=seed).collect()
    assert len(rows) == len(sizes) and {x["copies"] for x in rows} == {1, 2}
    assert abs(sum(x["taken"] for x in rows) - rows[0]["target"]) <= 50
    long = [x["copies"] for x in rows if x["size"] == 300_000]
    assert len(long) == 1


def test_few_short_documents(spark):
    """Many one-word documents beside some of 1000 words: the rest below a long one is made up by short ones."""
    sizes = [1] * 3000 + [1000] * 30 + [40_000]
    docs = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, weights=(1.0,), share=1.5).collect()
    reachable = sum(n for n in sizes if n < 40_000) / 2
    assert abs(sum(x["taken"] for x in rows) - rows[0]["target"]) <= max(2, 20_000 - reachable + 1000)
