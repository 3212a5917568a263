"""Collision counting begins where it is near its end."""

import numpy as np

from pointweave.llm import nearest


def test_windows_of_a_query_begin_where_those_before_ended(monkeypatch):
    r = np.random.default_rng(5)
    x, q = r.normal(size=(900, 12)), r.normal(size=(60, 12))
    index = nearest.LineIndex(x, 40)
    counted, count = [0], np.bincount

    def bincount(*a, **b):
        counted[0] += 1
        return count(*a, **b)

    monkeypatch.setattr(nearest.np, "bincount", bincount)
    hits = list(index.candidates(q, 40, 0.8, 0.4, 1.03))
    assert counted[0] < 15 * len(q)  # from the first window on it was more than 40 a query
    # A lone query, which begins at the first window, and others before it give the same.
    assert [h.tolist() for h in hits] == [next(index.candidates(one[None], 40, 0.8, 0.4, 1.03)).tolist() for one in q]
    assert counted[0] > 40 * len(q)
