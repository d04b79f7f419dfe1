"""Assignments against brute force."""

import random
from itertools import product

import numpy as np

from strandline.operators.assignment import assign, best_matching


def _best(pairs):
    def go(rs, used):
        return 0 if not rs else max([go(rs[1:], used)] + [w + go(rs[1:], used | {a}) for (a, b), w in pairs.items() if b == rs[0] and a not in used])

    return go(sorted({b for _, b in pairs}), frozenset())


def test_sparse_matching_is_optimal():
    rnd = random.Random(1)
    for _ in range(400):
        p = {(rnd.randrange(rnd.randint(1, 6)), rnd.randrange(rnd.randint(1, 6))): rnd.choice([rnd.randint(1, 900), rnd.randint(1, 3)]) for _ in range(rnd.randint(1, 14))}
        l, r, w = np.array([a for a, _ in p]), np.array([b for _, b in p]), np.array(list(p.values()))
        k = best_matching(l, r, w)
        assert len({l[i] for i in k}) == len({r[i] for i in k}) == len(k) and sum(w[k]) == _best(p)


def test_rounds_of_bids_are_optimal(spark):
    """The way taken for components too large for one task, forced on all; equal weights included, over which prices would creep."""
    rnd = random.Random(4)
    p = {(a, b): rnd.choice([0.9, 0.9, round(rnd.random(), 3) or 0.5]) for a, b in product(range(3), range(3))} | {(a, b): 0.9 for a in (10, 11) for b in (10, 11, 12)}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in p.items()] + [(None, 1, 1.0), (1, 1, None)], "l long, r long, w double")
    for in_task in (0, 1000):
        got = assign(df, 0.0, in_task).collect()
        assert len({r.l for r in got}) == len(got) == len({r.r for r in got})
        assert abs(sum(r.w for r in got) - _best({k: w for k, w in p.items()})) < 1e-9
    assert assign(df.limit(0), 0.0).count() == 0
