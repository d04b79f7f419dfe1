"""Groups of linked records against plain union-find."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandline.llm.pages import page_key
from strandline.llm.components import components, union_find
from strandline.llm.linking import link_records


def _groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def _edges(seed):
    rnd = random.Random(seed)
    chain = [(i, i + 1) for i in range(5000, 5400)]
    hub = [(7000, i) for i in range(7001, 7600)]
    some = [(rnd.randrange(2000), rnd.randrange(2000)) for _ in range(900)]
    e = chain + hub + some + [(b, a) for a, b in some[:50]] + some[:50]
    rnd.shuffle(e)
    return e


def test_components(spark):
    e = _edges(1)
    want = _groups([(a, b) for a, b in e if a != b])
    df = spark.createDataFrame([*e, (None, 3), (9, None), (11, 11)], "src long, dst long")
    for kw in ({}, {"least_grid": 3, "per_cell": 60}, {"least_grid": 1}):
        got = {r.id: r.root for r in components(df, **kw).collect()}
        assert got == want
    assert components(df.limit(0)).count() == 0
    ids, root = union_find(np.array([a for a, b in e]), np.array([b for a, b in e]))
    assert {int(i): int(r) for i, r in zip(ids, root, strict=True) if int(i) in want} == want


def test_link_records(spark):
    r = [(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, None), (6, None), (7, "d"), (8, "hot"), *((100 + i, "hot") for i in range(200)), (9, "lonely")]
    m = [(1, "b", "x"), (2, "x", "a"), (3, "d", "d"), (4, None, "c"), (5, "c", None), (6, "q", "z"), (7, "x", "b"), (8, "lonely", "nobody")]
    got = {x.id: (x.group_id, x.n_members) for x in link_records(spark.createDataFrame(r, "id long, key string"), spark.createDataFrame(m, "pair long, a string, b string")).collect()}
    assert got[1] == got[2] == got[3] == (1, 3) and got[4] == (4, 1) and got[5] == (5, 1) and got[6] == (6, 1) and got[7] == (7, 1) and got[9] == (9, 1)
    assert got[8] == got[150] == (8, 201) and len(got) == len(r)
    none = spark.createDataFrame([], "pair long, a string, b string")
    assert link_records(spark.createDataFrame(r[:3], "id long, key string"), none).where("group_id = 1").count() == 2


def test_page_key(spark):
    same = ["https://a.test/x-y?id=1&b=2", "http://www.A.test:80/x%2Dy?b=2&id=1&utm_source=f#top", " https://a.test:443/x-y/?gclid=9&id=1&b=2 "]
    other = ["https://a.test/x-y?id=2&b=2", "https://b.test/x-y?id=1&b=2", "https://a.test/x-y"]
    k = lambda u: [r[0] for r in spark.createDataFrame([(x,) for x in u], "u string").select(page_key(F.col("u"))).collect()]
    assert len(set(k(same))) == 1 and len(set(k(other) + k(same))) == 4
    assert k(["", "  ", None]) == [None, None, None]
