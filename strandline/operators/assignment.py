"""One-to-one assignment of largest total weight."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.graph import by_component, connected_components
from strandline.session import materialize, release

#: Weights count in steps of this size, so that totals are whole numbers and both ways of solving agree exactly.
STEP = 1e-6
#: Pairs of a component that one task solves; components beyond are solved by rounds over all tasks.
IN_TASK = 200_000


def best_matching(l: np.ndarray, r: np.ndarray, w: np.ndarray) -> list[int]:
    """Numbers of the pairs of largest total weight that use each of l and r once; w are whole numbers above 0.

    Shortest augmenting paths over the pairs alone, one right row at a time: memory grows with the pairs, never with
    rows times columns. A right row may stay alone, at weight 0.
    """
    top = int(w.max(initial=0))
    edges: dict[int, list[tuple[int, int, int]]] = {}
    for k, (a, b, x) in enumerate(zip(l.tolist(), r.tolist(), w.tolist(), strict=True)):
        edges.setdefault(b, []).append((a, top - x, k))
    u, v = dict.fromkeys(edges, 0), dict.fromkeys(l.tolist(), 0)
    owner: dict[int, int] = {}
    taken: dict[int, tuple[int, int]] = {}
    for start in edges:
        far: dict[int, int] = {}
        via: dict[int, tuple[int, int]] = {}
        done: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        row, at, stop, end, last = start, 0, None, None, None
        while True:
            alone = at + top - u[row]  # this row gives up its partner and stays alone
            if stop is None or alone < stop:
                stop, end, last = alone, None, row
            for a, cost, k in edges[row]:
                d = at + cost - u[row] - v[a]
                if a not in done and (a not in far or d < far[a]) and d < stop:
                    far[a], via[a] = d, (row, k)
                    heapq.heappush(heap, (d, a))
            while heap and (heap[0][1] in done or heap[0][0] > far[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= stop:
                break
            at, a = heapq.heappop(heap)
            if a not in owner:
                stop, end, last = at, a, None
                break
            done[a] = at
            row = owner[a]
        u[start] += stop
        for a, d in done.items():
            u[owner[a]] += stop - d
            v[a] -= stop - d
        if end is None:  # the last row loses its partner
            if last == start:
                continue
            end = taken.pop(last)[0]
        while True:
            row, k = via[end]
            before = taken.get(row)
            owner[end], taken[row] = row, (end, k)
            if row == start:
                break
            end = before[0]
    return [k for _, k in taken.values()]


def solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact assignment of each component's pairs(root, l, r, w); no pair is forced."""
    pdf = pdf.sort_values(["root", "r", "l"])
    root, left, right, weight = (pdf[c].to_numpy() for c in ("root", "l", "r", "w"))
    whole = np.maximum(np.rint(weight / STEP), 1).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, root[1:] != root[:-1]]) if len(root) else np.array([], int)
    rows = [a + k for a, b in zip(starts, np.r_[starts[1:], len(root)], strict=True) for k in best_matching(left[a:b], right[a:b], whole[a:b])]
    return pd.DataFrame({"l": left[rows], "r": right[rows], "w": weight[rows]})


def auction(pairs: DataFrame) -> DataFrame:
    """(l, r, w): the assignment of largest total weight over pairs(l, r, w > 0), by rounds of bids over all tasks.

    Each row also gets a mirror image, which it takes at weight 0 to stay alone, so everybody ends up assigned and prices may
    start anywhere. Bids rise by at least ``eps``; it falls by phases, each starting from the prices of
    the one before, and ends below one step divided by the number of bidders, where the total is the best one. A
    round is a join and two aggregations; prices and owners are written to the shared folder.
    """
    x = pairs.select(F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), F.greatest(F.round(F.col("w") / STEP, 0), F.lit(1)).cast("long").alias("v"))
    both = x.select((F.col("r") * 2).alias("who"), (F.col("l") * 2).alias("what"), "v").union(x.select(F.col("l") * 2 + 1, F.col("r") * 2 + 1, "v"))
    alone = x.select((F.col("r") * 2).alias("who"), (F.col("r") * 2 + 1).alias("what"), F.lit(0).cast("long").alias("v")).union(x.select(F.col("l") * 2 + 1, F.col("l") * 2, F.lit(0).cast("long"))).distinct()
    edges = materialize(both.union(alone), "offers")
    n = edges.select("who").distinct().count()
    if not n:
        return pairs.select("l", "r", "w").limit(0)
    edges = edges.withColumn("v", F.col("v") * (n + 1))
    eps = max(1, edges.agg(F.max("v")).first()[0] // 4)
    spark = pairs.sparkSession
    state = spark.createDataFrame([], "what long, who long, price long")
    while True:
        state = state.withColumn("who", F.lit(None).cast("long"))
        while True:
            free = edges.join(state.where("who is not null").select("who"), "who", "left_anti")
            gain = free.join(state.select("what", "price"), "what", "left").select("who", "what", F.coalesce("price", F.lit(0)).alias("price"), (F.col("v") - F.coalesce("price", F.lit(0))).alias("gain"))
            two = gain.withColumn("n", F.row_number().over(Window.partitionBy("who").orderBy(F.desc("gain"), "what"))).where("n <= 2")
            bids = two.groupBy("who").agg(F.min_by(F.struct("what", "price"), "n").alias("b"), (F.max("gain") - F.min("gain")).alias("lead"))
            won = bids.groupBy(F.col("b.what").alias("what")).agg(F.max(F.struct((F.col("b.price") + F.col("lead") + eps).alias("price"), "who")).alias("x"))
            won = materialize(won.select("what", "x.who", "x.price"), "bids")
            if won.isEmpty():
                break
            new = materialize(state.join(won.select("what"), "what", "left_anti").unionByName(won), "prices")
            release(state)
            release(won)
            state = new
        if eps == 1:
            break
        eps = max(1, eps // 5)
    own = state.where("who % 2 = 0 and what % 2 = 0").select(F.expr("what div 2").alias("__l"), F.expr("who div 2").alias("__r"))
    return pairs.join(own, (F.col("l") == F.col("__l")) & (F.col("r") == F.col("__r"))).select("l", "r", "w")


def assign_rooted(pairs: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(l, r, w) of a written table pairs(root, l, r, w) of distinct pairs with the component each belongs to.

    Components of one right row are its best pair, by aggregation. Others are solved many to a task up to ``in_task`` pairs;
    larger ones together by :func:`auction`. Either way the total is the largest, in steps of ``STEP``; which of several
    equally good assignments comes out may differ.
    """
    size = pairs.groupBy("root").agg(F.count("*").alias("__n"), (F.min("r") == F.max("r")).alias("__star"))
    p = materialize(pairs.join(size, "root"), "sized")
    star = p.where("__star").groupBy("r").agg(F.max_by(F.struct("l", "w"), F.struct("w", -F.col("l"))).alias("b")).select("b.l", "r", "b.w")
    knots = materialize(p.where(~F.col("__star") & (F.col("__n") <= in_task)).select("root", "l", "r", "w"), "knots")
    out = star.unionByName(by_component(knots, "root", solve, "l long, r long, w double", whole=True))
    large = p.where(~F.col("__star") & (F.col("__n") > in_task)).select("l", "r", "w")
    return out if large.isEmpty() else out.unionByName(auction(materialize(large, "large")))


def assign(pairs: DataFrame, least: float, in_task: int = IN_TASK) -> DataFrame:
    """(l, r, w): the one-to-one assignment of largest total weight over pairs(l long, r long, w) with w >= ``least``.

    Weights add up over components, so each is solved apart. Repeated pairs count once with their largest weight; pairs with
    NULLs, or no weight above 0, are left out; no pairs give no rows.
    """
    p = pairs.where("l is not null and r is not null").where((F.col("w") >= least) & (F.col("w") > 0)).groupBy(F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r")).agg(F.max("w").cast("double").alias("w"))
    p = materialize(p, "pairs")
    roots = connected_components(p.select((F.col("l") * 2).alias("src"), (F.col("r") * 2 + 1).alias("dst"))).withColumnRenamed("id", "__n")
    return assign_rooted(materialize(p.join(roots, F.col("r") * 2 + 1 == F.col("__n")).select("root", "l", "r", "w"), "rooted"), in_task)
