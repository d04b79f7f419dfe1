"""Connected components, density clusters and communities over edge tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import materialize, release


#: Edges up to which a graph is finished in one task.
IN_TASK = 1_000_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, smallest vertex of each one's component) of the edges (a, b)."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(ids))
    while len(u):
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        u, v = pu[apart], pv[apart]
        if len(u):
            np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    return ids, ids[parent]


def _stars(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around each component's smallest vertex, a block of edges at a time."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids, root = union_find(t["u"].to_numpy(), t["v"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(ids[ids != root]), pa.array(root[ids != root])], names=["u", "v"])

    for batch in parts:
        held.append(batch)
        n += batch.num_rows
        if n >= IN_TASK:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of edges(src long, dst long): root is its component's smallest vertex.

    Each partition first turns its edges into stars, which leaves fewer edges than vertices; a graph of ``IN_TASK`` edges or less is then
    finished in one task. Larger ones go on by alternating large-star and small-star aggregations until nothing changes, written
    to the shared folder, so that lineage stays short and lost executors cost nothing; the number of rounds grows with the logarithm of
    the longest chain. Either way gives the same. Self-loops give a component of one; edges with a NULL side are left out.
    """
    base = materialize(edges.where("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), "edges")
    ids = base.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    e = materialize(base.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v")).mapInArrow(_stars, "u long, v long"), "stars")
    n = e.count()
    if n <= IN_TASK:
        e = e.coalesce(1).mapInArrow(_stars, "u long, v long")
    while n > IN_TASK:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        new = small.select("v", F.col("m").alias("w")).union(down.select("u", F.col("m").alias("w"))).toDF("u", "v").where("u <> v").distinct()
        new = materialize(new, "stars")
        same = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        release(e)
        e = new
        if same:
            break
    return ids.join(e.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def dbscan(pairs: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """(id, cluster, role) by density over the pairs that are near enough: core, border or noise.

    A row with at least ``least`` near rows, itself counted, is core; cores that are near share a cluster, named by
    its smallest core; a border row joins its smallest near core; noise is a cluster of its own. With
    ``least`` 1 this is connected components.
    """
    both = pairs.select("src", "dst").union(pairs.select("dst", "src")).toDF("src", "dst").where("src <> dst").distinct()
    degree = ids.select("id").distinct().join(both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    core = materialize(degree.where(F.col("n") >= least).select("id"), "cores")
    c_s, c_d = core.select(F.col("id").alias("src")), core.select(F.col("id").alias("dst"))
    linked = connected_components(both.join(c_s, "src").join(c_d, "dst"))
    cores = core.join(linked, "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))
    near = both.join(cores.select(F.col("id").alias("dst"), "cluster"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("cluster").alias("near"))
    out = degree.join(cores, "id", "left").join(near, "id", "left")
    role = F.when(F.col("cluster").isNotNull(), "core").when(F.col("near").isNotNull(), "border").otherwise("noise")
    return out.select("id", F.coalesce("cluster", "near", "id").alias("cluster"), role.alias("role"))


def _louvain(ids: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, gamma: float, two_m: float, loop: np.ndarray) -> np.ndarray:
    """Communities of one component: local moves and folding, in order of vertices, until no move gains."""
    nodes = np.arange(len(ids))
    adj: list[dict[int, float]] = [{} for _ in ids]
    loop = loop.copy()
    for a, b, x in zip(u, v, w, strict=True):
        adj[a][b] = adj[a].get(b, 0.0) + x
        adj[b][a] = adj[b].get(a, 0.0) + x
    while True:
        n = len(adj)
        k = np.array([sum(d.values()) for d in adj]) + 2 * loop
        com, tot = np.arange(n), k.copy()
        moved_any, moved = False, True
        while moved:
            moved = False
            for i in range(n):
                to: dict[int, float] = {}
                for j, x in adj[i].items():
                    to[com[j]] = to.get(com[j], 0.0) + x
                own = com[i]
                tot[own] -= k[i]
                best, gain = own, to.get(own, 0.0) - gamma * k[i] * tot[own] / two_m
                for c in sorted(to):
                    g = to[c] - gamma * k[i] * tot[c] / two_m
                    if g > gain + 1e-12:
                        best, gain = c, g
                tot[best] += k[i]
                if best != own:
                    com[i], moved, moved_any = best, True, True
        if not moved_any:
            return nodes
        _, com = np.unique(com, return_inverse=True)
        nodes = com[nodes]
        folded: list[dict[int, float]] = [{} for _ in range(com.max() + 1)]
        new_loop = np.zeros(len(folded))
        np.add.at(new_loop, com, loop)
        for i, d in enumerate(adj):
            for j, x in d.items():
                if com[i] == com[j]:
                    new_loop[com[i]] += x / 2
                else:
                    folded[com[i]][com[j]] = folded[com[i]].get(com[j], 0.0) + x
        adj, loop = folded, new_loop


def by_component(df: DataFrame, root: str, solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str, per_task: int = 100_000, whole: bool = False) -> DataFrame:
    """``solve`` of each component's rows, many small components to a task's group.

    With ``whole``, ``solve`` takes a group's components at once. ``df`` is a written table, so counting it costs nothing; a group holds whole components of some ``per_task`` rows in all.
    """
    groups = max(1, -(-df.count() // per_task))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return solve(pdf) if whole else pd.concat([solve(x) for _, x in pdf.groupby(root, sort=False)])

    return df.withColumn("__group", F.pmod(F.xxhash64(root), F.lit(groups))).groupBy("__group").applyInPandas(run, schema)


def _move_together(e: DataFrame, gamma: float, two_m: float, rounds: int) -> DataFrame:
    """(id, com): communities by local moves over all tasks, a part of the vertices at a time.

    In a round the vertices of one part, by digest, each go to the neighbouring community of the largest gain; as the others hold still, two
    vertices seldom swap. A round is two joins and three aggregations; hubs are summed before they are shuffled.
    """
    both = e.select("src", "dst", "weight").union(e.select("dst", "src", "weight")).toDF("src", "dst", "weight")
    k = materialize(both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")), "degrees")
    com = materialize(k.select("id", "k", F.col("id").alias("com")), "communities")
    for i in range(rounds):
        tot = com.groupBy("com").agg(F.sum("k").alias("tot"))
        to = both.where(F.col("src") != F.col("dst")).join(com.select(F.col("id").alias("dst"), "com"), "dst").groupBy(F.col("src").alias("id"), "com").agg(F.sum("weight").alias("w"))
        own = com.select("id", F.col("com").alias("own"), "k").where(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(4)) == 0)
        stay = own.select("id", F.col("own").alias("com"), F.lit(0.0).alias("w"))
        offers = to.join(own.select("id"), "id", "left_semi").unionByName(stay).groupBy("id", "com").agg(F.sum("w").alias("w"))
        scored = offers.join(own, "id").join(tot, "com").withColumn("gain", F.col("w") - gamma * F.col("k") * (F.col("tot") - F.when(F.col("com") == F.col("own"), F.col("k")).otherwise(0.0)) / two_m)
        best = scored.groupBy("id").agg(F.max_by(F.struct("com", "gain"), F.struct(F.round("gain", 12), (F.col("com") == F.col("own")).cast("int"), -F.col("com"))).alias("b"))
        new = materialize(com.join(best.select("id", F.col("b.com").alias("__to")), "id", "left").select("id", "k", F.coalesce("__to", "com").alias("com")), "communities")
        release(com)
        com = new
    return com.select("id", "com")


def louvain(edges: DataFrame, resolution: float = 1.0, in_task: int = IN_TASK, rounds: int = 24) -> DataFrame:
    """(id, community): weighted Louvain communities of edges(src, dst, weight), named by their smallest vertex.

    Communities never cross components, so components of up to ``in_task`` edges are solved many to a task, in the order of their
    vertices. Larger ones are first moved and folded by rounds over all tasks, until what is left fits a task. Modularity keeps the
    whole graph's weight. Repeated edges add up; self-loops, NULLs and weights of 0 or less are left out.
    """
    e = edges.where("src is not null and dst is not null and src <> dst and weight > 0").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
    e = materialize(e.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight")), "weighted")
    two_m = 2.0 * (e.agg(F.sum("weight")).first()[0] or 0.0)
    rooted = materialize(e.join(connected_components(e).withColumnRenamed("id", "src"), "src"), "rooted")
    sizes = materialize(rooted.groupBy("root").agg(F.count("*").alias("n")), "sizes")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cross = pdf[pdf.src != pdf.dst]
        ids, at = np.unique(np.concatenate([pdf.src, pdf.dst]), return_inverse=True)
        loops = np.zeros(len(ids))
        own = pdf[pdf.src == pdf.dst]
        np.add.at(loops, np.searchsorted(ids, own.src.to_numpy()), own.weight.to_numpy(float))
        order = np.lexsort((cross.dst.to_numpy(), cross.src.to_numpy()))
        u, v = np.searchsorted(ids, cross.src.to_numpy()), np.searchsorted(ids, cross.dst.to_numpy())
        com = _louvain(ids, u[order], v[order], cross.weight.to_numpy(float)[order], resolution, two_m, loops)
        first = pd.Series(ids).groupby(com).min()
        return pd.DataFrame({"id": ids, "community": first.loc[com].to_numpy()})

    shape = "id long, community long"
    small = by_component(materialize(rooted.join(sizes.where(F.col("n") <= in_task), "root", "left_semi"), "small"), "root", solve, shape)
    big = materialize(rooted.join(sizes.where(F.col("n") > in_task), "root", "left_semi").select("src", "dst", "weight"), "large")
    if big.isEmpty():
        return small
    levels, left = [], big.count()
    while left > in_task:
        com = materialize(_move_together(big, resolution, two_m, rounds), "level")
        name = com.groupBy("com").agg(F.min("id").alias("to"))
        level = materialize(com.join(name, "com").select("id", "to"), "level")
        levels.append(level)
        a, b = level.select(F.col("id").alias("src"), F.col("to").alias("a")), level.select(F.col("id").alias("dst"), F.col("to").alias("b"))
        folded = big.join(a, "src").join(b, "dst").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"))
        big = materialize(folded, "folded")
        before, left = left, big.count()
        if left >= before:  # nothing moves any more
            break
    roots = connected_components(big).withColumnRenamed("id", "src")
    if left <= in_task:
        top = by_component(materialize(big.join(roots, "src"), "top"), "root", solve, shape)
    else:
        top = big.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("community", F.col("id"))
    for level in reversed(levels):
        top = level.join(top.select(F.col("id").alias("to"), "community"), "to").select("id", "community")
    return small.unionByName(top)


def greedy_clusters(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, representative): in order of id, each record joins the earliest representative it is paired with.

    A record is a representative exactly if no earlier representative is paired with it; rounds settle
    all records whose earlier partners are settled, so the sequential result comes out of parallel steps.
    ``pairs(a, b)`` with a < b; records without pairs stand alone.
    """
    open_ = materialize(records.select("id").distinct(), "open")
    p = materialize(pairs.select("a", "b").where("a < b").distinct(), "pairs")
    reps, joined = None, None
    while not open_.isEmpty():
        waiting = p.join(open_.select(F.col("id").alias("a")), "a", "left_semi").join(open_.select(F.col("id").alias("b")), "b", "left_semi")
        new = materialize(open_.join(waiting.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), "representatives")
        hit = p.join(new.select(F.col("id").alias("a")), "a").join(open_.select(F.col("id").alias("b")), "b", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("representative"))
        hit = materialize(hit, "joined")
        reps = new if reps is None else reps.unionByName(new)
        joined = hit if joined is None else joined.unionByName(hit)
        rest = materialize(open_.join(new, "id", "left_anti").join(hit.select("id"), "id", "left_anti"), "open")
        release(open_)
        open_ = rest
    if reps is None:
        return records.select("id", F.col("id").alias("representative")).limit(0)
    # a record joins the earliest of all representatives it is paired with
    first = p.join(reps.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("representative"))
    return reps.select("id", F.col("id").alias("representative")).unionByName(joined.select("id").join(first, "id"))
