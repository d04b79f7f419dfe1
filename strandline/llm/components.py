"""Connected components over a two-dimensional grid of edge blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import materialize, release

#: Edges per task. Cells beyond are split, as any subset of the edges is a valid cell.
PER_CELL = 1_000_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, smallest vertex of each one's component): hooking and pointer jumping on arrays."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(ids))
    while len(u):
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            break
        u, v = pu[apart], pv[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return ids, ids[parent]


def _forest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition reduced to a spanning forest, a block of edges at a time."""
    held, n = [], 0

    def out():
        t = pa.Table.from_batches(held)
        ids, root = union_find(t["src"].to_numpy(), t["dst"].to_numpy())
        keep = ids != root
        return pa.RecordBatch.from_arrays([pa.array(root[keep]), pa.array(ids[keep])], names=["src", "dst"])

    for batch in parts:
        held.append(batch)
        n += batch.num_rows
        if n >= PER_CELL:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _stars(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, root = union_find(pdf.src.to_numpy(), pdf.dst.to_numpy())
    return pd.DataFrame({"id": ids, "rep": root})


def components(edges: DataFrame, least_grid: int = 4, per_cell: int = PER_CELL) -> DataFrame:
    """(id, root) for every vertex of edges(src long, dst long): root is the component's smallest vertex.

    Vertices are hashed into blocks and every edge goes to the cell of its two blocks.
    Each cell runs union-find on its own edges and names a representative per vertex. A
    vertex occurs in the cells of one row and one column; exchanging their representatives
    gives its parent, and an edge between any two that differ. These edges link
    representatives only and make the next, smaller graph, until parents are stable; then
    the rounds' parents are composed, last round first.

    Before the first round each input partition is reduced to a spanning forest. Cells hold at
    most ``per_cell`` edges: the grid grows with the edge count, and cells with more, such as
    a hub's, are split by edge hash. Repeated and reversed edges change nothing; edges with a NULL
    side and self-loops link nothing and are left out. No edges give no rows.
    """
    e = edges.select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).where("src < dst")
    e = materialize(e.mapInArrow(_forest, "src long, dst long"), "edges")
    n, levels, grid = e.count(), [], least_grid
    while n:
        grid = max(grid, math.ceil(math.sqrt(2 * n / per_cell)))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(grid)).cast("int")  # noqa: B023, E731
        celled = e.withColumn("cell", F.least(block("src"), block("dst")) * grid + F.greatest(block("src"), block("dst")))
        big = {r["cell"]: -(-r["count"] // per_cell) for r in celled.groupBy("cell").count().where(F.col("count") > per_cell).collect()}
        parts = F.coalesce(F.create_map(*(F.lit(x) for kv in big.items() for x in kv))[F.col("cell")], F.lit(1)) if big else F.lit(1)
        stars = celled.withColumn("part", F.pmod(F.xxhash64("src", "dst"), parts)).groupBy("cell", "part").applyInPandas(_stars, "id long, rep long")
        level = materialize(stars.groupBy("id").agg(F.min("rep").alias("up"), F.collect_set("rep").alias("reps")), "parents")
        levels.append(level)
        left = level.where("size(reps) > 1").select(F.col("up").alias("src"), F.explode("reps").alias("dst")).where("src < dst").distinct()
        release(e)
        e = materialize(left, "edges")
        n, grid = e.count(), 1
    release(e)
    if not levels:
        return edges.sparkSession.createDataFrame([], "id long, root long")
    labels = levels[-1].select("id", F.col("up").alias("root"))
    for level in reversed(levels[:-1]):
        known = labels.select(F.col("id").alias("__up"), F.col("root").alias("__root"))
        labels = level.join(known, F.col("up") == F.col("__up"), "left").select("id", F.coalesce("__root", "up").alias("root"))
    return labels
