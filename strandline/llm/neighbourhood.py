"""Sorted neighbourhood: rows in the order of composite keys, compared within a sliding window of days."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import materialize

#: Rows of both sides in a stretch of the order, stretches at most, and sampled rows per stretch that its borders are drawn from.
PER_STRETCH, MOST_STRETCHES, SAMPLED = 50_000, 20_000, 20
#: Bits of a position that hold the day, and candidate pairs in hand at once.
DAY_BITS, PAIRS = 22, 400_000

Compare = Callable[[pd.DataFrame, pd.DataFrame], Callable[[np.ndarray, np.ndarray], np.ndarray]]


def _ordered(df: DataFrame, side: str) -> DataFrame:
    """A row per key, with its place in the order: 40 bits of the key's digest before the day."""
    rest = [c for c in df.columns if c != "keys"]
    x = df.where("day is not null").select(*rest, F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("__key"))
    tag = F.xxhash64("__key")
    pos = F.shiftright(tag, 24) * (1 << DAY_BITS) + F.col("day") + (1 << (DAY_BITS - 1))
    return x.select(F.lit(side).alias("__side"), tag.alias("__tag"), pos.cast("long").alias("__pos"), *rest)


def _borders(sides: list[DataFrame], per_stretch: int) -> np.ndarray:
    """Positions that cut the order into stretches of about equal rows, from a bounded sample."""
    n = sum(s.count() for s in sides)
    k = min(MOST_STRETCHES, -(-n // per_stretch))
    if k < 2:
        return np.array([], np.int64)
    share = min(1.0, SAMPLED * k / n)
    pos = np.sort(np.concatenate([s.select("__pos").sample(share, seed=7).toPandas()["__pos"].to_numpy(np.int64) for s in sides]))
    return np.unique(pos[np.linspace(0, len(pos) - 1, k + 1).astype(int)[1:-1]]) if len(pos) else pos


def _placed(df: DataFrame, borders: np.ndarray, reach: int) -> DataFrame:
    """Rows with the stretch they lie in, and a copy in each further stretch that their reach extends to."""

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            pos = b.column("__pos").to_numpy()
            first, last = np.searchsorted(borders, pos - reach, "right"), np.searchsorted(borders, pos + reach, "right")
            n = last - first + 1
            row = np.repeat(np.arange(len(pos)), n)
            stretch = np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(row))
            out = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(stretch.astype(np.int32))], names=[*b.schema.names, "__stretch"])

    return df.mapInArrow(place, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", __stretch int")


def _slide(l: pd.DataFrame, r: pd.DataFrame, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of left rows and the right rows in their windows, both sides sorted by position, a block at a time."""
    at, to = l["__pos"].to_numpy(), r["__pos"].to_numpy()
    low, high = np.searchsorted(to, at - reach, "left"), np.searchsorted(to, at + reach, "right")
    n = high - low
    upto = np.cumsum(n)
    k = 0
    while k < len(n):
        done = upto[k - 1] if k else 0
        end = max(k + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
        some = n[k:end]
        for a in range(0, int(some.sum()), PAIRS):  # a window of its own may be longer than a block
            nth = np.arange(a, min(int(some.sum()), a + PAIRS))
            ends = np.cumsum(some)
            row = np.searchsorted(ends, nth, "right")
            yield k + row, low[k:end][row] + nth - (ends[row] - some[row])
        k = end


def sorted_neighbours(left: DataFrame, right: DataFrame, days: int, compare: Compare, per_stretch: int = PER_STRETCH) -> DataFrame:
    """(l_id, r_id, gap, similarity) of the pairs at most ``days`` apart under a shared key that ``compare`` finds similar.

    left(id, keys array<string>, day int, ...), right likewise. A row stands in the order once per key, at (key, day); a
    window of ``days`` before and after slides along the order, and each left row is compared with the right rows in its
    window. The window is a range of days, never a number of rows, so a crowded stretch loses no pair. The order
    is cut into stretches at sampled positions; right rows are copied over a border as far as they reach, so windows
    cross borders whole. Stretches that hold too many rows, such as a key and day that holds a third of all, are
    split by hash of the ids on either side, from exact counts.

    ``compare`` takes both sides' rows of a stretch and returns a function of row numbers (i, j) that gives
    similarities, 0 for none; it sees all further columns. ``gap`` is left day less right day. A
    pair met under several keys, or by repeated ids, comes out once, as its most similar. Rows without day, without keys or with NULL id meet nothing; empty sides give no rows.
    """
    a = materialize(_ordered(left.where("id is not null"), "l"), "sorted-left")
    b = materialize(_ordered(right.where("id is not null"), "r"), "sorted-right")
    borders = _borders([a, b], per_stretch)
    rows = {"l": _placed(a, borders, 0), "r": _placed(b, borders, days)}

    def counted(df: DataFrame, reach: int) -> dict[int, int]:
        """Parts of each stretch from its exact count, over positions alone; stretches are bounded in number."""
        n = _placed(df.select("__pos"), borders, reach).groupBy("__stretch").count().collect()
        return {x["__stretch"]: -(-x["count"] // per_stretch) for x in n}

    parts = {"l": counted(a, 0), "r": counted(b, days)}

    def part(side: str, own: bool) -> Column:
        many = {s: n for s, n in parts[side].items() if n > 1}
        n = F.coalesce(F.create_map(*(F.lit(x) for kv in many.items() for x in kv))[F.col("__stretch")], F.lit(1)) if many else F.lit(1)
        return F.pmod(F.xxhash64("id"), n).cast("int") if own else F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))

    stretch = F.col("__stretch")
    both = {"l": rows["l"].withColumn("__pl", part("l", True)).withColumn("__pr", part("r", False)), "r": rows["r"].withColumn("__pr", part("r", True)).withColumn("__pl", part("l", False))}
    shared = [s for s in parts["l"] if s in parts["r"]]
    if len(shared) < max(len(parts["l"]), len(parts["r"])):  # a stretch with rows of one side only has no pairs
        both = {k: v.where(stretch.isin(shared) if shared else F.lit(False)) for k, v in both.items()}

    def probe(_, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(l) and len(r):
            l, r = (x.sort_values("__pos", kind="stable", ignore_index=True) for x in (l, r))
            similar, lt, rt = compare(l, r), l["__tag"].to_numpy(), r["__tag"].to_numpy()
            ld, rd, li, ri = l.day.to_numpy(), r.day.to_numpy(), l.id.to_numpy(), r.id.to_numpy()
            for i, j in _slide(l, r, days):
                same = lt[i] == rt[j]
                i, j = i[same], j[same]
                s = similar(i, j)
                ok = s > 0
                i, j = i[ok], j[ok]
                found.append(pd.DataFrame({"l_id": li[i], "r_id": ri[j], "gap": (ld[i] - rd[j]).astype(np.int32), "similarity": s[ok]}))
        # Empty columns of objects pass as any type of id; empty floats can't be sent as text.
        return pd.concat(found) if found else pd.DataFrame({"l_id": [], "r_id": [], "gap": [], "similarity": []}, dtype=object)

    kinds = [dict(x.dtypes)["id"] for x in (left, right)]
    by = ("__stretch", "__pl", "__pr")
    near = both["l"].groupBy(*by).cogroup(both["r"].groupBy(*by)).applyInPandas(probe, f"l_id {kinds[0]}, r_id {kinds[1]}, gap int, similarity double")
    best = near.groupBy("l_id", "r_id").agg(F.max(F.struct("similarity", "gap")).alias("b"))
    return best.select("l_id", "r_id", "b.gap", "b.similarity")
