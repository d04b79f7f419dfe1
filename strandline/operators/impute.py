"""Filling missing values from similar records: k-prototypes clusters with parent fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import materialize

#: Rows of the sample the first centres are chosen from; every later step sees all rows.
SEED_ROWS = 20_000


@dataclass(frozen=True)
class Figure:
    """When a number is a real figure: finite, within [low, high] and no code for "missing".

    ``percent``: numbers in (0, 1] are shares of one and count as percent.
    """

    name: str
    low: float = -float("inf")
    high: float = float("inf")
    codes: tuple[float, ...] = ()
    percent: bool = False

    def real(self, c: Column) -> Column:
        x = c.cast("double")
        ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        if self.low > -float("inf"):
            ok = ok & (x >= self.low)
        if self.high < float("inf"):
            ok = ok & (x <= self.high)
        return F.coalesce(ok & ~x.isin(*self.codes) if self.codes else ok, F.lit(False))

    def clean(self, c: Column) -> Column:
        x = c.cast("double")
        if self.percent:
            x = F.when((x > 0) & (x <= 1), x * 100).otherwise(x)
        return F.when(self.real(c), x)


def _code(c: str) -> Column:
    """A category as a number, so workers compare numbers: 0 for NULL."""
    return F.when(F.col(c).isNull(), 0).otherwise(F.xxhash64(F.col(c).cast("string")))


@dataclass
class KPrototypes:
    """Centres of mixed data: means of numbers, modes of categories' codes."""

    numeric: list[str]
    categorical: list[str]
    gamma: float
    mean: np.ndarray = field(default=None)
    std: np.ndarray = field(default=None)
    centres: np.ndarray = field(default=None)
    modes: np.ndarray = field(default=None)
    #: Passes over all rows, and by which share the last one lowered the total distance.
    rounds: int = 0
    shift: float = 0.0

    def nearest(self, pdf: pd.DataFrame) -> np.ndarray:
        return self.placed(pdf)[0]

    def placed(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centre and its distance: mean squared difference over the numbers a row has, plus gamma per differing category.

        A row without any number is placed by its categories alone; ties go to the first centre.
        """
        x = (pdf[self.numeric].to_numpy(float) - self.mean) / self.std
        seen = ~np.isnan(x)
        x0 = np.where(seen, x, 0.0)
        d = (x0**2) @ np.ones((x.shape[1], len(self.centres))) - 2 * x0 @ self.centres.T + seen.astype(float) @ (self.centres**2).T
        d /= np.maximum(seen.sum(1), 1)[:, None]
        for j, c in enumerate(self.categorical):
            v = pdf[c].to_numpy(np.int64)
            d += self.gamma * (v[:, None] != self.modes[None, :, j])
        at = d.argmin(1)
        return at, np.maximum(d[np.arange(len(at)), at], 0.0)


def fit(df: DataFrame, numeric: list[str], categorical: list[str], k: int = 24, gamma: float = 0.5, stable: float = 1e-3, most: int = 100) -> KPrototypes:
    """Lloyd's iterations as aggregations: only k centres ever reach the driver.

    The first centres come from a bounded sample, which is brought to rest on the driver; all rows are then gone
    through until a pass lowers the total distance by less than ``stable``, as a share. ``rounds`` and ``shift`` of the result
    tell how many passes that took (``most`` at most) and what the last one still changed.
    """
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in numeric), *(_code(c).alias(c) for c in categorical))
    s = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(numeric)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(numeric)), F.count("*").alias("n")).first()
    m = KPrototypes(numeric, categorical, gamma)
    m.mean = np.array([s[f"m{i}"] if s[f"m{i}"] is not None else 0.0 for i in range(len(numeric))])
    m.std = np.array([s[f"s{i}"] or 1.0 for i in range(len(numeric))])
    draw = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40)) / float(1 << 40)  # by content, so partitions don't matter
    seeds = rows.where(draw <= min(1.0, 2.0 * SEED_ROWS / max(s["n"], 1))).orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(SEED_ROWS).toPandas()
    if seeds.empty:
        m.centres, m.modes = np.zeros((1, len(numeric))), np.zeros((1, len(categorical)), np.int64)
        return m
    x = np.nan_to_num((seeds[numeric].to_numpy(float) - m.mean) / m.std)
    cat = seeds[categorical].to_numpy(np.int64)
    chosen, far = [0], None
    for _ in range(min(k, len(seeds)) - 1):  # farthest first
        d = ((x - x[chosen[-1]]) ** 2).mean(1) + gamma * (cat != cat[chosen[-1]]).sum(1)
        far = d if far is None else np.minimum(far, d)
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    m.centres, m.modes = x[chosen], cat[chosen]
    _rest(lambda: _moved(m, _sums(m, seeds)), stable, most)
    m.rounds, m.shift = _rest(lambda: _refine(rows, m), stable, most)
    return m


def _rest(step: Callable[[], float], stable: float, most: int) -> tuple[int, float]:
    """Steps until the total distance that each returns falls by less than a share of it."""
    last = None
    for i in range(most):
        total = step()
        shift = (last - total) / last if last else 1.0 if last is None and total else 0.0
        if shift < stable:
            return i + 1, shift
        last = total
    return most, shift


def _sums(m: KPrototypes, pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts and sums per centre and number (j), counts per centre and category's value, and the total distance (j = -1)."""
    c, d = m.placed(pdf)
    x = (pdf[m.numeric].to_numpy(float) - m.mean) / m.std
    out = [pd.DataFrame({"c": [0], "j": [-1], "v": [0], "n": [len(c)], "t": [float(d.sum())]})]
    for j in range(len(m.numeric)):
        ok = ~np.isnan(x[:, j])
        n = np.bincount(c[ok], minlength=len(m.centres))
        t = np.bincount(c[ok], weights=x[ok, j], minlength=len(m.centres))
        out.append(pd.DataFrame({"c": np.arange(len(n)), "j": j, "v": 0, "n": n, "t": t})[n > 0])
    for j, name in enumerate(m.categorical):
        v = pdf[name].to_numpy(np.int64)
        known = v != 0
        pairs, n = np.unique(np.stack([c[known], v[known]]), axis=1, return_counts=True)
        out.append(pd.DataFrame({"c": pairs[0], "j": len(m.numeric) + j, "v": pairs[1], "n": n, "t": 0.0}))
    return pd.concat(out)


def _moved(m: KPrototypes, sums: pd.DataFrame) -> float:
    """Put the centres where the sums say; gives the total distance before."""
    total = float(sums.t[sums.j == -1].sum())
    best = sums[sums.j >= 0].sort_values(["n", "v"]).groupby(["c", "j"]).tail(1)
    for c, j, v, n, t in best[["c", "j", "v", "n", "t"]].itertuples(index=False):
        if j < len(m.numeric):
            m.centres[c, j] = t / n
        else:
            m.modes[c, j - len(m.numeric)] = v
    return total


def _refine(rows: DataFrame, m: KPrototypes) -> float:
    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield _sums(m, pdf)

    sums = rows.mapInPandas(partial, "c int, j int, v long, n long, t double").groupBy("c", "j", "v").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    best = sums.groupBy("c", "j").agg(F.max_by(F.struct("v", "n", "t"), F.struct("n", "v")).alias("b"))
    return _moved(m, best.select("c", "j", "b.*").toPandas())  # a row per centre and column


def assign(df: DataFrame, m: KPrototypes, to: str = "cluster") -> DataFrame:
    """Add each row's cluster; a column of that name is replaced."""
    df = df.drop(to)
    kept = df.columns
    coded = df.withColumns({f"__n_{c}": F.col(c).cast("double") for c in m.numeric} | {f"__c_{c}": _code(c) for c in m.categorical})

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            used = pd.DataFrame({c: pdf[f"__n_{c}"] for c in m.numeric} | {c: pdf[f"__c_{c}"] for c in m.categorical})
            yield pdf[kept].assign(**{to: m.nearest(used)})

    return coded.mapInPandas(place, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{to}` int")


def fill(df: DataFrame, levels: list[list[str]], numeric: list[str], categorical: list[str] | None = None, least: int = 3, accuracy: int = 10_000) -> DataFrame:
    """Fill NULLs of the fields from the finest level that has at least ``least`` observed values.

    ``levels`` runs from fine to coarse, each a list of columns; ``[]`` is
    the whole table and needs one value only. Numbers get the level's median
    (``percentile_approx``: bounded memory however large the group), categories its mode.
    Adds ``<field>_method`` (level's name, ``observed``, or ``none`` where nothing is known at all) and ``<field>_filled``, true
    exactly where a level gave the value. Observed values never change; rows with a
    NULL level column skip that level. All levels come from one pass.
    """
    categorical = categorical or []
    fields = numeric + categorical
    cols = list(dict.fromkeys(c for lv in levels for c in lv))
    stats = [F.percentile_approx(f, 0.5, accuracy).alias(f"__s_{f}") for f in numeric] + [F.mode(f, True).alias(f"__s_{f}") for f in categorical]
    sets = [[F.col(c) for c in lv] for lv in levels]
    df = materialize(df, "assigned")  # read for the statistics and for the rows
    table = materialize(df.groupingSets(sets, *cols).agg(F.grouping_id().alias("__g"), *stats, *(F.count(f).alias(f"__n_{f}") for f in fields)), "levels")
    out = df
    for i, lv in enumerate(levels):
        gid = sum(1 << (len(cols) - 1 - j) for j, c in enumerate(cols) if c not in lv)
        part = table.where(F.col("__g") == gid).select(
            *(F.col(c).alias(f"__l_{c}") for c in lv), *(F.when(F.col(f"__n_{f}") >= (least if lv else 1), F.col(f"__s_{f}")).alias(f"__v{i}_{f}") for f in fields)
        )
        if lv:
            on = F.lit(True)
            for c in lv:
                on = on & (F.col(c) == F.col(f"__l_{c}"))
            out = out.join(part, on, "left").drop(*(f"__l_{c}" for c in lv))
        else:  # one row
            one = part.groupBy().agg(*(F.max(f"__v{i}_{f}").alias(f"__v{i}_{f}") for f in fields)).first()
            kinds = dict(df.dtypes)
            out = out.withColumns({f"__v{i}_{f}": F.lit(one[f"__v{i}_{f}"]).cast(kinds[f]) for f in fields})
    for f in fields:
        name = F.when(F.col(f).isNotNull(), F.lit("observed"))
        for i, lv in enumerate(levels):
            name = name.when(F.col(f"__v{i}_{f}").isNotNull(), F.lit("+".join(lv) or "all"))
        out = out.withColumn(f"{f}_method", name.otherwise("none"))
        out = out.withColumn(f"{f}_filled", ~F.col(f"{f}_method").isin("observed", "none")).withColumn(f, F.coalesce(F.col(f), *(F.col(f"__v{i}_{f}") for i in range(len(levels)))))
    return out.drop(*(f"__v{i}_{f}" for i in range(len(levels)) for f in fields))
