"""Joins over intervals, windows and nearest neighbours as equi-joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.geo import haversine_km
from strandline.functions.keys import days


def within_days(left: DataFrame, right: DataFrame, keys: list[str], date_l: str, date_r: str, before: int, after: int, how: str = "inner") -> DataFrame:
    """Pairs of equal ``keys`` with right date in [left date - before, left date + after].

    Both sides meet in stretches as wide as the interval: a left row reaches over at most two,
    a right row lies in one, so the join is a plain equi-join with a residual check, and a key that
    holds a third of all rows is spread over its stretches. Left columns keep their
    names, right ones get ``r_``. Rows without date or keys pair with nothing; ``how="left"`` keeps them.
    """
    width = before + after + 1
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withColumn("__rs", F.floor(days(F.col(f"r_{date_r}")) / width))
    d = days(F.col(date_l))
    touched = F.array_distinct(F.array(F.floor((d - before) / width), F.floor((d + after) / width)))
    on = (F.col("__ls") == F.col("__rs")) & (days(F.col(f"r_{date_r}")) - d).between(-before, after)
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    if how == "inner":
        return left.withColumn("__ls", F.explode(touched)).join(r, on).drop("__ls", "__rs")
    raise ValueError("use within_days for pairs, interval_counts or exists_within for one row per left row")


def interval_counts(left: DataFrame, right: DataFrame, keys: list[str], date_l: str, date_r: str, reach: int, sums: dict[str, Column]) -> DataFrame:
    """``left`` with sums over the right rows within ``reach`` days, 0 where there are none, NULL where a key is.

    The right side is first summed by key and day; the left side's distinct (keys, date) are
    joined, summed and joined back, so neither repeated rows nor busy days are multiplied.
    """
    daily = right.groupBy(*keys, date_r).agg(*(F.sum(e).alias(n) for n, e in sums.items()))
    moments = left.select(*keys, date_l).dropna().distinct()
    got = within_days(moments, daily, keys, date_l, date_r, reach, reach).groupBy(*keys, date_l).agg(*(F.sum(f"r_{n}").alias(n) for n in sums))
    known = F.lit(True)
    for k in [*keys, date_l]:
        known = known & F.col(k).isNotNull()
    return left.join(got, [*keys, date_l], "left").withColumns({n: F.when(known, F.coalesce(F.col(n), F.lit(0))) for n in sums})


def exists_within(left: DataFrame, right: DataFrame, keys: list[str], date_l: str, date_r: str, reach: int, flag: str) -> DataFrame:
    """``left`` with a flag: is there a right row within ``reach`` days? NULL where a key or the date is."""
    out = interval_counts(left, right, keys, date_l, date_r, reach, {"__n": F.lit(1)})
    return out.withColumn(flag, F.col("__n") > 0).drop("__n")


def window_pairs(df: DataFrame, bucket: list[str], id_: str, date: str, window: int) -> DataFrame:
    """Each pair (id < other) once of rows of a bucket at most ``window`` days apart; columns ``a_...`` and ``b_...``."""
    a = df.select(*(F.col(c).alias(f"a_{c}") for c in df.columns))
    width = window + 1
    a = a.withColumn("__s", F.explode(F.array_distinct(F.array(F.floor((days(F.col(f"a_{date}")) - window) / width), F.floor(days(F.col(f"a_{date}")) / width), F.floor((days(F.col(f"a_{date}")) + window) / width)))))
    b = df.select(*(F.col(c).alias(f"b_{c}") for c in df.columns)).withColumn("__t", F.floor(days(F.col(f"b_{date}")) / width))
    on = (F.col("__s") == F.col("__t")) & (F.col(f"a_{id_}") < F.col(f"b_{id_}")) & (F.abs(days(F.col(f"a_{date}")) - days(F.col(f"b_{date}"))) <= window)
    for k in bucket:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    return a.join(b, on).drop("__s", "__t")


def window_cosines(df: DataFrame, bucket: str, id_: str, date: str, vector: str, window: int, least: float, per_task: int = 20_000) -> DataFrame:
    """(src, dst, weight): pairs (src < dst) of a bucket at most ``window`` days apart whose vectors of length 1 have a product of ``least`` or more.

    Rows meet in stretches as in :func:`window_pairs`, but a stretch is one product of matrices, a block of rows at a time, so no pair's
    vectors are ever put side by side. Stretches of more than ``per_task`` rows are split by hash on both sides, from exact counts. Rows
    without vector, day or bucket pair with nothing.
    """
    width = window + 1
    rows = df.select(F.col(bucket).alias("bucket"), F.col(id_).cast("long").alias("id"), days(F.col(date)).alias("day"), F.col(vector).cast("array<double>").alias("u")).where("bucket is not null and day is not null and u is not null")
    right = rows.withColumn("at", F.floor(F.col("day") / width))
    left = rows.withColumn("at", F.explode(F.array_distinct(F.array(F.floor((F.col("day") - window) / width), F.floor(F.col("day") / width), F.floor((F.col("day") + window) / width)))))
    hot = {(r.bucket, r["at"]): -(-r["count"] // per_task) for r in right.groupBy("bucket", "at").count().where(F.col("count") > per_task).collect()}
    n = F.lit(1)
    for (b, at), k in hot.items():
        n = F.when((F.col("bucket") == b) & (F.col("at") == at), k).otherwise(n)
    own, all_ = F.pmod(F.xxhash64("id"), n).cast("int"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    a, b = left.withColumn("pl", own).withColumn("pr", all_), right.withColumn("pr", own).withColumn("pl", all_)

    def product(_, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(x) and len(y):
            ys, y_id, y_day = np.stack(y.u.to_numpy()), y.id.to_numpy(), y.day.to_numpy()
            step = max(1, 4_000_000 // len(y))
            for k in range(0, len(x), step):
                p = x.iloc[k : k + step]
                w = np.round(np.stack(p.u.to_numpy()) @ ys.T, 9)
                i, j = np.nonzero((w >= least) & (p.id.to_numpy()[:, None] < y_id) & (np.abs(p.day.to_numpy()[:, None] - y_day) <= window))
                found.append(pd.DataFrame({"src": p.id.to_numpy()[i], "dst": y_id[j], "weight": w[i, j]}))
        return pd.concat(found) if found else pd.DataFrame({"src": [], "dst": [], "weight": []})

    by = ("bucket", "at", "pl", "pr")
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(product, "src long, dst long, weight double")


def token_pairs(df: DataFrame, id_: str, tokens: str, extra: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """(a, b, common, jaccard): pairs of rows of a Jaccard similarity above 0, and ``least`` or more, equal in the ``extra`` columns.

    With ``least`` only prefixes meet: with its tokens in order of their frequency, rarest first, two rows of that similarity share a
    token among the first n - ceil(least x n) + 1 of each, so a common token hardly ever pairs rows; sets are then compared whole.
    Without it the common tokens of all pairs that share any are counted.
    """
    extra = extra or []
    sets = df.select(F.col(id_).alias("id"), *extra, F.array_distinct(tokens).alias("t")).where(F.size("t") > 0)
    b_of = lambda p, *more: p.select(F.col("id").alias("b"), *(F.col(c).alias(f"__{c}") for c in extra), *more)
    on = F.col("id") < F.col("b")
    for c in extra:
        on = on & (F.col(c) == F.col(f"__{c}"))
    if not least:
        post = sets.select("id", *extra, F.size("t").alias("n"), F.explode("t").alias("tok"))
        hit = post.join(b_of(post, F.col("n").alias("nb"), F.col("tok").alias("tok2")), on & (F.col("tok") == F.col("tok2"))).groupBy(F.col("id").alias("a"), "b", "n", "nb").agg(F.count("*").alias("common"))
        return hit.select("a", "b", "common", (F.col("common") / (F.col("n") + F.col("nb") - F.col("common"))).alias("jaccard"))
    each = sets.select("id", F.explode("t").alias("tok"))
    rare = each.groupBy("tok").agg(F.count("*").alias("df"))
    order = each.join(rare, "tok").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("o"))  # a row's own tokens
    ranked = sets.join(order, "id").withColumn("p", F.transform(F.slice("o", 1, F.size("t") - F.ceil(F.size("t") * least - 1e-9).cast("int") + 1), lambda x: x["tok"]))
    post = ranked.select("id", *extra, "t", F.explode("p").alias("tok"))
    pairs = post.join(b_of(post, F.col("t").alias("tb"), F.col("tok").alias("tok2")), on & (F.col("tok") == F.col("tok2")) & (F.least(F.size("t"), F.size("tb")) >= F.greatest(F.size("t"), F.size("tb")) * least - 1e-9))
    pairs = pairs.withColumn("common", F.size(F.array_intersect("t", "tb"))).withColumn("jaccard", F.col("common") / (F.size("t") + F.size("tb") - F.col("common")))
    return pairs.where(F.col("jaccard") >= least - 1e-12).select(F.col("id").alias("a"), "b", F.col("common").cast("long").alias("common"), "jaccard").dropDuplicates(["a", "b"])


def blocked_pairs(df: DataFrame, id_: str, date: str, blocks: dict[str, Column], reach: int) -> DataFrame:
    """(a, b, gap): pairs (a < b) at most ``reach`` days apart that share a value in any of the blocks, columns or arrays of text.

    Each value is a key of its own, met in stretches of days; NULL and blank values block nothing. A pair comes once.
    """
    keys = F.concat(*(F.transform(c, lambda v, n=n: F.concat(F.lit(f"{n}:"), v)) for n, c in blocks.items()))
    rows = df.select(F.col(id_).alias("id"), F.col(date).cast("date").alias("day"), F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & ~k.rlike(r"^[^:]*:\s*$")))).alias("key")).where("day is not null")
    p = window_pairs(rows, ["key"], "id", "day", reach)
    return p.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.abs(F.datediff("a_day", "b_day")).alias("gap")).distinct()


def first_match(df: DataFrame, id_: str, array: str, dim: DataFrame, key: str, value: str) -> DataFrame:
    """(id, value): of a row's array, in its order, the first element that ``dim`` has a value for; smallest value on repeats."""
    d = dim.select(F.col(key).alias("__k"), F.col(value).alias("__v")).where("__k is not null and __v is not null").groupBy("__k").agg(F.min("__v").alias("__v"))
    each = df.select(F.col(id_), F.posexplode(array).alias("__pos", "__e"))
    return each.join(d, F.col("__e") == F.col("__k")).groupBy(id_).agg(F.min_by("__v", "__pos").alias(value))


def merge_layers(base: DataFrame, layers: list[tuple[DataFrame, list[str]]], key: str) -> DataFrame:
    """``base`` with the listed fields of each layer, joined by a key of sorted array elements; rows of a layer that match nothing are ignored.

    A layer's field replaces one of the same name where the layer has a row; repeated keys of a layer take the largest content.
    """
    of = lambda df: F.array_join(F.array_sort(F.array_distinct(F.col(key))), "|")
    out = base.withColumn("__key", of(base))
    for i, (layer, fields) in enumerate(layers):
        one = layer.withColumn(f"__k{i}", of(layer)).groupBy(f"__k{i}").agg(F.max(F.struct(*(F.col(f).alias(f"__{i}_{f}") for f in fields))).alias("__f"))
        out = out.join(one, F.col("__key") == F.col(f"__k{i}"), "left")
        new = {f: F.when(F.col("__f").isNotNull(), F.col(f"__f.__{i}_{f}")).otherwise(F.col(f) if f in base.columns else F.lit(None)) for f in fields}
        out = out.withColumns(new).drop("__f", f"__k{i}")
    return out.drop("__key")


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], id_l: str, id_r: str, date_l: str, date_r: str, reach: int, limit_km: float) -> DataFrame:
    """(id_l, id_r, km, match): per left row the nearest right row of its keys within ``reach`` days.

    Within ``limit_km`` the match is ``geographic``, beyond it ``country_only``; without coordinates the earliest
    row, then the smallest id, is taken with km NULL. Needs lat and lon on both sides.
    """
    p = within_days(left, right, keys, date_l, date_r, reach, reach)
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    p = p.withColumn("km", km)
    best = F.min_by(F.struct(F.col(f"r_{id_r}").alias(id_r), "km"), F.struct(F.col("km").isNull(), "km", f"r_{date_r}", f"r_{id_r}"))
    out = p.groupBy(id_l).agg(best.alias("b")).select(id_l, f"b.{id_r}", "b.km")
    return out.withColumn("match", F.when(F.col("km") <= limit_km, "geographic").otherwise("country_only"))


def nearest_constant(df: DataFrame, lat: str, lon: str, points: dict[str, tuple[float, float]], limit_km: float) -> DataFrame:
    """Add the nearest of a few named points (ties: the first) and its distance; beyond ``limit_km`` the name is NULL."""
    d = F.array(*(F.struct(haversine_km(F.col(lat), F.col(lon), F.lit(a), F.lit(o)).alias("km"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, (a, o)) in enumerate(points.items())))
    best = F.array_min(F.filter(d, lambda x: x["km"].isNotNull()))
    return df.withColumn("__b", best).withColumns({"nearest_km": F.col("__b.km"), "nearest": F.when(F.col("__b.km") <= limit_km, F.col("__b.name"))}).drop("__b")


def fill_join(left: DataFrame, fills: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``left`` with NULLs of ``cols`` taken from ``fills``, matched by keys (unique in ``fills``)."""
    f = fills.select(*keys, *(F.col(c).alias(f"__f_{c}") for c in cols))
    return left.join(f, keys, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"__f_{c}")) for c in cols}).drop(*(f"__f_{c}" for c in cols))


def lag_of_global(df: DataFrame, date: str, value: str, n: int, name: str) -> DataFrame:
    """The value ``n`` distinct dates earlier of a series that is the same for all entities."""
    g = df.select(date, value).groupBy(date).agg(F.max(value).alias(value))
    w = Window.partitionBy(F.lit(0)).orderBy(date)  # a row per date
    return df.join(g.select(date, F.lag(value, n).over(w).alias(name)), date, "left")
