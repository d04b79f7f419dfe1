"""Records consolidated into groups along pairwise matches of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.session import materialize

#: Pages without a record are numbered from here on; record ids lie below.
NO_RECORD = 1 << 62


def link_records(records: DataFrame, matches: DataFrame, **grid: int) -> DataFrame:
    """(id, group_id, n_members) of every record of records(id long, key), over matches(pair long, a, b).

    Records are linked when their keys are equal or a chain of matches joins their keys, also through
    keys without a record. ``group_id`` is the group's smallest id. A record with a NULL key, or
    linked to no other, is a group of its own. A match with a NULL side links nothing;
    repeated, reversed and self-matches change nothing. ``id`` and ``pair`` are unique.

    Keys are shuffled as 128-bit digests; each distinct key becomes one 64-bit vertex, numbered by its
    smallest record, or match, so edges never carry text.
    """
    digest = lambda c: F.unhex(F.md5(c.cast("string")))
    r = records.select(F.col("id").cast("long").alias("id"), digest(F.col("key")).alias("key"))
    m = matches.select(F.col("pair").cast("long").alias("pair"), digest(F.col("a")).alias("a"), digest(F.col("b")).alias("b")).where("a is not null and b is not null and a <> b")
    m = materialize(m, "matches")
    none = F.lit(None).cast("long")
    sides = m.select(F.explode(F.array(F.struct(F.col("a").alias("key"), (F.col("pair") * 2).alias("code")), F.struct(F.col("b").alias("key"), (F.col("pair") * 2 + 1).alias("code")))).alias("s")).select("s.*", none.alias("id"))
    seen = r.where("key is not null").select("key", none.alias("code"), "id").unionByName(sides.select("key", "code", "id"))
    keys = seen.groupBy("key").agg(F.min("id").alias("first"), F.count("id").alias("n"), F.min("code").alias("code"))
    keys = keys.select("key", F.coalesce("first", NO_RECORD + F.col("code")).alias("v"), "first", "n", F.col("code").isNotNull().alias("matched"))
    keys = materialize(keys, "keys")
    of = keys.where("matched").select("key", "v")
    edges = m.select("a", "b").distinct().join(of.select(F.col("key").alias("a"), F.col("v").alias("src")), "a").join(of.select(F.col("key").alias("b"), F.col("v").alias("dst")), "b").select("src", "dst")
    roots = components(edges, **grid)
    pages = keys.where("n > 0").select("key", "v", "first", "n").join(roots.withColumnRenamed("id", "v"), "v", "left").select("key", F.coalesce("root", "v").alias("root"), "first", "n")
    pages = materialize(pages, "pages")
    groups = pages.groupBy("root").agg(F.min("first").alias("group_id"), F.sum("n").alias("n_members")).where("n_members > 1")
    linked = pages.join(groups, "root").select("key", "group_id", "n_members")
    return r.join(linked, "key", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_members", F.lit(1).cast("long")).alias("n_members"))
