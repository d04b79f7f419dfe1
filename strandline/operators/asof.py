"""Attributes as they were known at event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.keys import finite
from strandline.operators.cumulative import running

_DAY = 86_400_000_000


def moment(df: DataFrame, column: str, end: bool = False) -> Column:
    """A time as microseconds since 1970-01-01; a date is the first, or with ``end`` the last, of its day's."""
    if dict(df.dtypes)[column] == "date":
        return F.unix_date(column).cast("long") * _DAY + (_DAY - 1 if end else 0)
    return F.unix_micros(F.col(column).cast("timestamp"))


def version_history(releases: DataFrame, entity: str, attribute: str, period: str, released: str, value: str, names: list[str], tiebreak: list[str], bucket_days: int = 366) -> DataFrame:
    """(entity, version, since, <names>): what was known of each attribute from the time ``since`` on.

    Known of an attribute is, of its non-NULL values released so far, that of the latest
    ``period`` in its last release. A release changes one attribute; the others carry over.
    Releases of one microsecond, or of one day where times are dates, make one version. Versions count from 1. Rows without entity,
    release time or value are no releases.
    """
    r = releases.where(F.col(entity).isNotNull() & F.col(released).isNotNull() & finite(F.col(value).cast("double")).isNotNull())
    state = F.struct(F.col(period), F.col(released), *tiebreak, F.col(value).alias("v"))
    each = r.withColumn("__at", moment(r, released)).groupBy(entity, "__at").agg(
        F.min(released).alias("since"), *(F.max(F.when(F.col(attribute) == n, state)).alias(f"__s{i}") for i, n in enumerate(names))
    )
    known = running(
        each, [entity], ["__at"], F.floor(F.col("__at") / (bucket_days * _DAY)),
        {"version": ("sum", F.lit(1))} | {f"__k{i}": ("max", F.col(f"__s{i}")) for i in range(len(names))},
    )
    return known.select(entity, F.col("version").cast("long").alias("version"), "since", *(F.col(f"__k{i}.v").alias(n) for i, n in enumerate(names)))


def with_known(events: DataFrame, versions: DataFrame, entity: str, time: str, names: list[str], prefix: str = "known_", bucket_days: int = 366) -> DataFrame:
    """Add ``prefix + name``: the attributes of the version valid at the event's time.

    An event with a timestamp sees what was released up to its microsecond; one with a date sees what its whole day
    released. Only narrow rows, one per distinct (entity, time), are put in order: the version number of a
    time is the count of changes up to and including it. The wide attributes join on
    entity and number alone. Nothing released later is ever visible. Events before the
    first version, or without entity or time, get NULLs; every event row is kept once,
    with all its columns.
    """
    e, t = F.col(entity), moment(events, time, end=True)
    moments = events.select(e.alias("__e"), t.alias("__t")).where("__e is not null and __t is not null").distinct().withColumn("__n", F.lit(0))
    changes = versions.select(e.alias("__e"), moment(versions, "since").alias("__t")).withColumn("__n", F.lit(1))
    numbered = running(moments.unionByName(changes), ["__e"], ["__t"], F.floor(F.col("__t") / (bucket_days * _DAY)), {"__version": ("sum", F.col("__n"))})
    numbered = numbered.where("__n = 0").drop("__n")
    wide = versions.select(e.alias("__ve"), F.col("version").cast("long").alias("__vv"), *(F.col(n).alias(prefix + n) for n in names))
    dated = numbered.join(wide, (F.col("__e") == F.col("__ve")) & (F.col("__version") == F.col("__vv")), "left").drop("__ve", "__vv", "__version")
    return events.join(dated, (e == F.col("__e")) & (t == F.col("__t")), "left").drop("__e", "__t")
