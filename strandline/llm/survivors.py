"""One surviving record per duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for no value, as they are after tidy().
NO_VALUE = ["", "-", "?", "n a", "na", "nan", "null", "none", "nil", "unknown", "not specified", "not stated", "unspecified", "undefined", "tbd"]
# Number words.
UNITS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), 1)}
SCALES = {"hundred": 100, "thousand": 1000, "k": 1000, "million": 1_000_000, "m": 1_000_000}


def tidy(c: Column) -> Column:
    """Lower case; underscores, hyphens, points and slashes as spaces; single spaces; texts for no value as NULL."""
    t = F.trim(F.regexp_replace(F.lower(c.cast("string")), r"[\s\u00a0_\-./,;:]+", " "))
    return F.when(~t.isin(NO_VALUE), t)


def fraction(c: Column) -> Column:
    """A confidence as a fraction: numbers over 1 are percent; NULL, NaN and what lies outside count nothing."""
    x = c.cast("double")
    f = F.when(x > 1, x / 100).otherwise(x)
    return F.when((f >= 0) & (f <= 1), f).otherwise(0.0)


def head_count(c: Column) -> Column:
    """The number written, as plain digits: 1,078 or 1 078 or 1078.0 or 2.7k or "two hundred"; no number is NULL."""
    t = F.lower(c.cast("string"))
    joined = F.regexp_replace(t, r"(?<=\d)[,\s\u00a0\u202f'](?=\d{3})", "")
    scale = "|".join(SCALES)
    digits = F.regexp_extract(joined, rf"(\d+(?:\.\d+)?)\s*(?:{scale})?\b", 1)
    after = F.regexp_extract(joined, rf"\d+(?:\.\d+)?\s*({scale})\b", 1)
    pick = lambda word, table, default: F.coalesce(*(F.when(word == w, F.lit(n)) for w, n in table.items()), default)
    number = F.round(F.nullif(digits, F.lit("")).cast("double") * pick(after, SCALES, F.lit(1)), 0).cast("long")
    word = F.regexp_extract(t, rf"\b({'|'.join(UNITS)})\s+(hundred|thousand|million)\b", 1)
    times = F.regexp_extract(t, rf"\b(?:{'|'.join(UNITS)})\s+(hundred|thousand|million)\b", 1)
    spelt = F.when(word != "", (pick(word, UNITS, F.lit(None).cast("int")) * pick(times, SCALES, F.lit(1))).cast("long"))
    return F.coalesce(number, spelt).cast("string")


def _deletes(c: Column) -> Column:
    """The text and all texts with one character less."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))


def canonical(values: DataFrame, column: str, codes: DataFrame, code: str, aliases: str) -> DataFrame:
    """(value, canonical) for the distinct tidy values of ``column``: the code they spell, else themselves.

    A value spells a code if it is the code or an alias, ``... sector`` aside, or one slip away from it: a letter more, less,
    other, or two swapped. Candidates come from an equi-join of both sides' one-letter
    deletions, so values and names are never all compared; of several the nearest,
    then the first in the alphabet, wins.
    """
    names = codes.select(tidy(F.col(code)).alias("canonical"), F.explode(F.array_distinct(F.transform(F.concat(F.array(code), F.coalesce(aliases, F.array().cast("array<string>"))), tidy))).alias("name")).where("name is not null")
    v = values.select(F.col(column).alias("value")).where("value is not null").distinct().withColumn("bare", F.regexp_replace("value", r" sector$", ""))
    near = v.select("value", "bare", F.explode(_deletes(F.col("bare"))).alias("d")).join(names.select("canonical", "name", F.explode(_deletes(F.col("name"))).alias("nd")), F.col("d") == F.col("nd"))
    steps = F.levenshtein("bare", "name")
    swapped = (F.length("bare") == F.length("name")) & (F.array_sort(F.split("bare", "")) == F.array_sort(F.split("name", "")))
    near = near.withColumn("steps", F.when(steps <= 1, steps).when((steps == 2) & swapped, 1)).where("steps is not null")
    best = near.groupBy("value").agg(F.min(F.struct("steps", "canonical")).alias("b")).select(F.col("value").alias("__v"), "b.canonical")
    return v.select("value").join(best, F.col("value") == F.col("__v"), "left").select("value", F.coalesce("canonical", "value").alias("canonical"))


def latest_delivery(rows: DataFrame, group: str, record: str, version: str) -> DataFrame:
    """Each record of a group once, in its latest delivery; ties go to the largest content."""
    rest = [c for c in rows.columns if c not in (group, record)]
    return rows.groupBy(group, record).agg(F.max_by(F.struct(*rest), F.struct(version, *rest)).alias("__r")).select(group, record, "__r.*")


def field_votes(members: DataFrame, group: str, fields: list[str], trust: Column, when: str | None = None, half_life_days: float | None = None) -> DataFrame:
    """(group, field, value, votes, n): for each value of each field how much its members back it.

    A member's vote is its trust times a decay that halves every ``half_life_days`` before the latest day on which any
    member of its group has a value of the field, so however old a group is, its newest value counts in full.
    Members without a day count as old as the oldest that has one. Trust is summed as decimals per value and
    day, and days are added up in their order, so equal backing ties exactly. Without half-life all members count by
    trust alone. NULL values are no votes; values nobody trusts still come out, with 0.
    """
    cells = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)), lambda x: x["value"].isNotNull())
    day = F.unix_date(F.col(when).cast("date")) if half_life_days else F.lit(0)
    long = members.select(group, F.coalesce(trust, F.lit(0.0)).cast("decimal(18,9)").alias("__vote"), day.alias("__day"), F.explode(cells).alias("__c"))
    if not half_life_days:
        return long.groupBy(group, "__c.field", "__c.value").agg(F.sum("__vote").alias("votes"), F.count("*").alias("n"))
    daily = long.groupBy(group, "__c.field", "__c.value", "__day").agg(F.sum("__vote").cast("double").alias("__t"), F.count("*").alias("__n"))
    span = daily.groupBy(F.col(group).alias("__g"), F.col("field").alias("__f")).agg(F.max("__day").alias("__last"), F.min("__day").alias("__first"))
    aged = daily.join(span, F.col(group).eqNullSafe(F.col("__g")) & (F.col("field") == F.col("__f")))
    age = F.coalesce(F.col("__last") - F.coalesce("__day", "__first"), F.lit(0)).alias("age")
    by_age = F.array_sort(F.collect_list(F.struct(age, F.col("__t").alias("t"))))  # an entry per day at most
    total = F.aggregate(by_age, F.lit(0.0), lambda s, x: s + x["t"] * F.pow(F.lit(0.5), x["age"] / half_life_days))
    return aged.groupBy(group, "field", "value").agg(total.alias("votes"), F.sum("__n").alias("n"))


def winners(votes: DataFrame, group: str) -> DataFrame:
    """(group, field, value, votes, n_values): the best backed value; ties go to more members, then the smaller text."""
    best = F.min_by(F.struct("value", "votes"), F.struct(-F.col("votes"), -F.col("n"), "value"))
    return votes.groupBy(group, "field").agg(best.alias("b"), F.count("*").alias("n_values")).select(group, "field", "b.value", "b.votes", "n_values")


def survivors(won: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """One row per group: the winning value of each field, and the fields whose members truly differ."""
    cols = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    clash = F.array_sort(F.collect_set(F.when(F.col("n_values") > 1, F.col("field"))))  # no more entries than fields
    return won.groupBy(group).agg(*cols, clash.alias("conflicted_fields"))
