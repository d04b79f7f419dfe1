"""Arrays, maps and parsed JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parse_with_defaults(text: Column, schema: str, defaults: dict[str, object]) -> Column:
    """A struct of ``schema``'s fields from JSON text: unknown keys are dropped, NULL and missing fields take their default,
    and text that is no JSON object gives the defaults alone.
    """
    fields = StructType.fromDDL(schema)
    got = F.from_json(text, fields)
    return F.struct(*(F.coalesce(got[f.name], F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name) for f in fields))


def expanded(df: DataFrame, struct: str) -> DataFrame:
    """The fields of a struct as columns, in place of columns of their names; texts in lower case and trimmed, lists of texts cleaned."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema[struct].dataType}
    low = lambda c: F.lower(F.trim(c))
    of = {n: low(F.col(struct)[n]) if t == "string" else clean_list(F.col(struct)[n]) if t == "array<string>" else F.col(struct)[n] for n, t in kinds.items()}
    return df.withColumns(of).drop(struct)


def clean_list(c: Column) -> Column:
    """Trimmed lower-case texts, blanks left out, each once, in order; NULL is an empty list."""
    low = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(low, lambda x: x.isNotNull() & (x != "")))


def json_list(c: Column) -> Column:
    """A cell that is a JSON list of texts, or a single text, as an array; blank and NULL as an empty one."""
    t = F.trim(c)
    none = F.array().cast("array<string>")
    return F.when(t.isNull() | (t == ""), none).when(F.startswith(t, F.lit("[")), F.coalesce(F.from_json(t, "array<string>"), none)).otherwise(F.array(t))


def is_filled(c: Column, kind: str) -> Column:
    """Whether a field holds something: text that isn't blank, an array or map with entries, any number."""
    if kind == "string":
        return F.coalesce(F.trim(c) != "", F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def overlap(a: Column, b: Column) -> Column:
    """Whether two lists share an element; NULL lists share none."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def actors(lists: list[Column], single: Column) -> Column:
    """All actors that several lists and one field name, each once."""
    all_ = F.concat(*(clean_list(x) for x in lists), clean_list(F.array(single)))
    return F.array_distinct(all_)


def exploded(df: DataFrame, column: str, to: str) -> DataFrame:
    """A row per element; a row without elements stays once, with NULL."""
    return df.withColumn(to, F.explode_outer(column))
