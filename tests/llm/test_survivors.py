"""Survivorship: votes, ties, spellings, conflicts."""

from pyspark.sql import functions as F

from strandline.llm import survivors as S


def test_values(spark):
    heads = {"1,078": "1078", "1 078": "1078", "1078.0": "1078", "~450": "450", "about 99": "99", "620+": "620", "some 12 people": "12", "2.7k": "2700", "14 thousand": "14000", "two hundred": "200", "4,500 workers": "4500", "several": None, "hundreds": None, "": None, None: None, "?": None, "1,234,567": "1234567"}
    got = spark.createDataFrame([(k,) for k in heads], "t string").select("t", S.head_count(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == heads
    codes = spark.createDataFrame([("banking", ["banks"]), ("ports", ["dock labour"]), ("media", None)], "sector string, aliases array<string>")
    vals = {"Banking": "banking", "bakning": "banking", "baking": "banking", "banks": "banking", "banking sector": "banking", "prots": "ports", "DOCK_LABOUR.": "ports", "meda": "media", "quarry": "quarry", "n/a": None, "": None, None: None}
    v = spark.createDataFrame([(k,) for k in vals], "s string").withColumn("t", S.tidy(F.col("s")))
    m = {r.value: r.canonical for r in S.canonical(v, "t", codes, "sector", "aliases").collect()}
    assert {r.s: m.get(r.t) for r in v.collect()} == vals
    f = spark.createDataFrame([(0.4,), (55.0,), (None,), (float("nan"),), (-1.0,), (400.0,)], "c double").select(S.fraction(F.col("c"))).collect()
    assert [r[0] for r in f] == [0.4, 0.55, 0.0, 0.0, 0.0, 0.0]


def test_votes(spark):
    rows = [("a", 1, "x", 0.3, "2020-01-01"), ("a", 2, "x", 0.6, "2020-01-01"), ("a", 3, "y", 0.9, "2020-03-01"), ("b", 4, None, 0.9, None), ("c", 5, "z", 0.0, None), ("d", 6, "p", 0.2, "2020-01-01"), ("d", 7, "q", 0.5, "2020-01-01")]
    m = spark.createDataFrame(rows, "g string, r int, f string, c double, w string").withColumn("w", F.to_date("w"))
    won = {x.g: (x.value, x.n_values) for x in S.winners(S.field_votes(m, "g", ["f"], F.col("c")), "g").collect()}
    assert won == {"a": ("x", 2), "c": ("z", 1), "d": ("q", 2)}  # 0.3 + 0.6 ties 0.9: more members win
    late = {x.g: x.value for x in S.winners(S.field_votes(m, "g", ["f"], F.col("c"), "w", 30.0), "g").collect()}
    assert late["a"] == "y"
    out = {x.g: x for x in S.survivors(S.winners(S.field_votes(m, "g", ["f"], F.col("c")), "g"), "g", ["f"]).collect()}
    assert out["a"].conflicted_fields == ["f"] and out["c"].conflicted_fields == []
    again = S.latest_delivery(m.union(m).withColumn("v", F.lit(1)), "g", "r", "v")
    assert again.count() == len(rows)
    assert S.winners(S.field_votes(m.limit(0), "g", ["f"], F.col("c"), "w", 30.0), "g").count() == 0


def test_old_groups_still_count_recency(spark):
    """Ages count from a group's own newest value of the field, so votes of years ago don't vanish."""
    rows = [
        ("old", 1, "x", 0.5, "2001-01-01"), ("old", 2, "x", 0.4, "2001-01-01"), ("old", 3, "y", 0.6, "2001-03-02"), ("new", 4, "p", 0.9, "2021-01-01"), ("new", 5, None, 0.9, "2024-01-01"),
        ("new", 6, "q", 0.8, "2021-01-01"), ("none", 7, "a", 0.2, None), ("none", 8, "b", 0.3, None), ("some", 9, "a", 0.9, None), ("some", 10, "b", 0.4, "2020-02-01"), ("some", 11, "b", 0.1, "2020-01-02"),
        (None, 12, "z", 0.3, "2020-01-01"), (None, 13, "w", 0.2, "2020-01-01"),
    ]
    m = spark.createDataFrame(rows, "g string, r int, f string, c double, w string").withColumn("w", F.to_date("w"))
    votes = {(x.g, x.value): x.votes for x in S.field_votes(m, "g", ["f"], F.col("c"), "w", 30.0).collect()}
    assert votes["old", "y"] == 0.6 and abs(votes["old", "x"] - 0.9 / 4) < 1e-12 and votes["new", "p"] == 0.9 and votes["none", "b"] == 0.3
    assert abs(votes["some", "a"] - 0.45) < 1e-12 and abs(votes["some", "b"] - 0.45) < 1e-12
    won = {x.g: x.value for x in S.winners(S.field_votes(m, "g", ["f"], F.col("c"), "w", 30.0), "g").collect()}
    assert won == {"old": "y", "new": "p", "none": "b", "some": "b", None: "z"}
