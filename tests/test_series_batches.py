"""Batches of a series on scales of their own."""

import duckdb

from strandline.plans import core_queries

SF = "/root/testdata/sf0.01"


def test_overlap_stitched_recovers_the_series(spark):
    """A batch's scale cancels out wherever batches share three days: the series comes back on the scale of its first batch."""
    got = {(r.event_type, r.d): r.v for r in core_queries()["overlap_stitched"](spark, SF).collect()}
    rows = duckdb.sql(f"select event_type, cast(ts as date) as d, sum(value) as v from '{SF}/events.parquet' group by all").fetchall()
    assert got.keys() == {(t, d) for t, d, _ in rows}
    for t in {t for t, _, _ in rows}:
        of = {d: v for k, d, v in rows if k == t}
        top = max(v for d, v in of.items() if (d - min(of)).days < 12)
        assert (max(of) - min(of)).days >= 19  # three batches
        assert all(abs(got[t, d] - 100 * v / top) < 1e-3 * max(1, abs(got[t, d])) for d, v in of.items())
