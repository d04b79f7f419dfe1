"""Fetching pages and looking up places: what goes to a service goes through a function the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes kept of a head and of a whole page.
HEAD_BYTES, PAGE_BYTES = 256 * 1024, 1024 * 1024


def _capped(chunks: Iterator[bytes], most: int, until: bytes | None) -> bytes:
    got = b""
    for c in chunks:
        got += c
        if until and (at := got.lower().find(until)) >= 0:
            return got[: at + len(until)][:most]
        if len(got) >= most:
            break
    return got[:most]


def fetch_pages(urls: DataFrame, column: str, get: Callable[[str], Iterator[bytes]], head: bool = True, in_flight: int = 40) -> DataFrame:
    """(url, content, error) of each distinct URL: a head up to ``</head>``, or a whole page, within its cap of bytes.

    ``get`` gives a page's bytes in chunks; ``in_flight`` of them run at once in a task. A page that fails has its error as text and
    no content. NULL URLs are left out. Spark's own flow of batches takes the place of queues between fetching and writing.
    """
    most, until = (HEAD_BYTES, b"</head>") if head else (PAGE_BYTES, None)

    def one(u: str) -> tuple[str, bytes | None, str | None]:
        try:
            return u, _capped(get(u), most, until), None
        except Exception as e:  # whatever the caller's function meets
            return u, None, f"{type(e).__name__}: {e}"[:300]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for pdf in parts:
                for k in range(0, len(pdf), 500):  # bounded bytes in hand
                    yield pd.DataFrame(list(pool.map(one, pdf.url[k : k + 500])), columns=["url", "content", "error"])

    return urls.select(F.col(column).alias("url")).where("url is not null").distinct().mapInPandas(run, "url string, content binary, error string")


def cached_lookup(keys: DataFrame, column: str, resolve: Callable[[list[str]], list[tuple | None]], cache: str) -> DataFrame:
    """(key, lat, lon, name) of each distinct key: from the cache, a Parquet folder, else from ``resolve``, whose answers are kept.

    Keys that nothing is found for are kept with NULLs, so they are not asked for again. Answers may be (lat, lon), or (lat, lon, name).
    """
    spark = keys.sparkSession
    want = keys.select(F.col(column).alias("key")).where("key is not null").distinct()
    shape = "key string, lat double, lon double, name string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            asked = pdf.key.tolist()
            rows = [(k, *(tuple(a) + (None,) * 3 if a else (None,) * 3)[:3]) for k, a in zip(asked, resolve(asked), strict=True)]
            yield pd.DataFrame(rows, columns=["key", "lat", "lon", "name"])

    try:
        have = spark.read.schema(shape).parquet(cache)
        new = want.join(have.select("key"), "key", "left_anti")
    except AnalysisException as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = want
    new.mapInPandas(run, shape).write.mode("append").parquet(cache)
    kept = spark.read.schema(shape).parquet(cache).groupBy("key").agg(F.max(F.struct("lat", "lon", "name")).alias("a"))
    return want.join(kept, "key").select("key", "a.*")


def legacy_entry(value: Column) -> Column:
    """A cache entry of an older form, a JSON list of two or three elements, as (lat, lon, name)."""
    a = F.from_json(value, "array<string>")
    return F.struct(F.try_element_at(a, F.lit(1)).try_cast("double").alias("lat"), F.try_element_at(a, F.lit(2)).try_cast("double").alias("lon"), F.try_element_at(a, F.lit(3)).alias("name"))
