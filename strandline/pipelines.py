"""The layers from a day's news to predictions, each one function over tables; what needs a service takes the caller's function.

Every layer writes Parquet by day and skips what is there, so a run that broke off goes on where it was; missing days are the asked ones less those there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strandline.functions import collections as C
from strandline.functions import pages as P
from strandline.functions import strings as T
from strandline.functions import urls as U
from strandline.functions.dates import asymmetric_tolerance, read_date
from strandline.functions.geo import haversine_km
from strandline.functions.vectors import jaccard
from strandline.operators import dedupe, graph, joins, merge, models
from strandline.operators import panel as W
from strandline.operators.filters import level, url_reason
from strandline.session import materialize, scratch
from strandline.sources import fetching, readers, sinks


@dataclass(frozen=True)
class Filters:
    """What makes an address irrelevant, and a text garbage."""

    extensions: list[str] = field(default_factory=list)
    sections: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    bad_text: list[str] = field(default_factory=list)


def missing_days(spark: SparkSession, out: str, days: list[date]) -> list[date]:
    """The asked days that ``out`` has no folder for."""
    return [d for d in days if not readers.exists(spark, f"{out}/day={d}")]


def retrieve(events: DataFrame, days: list[date], out: str, filters: Filters, get: Callable[[str], Iterator[bytes]] | None = None) -> DataFrame:
    """Layer 1. (day, url, first, reason, title, description, text) of the days' relevant pages.

    events(url, ts): each normalised address once a day, as first seen; those that a rule drops are kept with the reason under
    ``out/deduped``, the rest goes on under ``out/kept``. With ``get`` the heads are fetched and title and description read.
    """
    spark = events.sparkSession
    todo = missing_days(spark, f"{out}/deduped", days)
    e = events.select(U.normalize_url(F.col("url")).alias("url"), "ts", F.col("ts").cast("date").alias("day")).where("url is not null").where(F.col("day").isin(todo) if todo else F.lit(False))
    seen = e.groupBy("day", "url").agg(F.min("ts").alias("first"))
    whole = sinks.write_new_partitions(seen.withColumn("reason", url_reason(F.col("url"), filters.extensions, filters.sections, filters.keywords)), f"{out}/deduped", ["day"])
    kept = whole.where(F.col("day").isin(days) & F.col("reason").isNull())
    none = F.lit(None).cast("string")
    if get:
        pages = fetching.fetch_pages(kept.select("url"), "url", get).select(F.col("url").alias("__u"), P.html_head(F.col("content")).alias("html"))
        kept = kept.join(pages, F.col("url") == F.col("__u"), "left").withColumns({"title": T.html_title(F.col("html")), "description": T.meta_description(F.col("html"))}).drop("__u", "html")
    else:
        kept = kept.withColumns({"title": none, "description": none})
    text = T.build_text(F.col("title"), F.col("description"), U.slug_text(F.col("url")), filters.bad_text)
    return sinks.write_new_partitions(kept.drop("reason").withColumn("text", text), f"{out}/kept", ["day"]).where(F.col("day").isin(days))


#: Fields that an extractor is asked for.
RECORD = "disruption_type string, event_date string, location_name string, duration_hours double, confidence double, event_description string"


def extract(pages: DataFrame, ask: Callable[[str], str], out: str, schema: str = RECORD, in_flight: int = 40) -> DataFrame:
    """Layer 2. Records of pages(day, url, text, expert_type, expert_probability, publish_date): what ``ask`` makes of a text, parsed.

    The expert's type counts where it is sure enough; the date is the event's, else that of publication, with its origin. Answers
    that are no JSON give empty records with the answer kept in ``raw``. Written by day and type.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for pdf in parts:
                yield pdf.assign(raw=list(pool.map(_safely(ask), pdf.text)))

    shape = ", ".join(f"`{n}` {t}" for n, t in pages.dtypes)
    asked = materialize(pages.mapInPandas(run, f"{shape}, raw string"), "answers")  # asked once
    x = C.expanded(asked.withColumn("__e", C.parse_with_defaults(T.json_object(F.col("raw")), schema, {"disruption_type": "unknown"})), "__e")
    event, published = read_date(F.col("event_date")), read_date(F.col("publish_date").cast("string"))
    kind = merge.chosen_type(F.col("expert_type"), F.col("expert_probability"), F.col("disruption_type"))
    x = x.withColumns({"__k": kind, "event_day": F.coalesce(event, published), "date_source": F.when(event.isNotNull(), "event").when(published.isNotNull(), "publish")})
    x = x.withColumns({"disruption_type": F.col("__k.type"), "type_source": F.col("__k.source")}).drop("__k")
    return sinks.write_new_partitions(x, out, ["day"])


def _safely(ask: Callable[[str], str]) -> Callable[[str], str | None]:
    def one(text: str) -> str | None:
        try:
            return ask(text)
        except Exception as e:  # the service's failure is the row's
            return f"{type(e).__name__}: {e}"[:300]

    return one


def consolidate(records: DataFrame, least: float = 0.5, near_km: float = 50.0) -> DataFrame:
    """Records of one happening merged into one row: those of one country and type whose dates are within the tolerance of their
    origins, and whose places share enough words, or lie near each other, directly or in a chain.

    records(record_id, iso3, disruption_type, event_day, date_source, location_name, source_title, url, duration_hours, confidence, lat, lon).
    """
    r = materialize(records.where("record_id is not null").withColumn("t", T.location_tokens(F.col("location_name"))), "records")
    narrow = r.where("event_day is not null and iso3 is not null").select("record_id", "iso3", "disruption_type", "event_day", "date_source", "t", "lat", "lon")
    p = joins.window_pairs(narrow, ["iso3", "disruption_type"], "record_id", "event_day", 3)
    gap = F.abs(F.datediff("a_event_day", "b_event_day"))
    km = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    same = F.coalesce(jaccard(F.col("a_t"), F.col("b_t")) >= least, F.lit(False)) & F.coalesce(km <= near_km, F.lit(True))
    edges = p.where((gap <= asymmetric_tolerance(F.col("a_date_source"), F.col("b_date_source"))) & same).select(F.col("a_record_id").alias("src"), F.col("b_record_id").alias("dst"))
    roots = graph.connected_components(edges)
    m = r.join(roots.withColumnRenamed("id", "record_id"), "record_id", "left").withColumn("event_id", F.coalesce("root", "record_id"))
    return merge.merge_articles(m.withColumn("event_date", F.col("event_day")), "event_id", "record_id")


def enrich(events: DataFrame, key: str, call: Callable[[dict], dict], out: str, retry: bool = True, in_flight: int = 8) -> DataFrame:
    """Layer 3. events(key, day, ...) with ``layers``, the JSON of what ``call`` gives, and ``error`` where it failed; failures are asked for once more.

    A retried event without a date gets that of its day. The table is written in versions, so failed rows alone are asked for again.
    """
    spark = events.sparkSession

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(row: dict) -> tuple[str | None, str | None]:
            try:
                return json.dumps(call(row), default=str), None
            except Exception as e:  # the service's failure is the row's
                return None, f"{type(e).__name__}: {e}"[:300]

        with ThreadPoolExecutor(in_flight) as pool:
            for pdf in parts:
                got = list(pool.map(one, pdf.to_dict("records")))
                yield pdf.assign(layers=[a for a, _ in got], error=[b for _, b in got])

    shape = ", ".join(f"`{n}` {t}" for n, t in events.dtypes) + ", layers string, error string"
    if not readers.exists(spark, f"{out}/version=0"):
        events.mapInPandas(run, shape).write.parquet(f"{out}/version=0")
    whole = StructType([*events.schema.fields, StructField("layers", StringType()), StructField("error", StringType())])
    first = spark.read.schema(whole).parquet(f"{out}/version=0")
    if not retry:
        return first
    if not readers.exists(spark, f"{out}/version=1"):
        failed = first.where("error is not null").drop("layers", "error")
        if "event_date" in failed.columns:
            failed = failed.withColumn("event_date", F.coalesce("event_date", F.col("day").cast(dict(failed.dtypes)["event_date"])))
        again = failed.mapInPandas(run, shape)
        dedupe.upsert(first.where("error is null"), again, [key]).write.parquet(f"{out}/version=1")
    return spark.read.schema(whole).parquet(f"{out}/version=1")


def daily_labels(clusters: DataFrame, entity: str, articles: DataFrame, low: str, high: str, horizon: int = 7) -> DataFrame:
    """Layer 4. (entity, d, today, n_articles, coverage, ahead, next): on the whole grid of entities and days.

    clusters(entity, start, end) mark their days; articles(entity, d, n_articles) tell how well a day is covered.
    """
    marked = W.expand_days(clusters.select(entity, "start", "end"), "start", "end", "d", 60).groupBy(entity, "d").agg(F.lit(1).alias("today"))
    grid = W.spine(articles.select(entity, "d"), [entity], "d", low, high)
    x = grid.join(marked, [entity, "d"], "left").join(articles, [entity, "d"], "left").fillna(0, ["today", "n_articles"])
    w = W.by([entity], "d")
    return x.withColumns({"coverage": level(F.col("n_articles"), [3, 10], ["low", "medium", "high"]), "ahead": W.forward_label(F.col("today"), w, horizon), "next": W.next_label(F.col("today"), w)})


def build_panel(labels: DataFrame, entity: str, layers: list[tuple[DataFrame, list[str]]], lags: tuple[int, ...] = (7, 28), group: str | None = None) -> DataFrame:
    """Layer 5. The labels' grid with each layer joined by its keys, lagged sums of what happened, and what the rest of the group saw."""
    out = labels
    for layer, keys in layers:
        out = out.join(layer, keys, "left")
    w = W.by([entity], "d")
    out = out.withColumns({f"lag_{n}d": F.coalesce(W.lagged_sum(F.col("today"), w, n), F.lit(0)) for n in lags})
    return out.withColumn("others", W.spillover(F.col("today"), [group], "d")) if group else out


def backtest(panel: DataFrame, features: list[str], years: list[int], calibration: str | None = None) -> DataFrame:
    """Scores of a logistic model over walk-forward years of panel(d, ahead, features)."""
    p = panel.withColumn("y", F.col("ahead").cast("int"))
    pred = models.walk_forward(p, "d", features, years, lambda f, n: models.logistic(f, 1.0, n), calibration)
    return models.fold_scores(pred, ["fold"], "p_cal" if calibration else "p")


def run(events: DataFrame, days: list[date], out: str, filters: Filters, ask: Callable[[str], str], call: Callable[[dict], dict], get: Callable[[str], Iterator[bytes]] | None = None) -> dict[str, int]:
    """Layers 1 to 3 over the days, and how many rows each gave; run again it continues."""
    with scratch():
        kept = retrieve(events, days, f"{out}/pages", filters, get)
        none = lambda t: F.lit(None).cast(t)
        pages = kept.withColumns({"expert_type": none("string"), "expert_probability": none("double"), "publish_date": F.col("day").cast("string")})
        records = extract(pages, ask, f"{out}/records")
        done = enrich(records.select("url", "day", "disruption_type", "event_date", "location_name"), "url", call, f"{out}/enriched")
        return {"pages": kept.count(), "records": records.count(), "enriched": done.count(), "failed": done.where("error is not null").count()}
