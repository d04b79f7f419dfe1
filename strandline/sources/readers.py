"""Readers of the formats the pipeline meets. All are lenient: what can't be read is NULL or counted, never an error."""

from __future__ import annotations

import csv
import functools
import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The columns kept of an event export, with their positions in a row; negative ones count from the end.
EVENT_COLUMNS = {
    "globaleventid": 0, "sqldate": 1, "eventcode": 26, "eventbasecode": 27, "eventrootcode": 28, "quadclass": 29, "nummentions": 31, "numsources": 32, "numarticles": 33, "avgtone": 34,
    "actiongeo_fullname": -9, "actiongeo_countrycode": -8, "actiongeo_adm1code": -7, "actiongeo_adm2code": -6, "actiongeo_lat": -5, "actiongeo_lon": -4, "actiongeo_featureid": -3, "dateadded": -2, "sourceurl": -1,
}


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if gone := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(gone)}")
    return df


def coalesce_columns(df: DataFrame, names: list[str]) -> Column:
    """The first of several candidate columns that exists, NULL if none does."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def clean_header(df: DataFrame) -> DataFrame:
    """Column names trimmed and in lower case, without byte order mark."""
    return df.toDF(*(c.lstrip("\ufeff").strip().lower() for c in df.columns))


def read_table(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, schema: StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    """CSV, TSV, Parquet or JSON lines by suffix. ``columns`` must be there, and only they are read; header names are compared as
    :func:`clean_header` leaves them, so a byte order mark or blanks around a name don't matter.
    """
    first = path if isinstance(path, str) else path[0]
    kind = Path(first.rstrip("/*")).suffix.lower()
    if kind in (".csv", ".tsv", ".txt"):
        r = spark.read.option("header", True).option("sep", "\t" if kind == ".tsv" else ",").option("multiLine", True).option("escape", '"').option("encoding", encoding)
        df = clean_header(r.schema(schema).csv(path) if schema else r.csv(path))
    elif kind == ".parquet":
        df = spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)
    elif kind in (".jsonl", ".json", ".ndjson"):
        df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    else:
        raise ValueError(f"no reader for {kind or first}")
    return require_columns(df, columns).select(*columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_first(spark: SparkSession, paths: list[str], evict: bool = True) -> DataFrame:
    """The first of several files, in any format, that is there and can be read; one that can't is deleted unless ``evict`` is False."""
    for path in paths:
        if not exists(spark, path):
            continue
        try:
            df = read_table(spark, path)
            df.limit(1).collect()  # the footer or first lines are sound
            return df
        except Exception:
            if evict:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    raise FileNotFoundError(", ".join(paths))


def registry(text: str) -> dict[str, str]:
    """``{alias: code}`` of a YAML text of plain pairs: quotes and comments dropped, nested keys joined by points."""
    out, above = {}, []
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not bare.strip() or bare.strip() == "---":
            continue
        depth = len(bare) - len(bare.lstrip())
        above = [(n, k) for n, k in above if n < depth]
        key, _, value = bare.strip().partition(":")
        key, value = key.strip().strip("'\""), value.strip().strip("'\"")
        if value:
            out[".".join([*(k for _, k in above), key])] = value
        else:
            above.append((depth, key))
    return out


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(content: bytes, sheet: int | str = 0) -> list[list[str | None]]:
    """The cells of a workbook's sheet as text, by number or name; gaps are NULL."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS)]
        n = sheet if isinstance(sheet, int) else names.index(sheet)
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{n + 1}.xml")).iterfind("m:sheetData/m:row", _NS):
            cells: dict[int, str | None] = {}
            for c in row.iterfind("m:c", _NS):
                letters = re.match(r"[A-Z]*", c.get("r") or "").group()
                at = functools.reduce(lambda k, x: k * 26 + ord(x) - 64, letters, 0) - 1 if letters else len(cells)
                v, inline = c.find("m:v", _NS), c.find("m:is", _NS)
                text = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else v.text if v is not None else None
                cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return rows


def read_workbook(spark: SparkSession, path: str, columns: list[str], sheet: int | str = 0, skip: int = 0) -> DataFrame:
    """The named columns of a sheet of each workbook under ``path``, as text; the header is the sheet's row ``skip`` + 1. A workbook is one task's
    work, as the format is not splittable; workbooks that can't be opened give no rows.
    """

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for raw in pdf.content:
                try:
                    rows = sheet_rows(raw, sheet)[skip:]
                except (zipfile.BadZipFile, KeyError, ValueError, IndexError):
                    continue
                head = [str(h or "").strip().lower() for h in rows[0]] if rows else []
                at = [head.index(c) if c in head else None for c in columns]
                cell = lambda r, i: r[i] if i is not None and i < len(r) else None
                yield pd.DataFrame([[cell(r, i) for i in at] for r in rows[1:]], columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, ", ".join(f"`{c}` string" for c in columns))


def read_json_lines(spark: SparkSession, paths: str | list[str], schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): blank lines are skipped, lines that are no JSON come out as text."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    parsed = lines.select("value", F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return parsed.where(~bad).select(*(F.col(f"r.`{f.name}`") for f in schema.fields)), parsed.where(bad).select("value")


def read_csv_dropping_malformed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.option("header", True).option("mode", "DROPMALFORMED").schema(schema).csv(path)


def matching_columns(names: list[str], wanted: dict[str, list[str]]) -> dict[str, str]:
    """For each wanted name the first header that holds any of its words, in lower case: headers that are spelt a little otherwise each year."""
    low = {n: re.sub(r"[^a-z0-9]+", " ", n.lower()).strip() for n in names}
    return {to: hit for to, words in wanted.items() if (hit := next((n for w in words for n in names if w in low[n]), None))}


def read_csv_with_preamble(spark: SparkSession, path: str, skip: int, encoding: str = "UTF-8", wanted: dict[str, list[str]] | None = None) -> DataFrame:
    """CSVs whose header is their line ``skip`` + 1; rows that are empty throughout are dropped.

    Every file is read by its own header, so columns may stand in another order or be missing; the columns of all files come out, trimmed and in lower case,
    or with ``wanted`` those that :func:`matching_columns` finds in each file. Headers are read from the files' first 64 kB; a file is one task's work.
    """
    files = spark.read.format("binaryFile").load(path)
    decoded = lambda raw: raw.decode(encoding, "replace").lstrip("\ufeff")
    header = lambda text: [h.strip().lower() for h in next(csv.reader(text.splitlines()[skip : skip + 1]), [])]
    if wanted:
        columns = list(wanted)
    else:
        heads = files.select(F.substring("content", 1, 65536).alias("h"))

        def names(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                yield pd.DataFrame([(i, h) for raw in pdf.h for i, h in enumerate(header(decoded(raw))) if h], columns=["i", "name"])

        found = heads.mapInPandas(names, "i int, name string").groupBy("name").agg(F.min("i").alias("i")).orderBy("i", "name").collect()  # a row per column
        columns = [r.name for r in found]

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for raw in pdf.content:
                lines = csv.reader(io.StringIO("\n".join(decoded(raw).splitlines()[skip:])))
                head = [h.strip().lower() for h in next(lines, [])]
                own = {c: head.index(h) for c, h in (matching_columns(head, wanted) if wanted else {h: h for h in head}).items()}
                for rows in iter(lambda: list(itertools.islice(lines, 50_000)), []):  # noqa: B023
                    rows = [r for r in rows if any(x.strip() for x in r)]
                    cell = lambda r, c: (r[own[c]] or None) if c in own and own[c] < len(r) else None  # noqa: B023, E731
                    yield pd.DataFrame([[cell(r, c) for c in columns] for r in rows], columns=columns, dtype=object)

    if not columns:
        return spark.createDataFrame([], "value string").drop("value")
    return files.select("content").mapInPandas(parse, ", ".join(f"`{c}` string" for c in columns))


def parse_file_list(lines: DataFrame) -> DataFrame:
    """(size, digest, url, ts) of a master list's lines: three fields or more, the first a number; others are skipped."""
    f = F.split(F.trim("value"), r"\s+")
    x = lines.select(F.try_element_at(f, F.lit(1)).try_cast("bigint").alias("size"), F.try_element_at(f, F.lit(2)).alias("digest"), F.try_element_at(f, F.lit(3)).alias("url"))
    return x.where("size is not null and url is not null").withColumn("ts", file_time(F.col("url")))


def file_time(url: Column) -> Column:
    """The 14-digit time in a file's name."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(url, r"/(\d{14})\.", 1), F.lit("")), F.lit("yyyyMMddHHmmss"))


def files_of_day(files: DataFrame, day: date, suffix: str) -> DataFrame:
    return files.where(F.endswith(F.lower("url"), F.lit(suffix.lower())) & (F.to_date("ts") == F.lit(day))).orderBy("ts")


def parse_event_lines(lines: DataFrame, column: str = "value", ingest: Column | None = None) -> DataFrame:
    """The kept columns of headerless, ragged, tab-separated rows, all as text, and ``ingest_time`` where it is given.

    Rows of fewer than ten fields, and those without the address of a source, are dropped.
    """
    f = F.split(column, "\t")
    at = lambda k: F.try_element_at(f, F.lit(k + 1 if k >= 0 else k))
    more = [ingest.alias("ingest_time")] if ingest is not None else []
    return lines.where(F.size(f) >= 10).select(*(at(k).alias(n) for n, k in EVENT_COLUMNS.items()), *more).where(F.trim("sourceurl") != "")


def read_zipped_events(spark: SparkSession, path: str) -> DataFrame:
    """Event rows of zip archives with the time in the archive's name; archives that can't be opened give none."""

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for file, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in z.namelist():
                            with z.open(name) as f:
                                for chunk in iter(lambda: f.readlines(1 << 22), []):  # noqa: B023
                                    yield pd.DataFrame({"path": file, "value": [x.decode("utf-8", "replace").rstrip("\r\n") for x in chunk]})
                except zipfile.BadZipFile:
                    continue

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "path string, value string")
    return parse_event_lines(rows, "value", file_time(F.col("path")))


def read_by_country_and_year(spark: SparkSession, root: str, years: list[int] | None = None) -> DataFrame:
    """Parquet under iso3=XXX/YYYY.parquet or iso3=XXX/year=YYYY.parquet: the year is in the file's name, so it is read from there."""
    df = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(root)
    df = df.withColumn("year", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})\.parquet$", 1).try_cast("int"))
    return df.where(F.col("year").isin(years)) if years else df


def daily_paths(template: str, start: date, end: date, spark: SparkSession | None = None) -> list[str]:
    """Paths of each day of a closed range; ``{day}`` stands for YYYYMMDD. With a session only those that are there."""
    paths = [template.format(day=f"{start + timedelta(i):%Y%m%d}") for i in range((end - start).days + 1)]
    return [p for p in paths if exists(spark, p)] if spark else paths


def overlaps_range(name: Column, start: str, end: str) -> Column:
    """Whether YYYYMMDD or YYYYMMDD_YYYYMMDD in a file's name overlaps the closed range."""
    a = F.regexp_extract(name, r"(\d{8})(?:_\d{8})?", 1)
    b = F.regexp_extract(name, r"\d{8}_(\d{8})", 1)
    return (a != "") & (a <= end) & (F.coalesce(F.nullif(b, F.lit("")), a) >= start)


def only_needed(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is needed; the optimizer turns small key sets into a filter at the scan."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def word_list(path: str) -> list[str]:
    """Lines of a configuration file; blank ones and comments are skipped."""
    return [x.strip() for x in Path(path).read_text().splitlines() if x.strip() and not x.lstrip().startswith("#")]
