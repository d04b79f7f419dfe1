"""Writers: partitioned, idempotent, and reports. Existing data are replaced by whole partitions or new versions, never edited."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_daily(df: DataFrame, path: str, ts: str, fmt: str = "parquet") -> None:
    """Rows under year=/month=/day= of their time."""
    df.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)}).write.partitionBy("year", "month", "day").mode("append").format(fmt).save(path)


def split_by_key(df: DataFrame, path: str, key: str, skip: list[str] | None = None, unknown: str = "unknown", least: Column | None = None) -> None:
    """One folder per trimmed lower-case key as JSON lines; NULL and blank keys are ``unknown``, keys to skip are left out."""
    k = F.coalesce(F.nullif(F.lower(F.trim(key)), F.lit("")), F.lit(unknown))
    out = df.withColumn("by_type", k).where(~k.isin(skip or [])) if skip else df.withColumn("by_type", k)
    (out if least is None else out.where(least)).write.partitionBy("by_type").mode("overwrite").json(path)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """The partitions that occur in ``df`` are replaced, all others stay: an upsert by model, window or day."""
    df.write.partitionBy(*keys).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_missing(df: DataFrame, path: str) -> None:
    """Written only if nothing is there yet."""
    df.write.mode("ignore").parquet(path)


def tee(df: DataFrame, whole: str, kept: str, condition: Column) -> None:
    """All rows and those that pass, from one computation."""
    df.write.mode("overwrite").parquet(whole)
    df.sparkSession.read.parquet(whole).where(condition).write.mode("overwrite").parquet(kept)


def write_both(df: DataFrame, path: str) -> None:
    """Parquet and CSV; arrays become text with semicolons."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.sparkSession.read.parquet(f"{path}.parquet").select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def patched(old: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A new version of ``old`` with the patch's values where it has any."""
    p = patch.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns))
    return old.join(p, F.col(key) == F.col("__k"), "left").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns}).select(*old.columns)


def run_report(before: DataFrame, after: DataFrame, size: str) -> DataFrame:
    """One row: counts, reduction in percent, and how many groups have 1, 2-3, 4-5 or more members."""
    n = before.agg(F.count("*")).first()[0]
    b = lambda lo, hi: F.count_if((F.col(size) >= lo) & (F.col(size) <= hi))
    return after.agg(F.lit(n).alias("n_before"), F.count("*").alias("n_after"), F.round(F.when(F.lit(n) > 0, 100.0 * (n - F.count("*")) / max(n, 1)), 2).alias("reduction_pct"), b(1, 1).alias("size_1"), b(2, 3).alias("size_2_3"), b(4, 5).alias("size_4_5"), b(6, 1 << 60).alias("size_6_plus"))


def without_internal(df: DataFrame) -> DataFrame:
    """Columns that begin with an underscore are for the pipeline only."""
    return df.select(*(c for c in df.columns if not c.startswith("_")))


def append_csv(df: DataFrame, path: str, ts: str) -> None:
    """Rows as CSV under day=YYYYMMDD; every file carries the header, which readers drop."""
    df.withColumn("day", F.date_format(ts, "yyyyMMdd")).write.partitionBy("day").mode("append").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with NULL fields kept; dates and other types as text, letters as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_new_partitions(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Only partitions that are not there yet are written; what is there stays as it is. Gives the whole table."""
    spark, shape = df.sparkSession, df.schema
    try:
        have = spark.read.schema(shape).parquet(path).select(*(F.col(k).cast("string").alias(f"__h_{k}") for k in keys)).distinct()
        on = F.lit(True)
        for k in keys:
            on = on & (F.col(k).cast("string") == F.col(f"__h_{k}"))
        df = df.join(have, on, "left_anti")
    except AnalysisException as e:  # nothing there
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.partitionBy(*keys).mode("append").parquet(path)
    return spark.read.schema(shape).parquet(path)


def _files(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), top


def file_by_date(spark: SparkSession, root: str) -> int:
    """Move files with YYYYMMDD in their names into YYYY/MM/DD below ``root``; how many moved. Files that are there already are left."""
    jvm, files, top = _files(spark, root)
    moved = 0
    for s in files.listStatus(top):
        m = re.search(r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)", s.getPath().getName())
        if s.isFile() and m:
            to = jvm.org.apache.hadoop.fs.Path(f"{root}/{m[1]}/{m[2]}/{m[3]}")
            files.mkdirs(to)
            moved += bool(files.rename(s.getPath(), jvm.org.apache.hadoop.fs.Path(to, s.getPath().getName())))
    return moved


def drop_intermediates(spark: SparkSession, root: str, final: str, intermediate: list[str]) -> list[str]:
    """Delete the intermediate files of the days whose final file is there; ``{day}`` in the names stands for YYYYMMDD. Gives what was deleted."""
    jvm, files, top = _files(spark, root)
    names = {s.getPath().getName() for s in files.listStatus(top)}
    pattern = re.compile(re.escape(final).replace(re.escape("{day}"), r"(\d{8})") + "$")
    done = [m[1] for n in names if (m := pattern.match(n))]
    gone = [t.format(day=d) for d in sorted(done) for t in intermediate if t.format(day=d) in names]
    for n in gone:
        files.delete(jvm.org.apache.hadoop.fs.Path(top, n), True)
    return gone


def text_report(sections: dict[str, DataFrame], most: int = 50) -> str:
    """Tables one below the other as text: the first ``most`` rows of each, in their own order."""
    out = []
    for title, df in sections.items():
        rows = [[("" if v is None else str(v)) for v in r] for r in df.limit(most).collect()]
        wide = [max(len(c), *(len(r[i]) for r in rows), 0) for i, c in enumerate(df.columns)]
        line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, wide, strict=True)).rstrip()  # noqa: B023, E731
        out += [title, "=" * len(title), line(df.columns), line(["-" * w for w in wide]), *map(line, rows), ""]
    return "\n".join(out)


def workbook(sections: dict[str, DataFrame], most: int = 100_000) -> bytes:
    """A workbook with a sheet per table, up to ``most`` rows each, for reports; larger tables belong in Parquet."""
    cell = lambda v: f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' if v is not None else "<c/>"
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    n = range(1, len(sections) + 1)
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{"".join(f"""<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>""" for i in n)}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{"".join(f"""<sheet name={quoteattr(t[:31])} sheetId="{i}" r:id="r{i}"/>""" for i, t in zip(n, sections, strict=True))}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"""<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>""" for i in n)}</Relationships>',
    }
    for i, df in zip(n, sections.values(), strict=True):
        rows = [df.columns, *df.limit(most).collect()]
        parts[f"xl/worksheets/sheet{i}.xml"] = f'{head}<worksheet xmlns="{main}"><sheetData>{"".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()
