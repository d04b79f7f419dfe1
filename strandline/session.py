"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: list[tuple[SparkSession, str]] = []


def build_session(app: str = "strandline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once per application."""
    key = spark.sparkContext.applicationId
    if key not in _SHIPPED:
        _SHIPPED.add(key)
        here = Path(__file__).resolve().parent
        made = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="strandline-")) / "strandline"), "zip", here.parent, here.name)
        spark.sparkContext.addPyFile(made)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) an own folder is made; a cluster without a named folder is an
    error, as each executor would write to its own disk.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN_DIRS:
        _OWN_DIRS[key] = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(_OWN_DIRS[key])
    return _OWN_DIRS[key]


def materialize(df: DataFrame, what: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    Unlike cached blocks, the table survives the loss of executors; unlike
    ``checkpoint()`` it is columnar, compressed and prunable.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandline/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing will read again."""
    if path := getattr(df, "_strandline_path", None):
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that :func:`materialize` writes inside are deleted at the end, so results must be written or read before it."""
    before = {path for _, path in _WRITTEN}
    try:
        yield
    finally:
        for spark, path in [x for x in _WRITTEN if x[1] not in before]:
            _delete(spark, path)
            _WRITTEN.remove((spark, path))


@atexit.register
def _release_all() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM has gone first
            return
