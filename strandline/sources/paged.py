"""Paged services as a Spark data source: partitions are windows of dates, rows come page by page, pages are kept."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from hashlib import sha1
from importlib import import_module

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Unauthorized(Exception):
    """A fetcher raises this where the service wants a new token."""


class Window(InputPartition):
    def __init__(self, start: date, end: date):
        self.start, self.end = start, end


def page_digest(start: date, end: date, page: int) -> str:
    return sha1(json.dumps({"start": str(start), "end": str(end), "page": page}, sort_keys=True).encode()).hexdigest()


def named(path: str) -> Callable:
    """The function that ``module:name`` stands for, looked up where it is used."""
    module, _, name = path.partition(":")
    return getattr(import_module(module), name)


def with_retries(call: Callable[[], list], tries: int = 4, pause: float = 0.5, renew: Callable[[], None] | None = None) -> list:
    """``call``'s result; a failure is repeated after doubling pauses, a refusal once with new credentials."""
    renewed = False
    for i in range(tries):
        try:
            return call()
        except Unauthorized:
            if renew is None or renewed:
                raise
            renew()
            renewed = True
        except OSError:
            if i == tries - 1:
                raise
            time.sleep(pause * 2**i)
    return call()


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, or of a plain local path."""
    bare = path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path
    return (fs.LocalFileSystem(), bare) if "://" not in bare else fs.FileSystem.from_uri(path)


class Cache:
    """Pages by digest in a folder of any file system; one that can't be read is thrown away and asked for again."""

    def __init__(self, folder: str):
        self.files, self.at = file_system(folder)

    def get(self, key: str) -> list | None:
        path = f"{self.at}/{key}.json"
        try:
            with self.files.open_input_stream(path) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None
        except ValueError:
            self.files.delete_file(path)
            return None

    def put(self, key: str, rows: list) -> None:
        self.files.create_dir(self.at, recursive=True)
        temporary = f"{self.at}/.{key}.{time.time_ns()}"
        with self.files.open_output_stream(temporary) as f:
            f.write(json.dumps(rows, default=str).encode())
        self.files.move(temporary, f"{self.at}/{key}.json")  # readers never see half a page


class PagedReader(DataSourceReader):
    """Pages of each window, from 1 up to the first empty one: from the cache, else from the fetcher, whose pages are then kept."""

    def __init__(self, options: dict, schema):
        self.o, self.names = options, [f.name for f in schema.fields]

    def partitions(self) -> list[Window]:
        a, b, n = date.fromisoformat(self.o["start"]), date.fromisoformat(self.o["end"]), int(self.o.get("days", "30"))
        return [Window(a + timedelta(i), min(b, a + timedelta(i + n - 1))) for i in range(0, (b - a).days + 1, n)]

    def read(self, partition: Window) -> Iterator[tuple]:
        cache, fetch = Cache(self.o["folder"]), named(self.o["fetch"]) if "fetch" in self.o else None
        token = [named(self.o["token"])()] if "token" in self.o else [None]

        def renew() -> None:
            token[0] = named(self.o["token"])()

        page = 1
        while True:
            key = page_digest(partition.start, partition.end, page)
            rows = cache.get(key)
            if rows is None and fetch is not None:
                rows = with_retries(lambda: fetch(partition.start, partition.end, page, token[0]), pause=float(self.o.get("pause", "0.5")), renew=renew if "token" in self.o else None)  # noqa: B023
                cache.put(key, rows)
            if not rows:
                return
            for r in rows:
                yield tuple(None if r.get(n) is None else str(r[n]) for n in self.names)
            page += 1


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``; format ``paged``.

    Options: ``folder`` of kept pages, shared by all executors; ``start``, ``end``, ``days`` of a window; ``columns``; ``fetch``, the
    ``module:function`` that takes (start, end, page, token) and gives a list of dicts; ``token``, one that gives credentials.
    Without ``fetch`` only kept pages are read.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return ", ".join(f"`{c.strip()}` string" for c in self.options["columns"].split(","))

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options, schema)
