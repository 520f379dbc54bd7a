"""Object stores that list page by page, as Spark data sources.

    register(spark)
    spark.read.format("objects").option("path", folder).load()            # key, size, modified, metadata
    spark.readStream.format("objects").option("path", folder).load()      # what arrives
    spark.read.format("cells").option("path", folder).load()              # key, sheet, row_idx, col_idx, raw, kind

A store is any class with the methods of :class:`FolderStore`; the option ``store`` names it
as ``module:class`` and is given the option ``path``. Its prefixes are the partitions: each is
listed by a task of its own, a page at a time, so neither the driver nor a task holds a whole
listing. Filters on ``key`` (equality, ``startswith``, where the session pushes filters to
Python sources) and the option ``prefix`` leave prefixes out before anything is listed. A
stream's offset is a time: a batch lists what was changed since the batch before.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from tidewell.functions.text import percent_decode

OBJECTS = "key string, size long, modified long, metadata map<string,string>"
CELLS = "key string, sheet string, row_idx int, col_idx int, raw string, kind string"
#: Keys of a page, and prefixes of a partition.
PAGE, PREFIXES = 1000, 8

_OBJECT = pa.schema([("key", pa.string()), ("size", pa.int64()), ("modified", pa.int64()), ("metadata", pa.map_(pa.string(), pa.string()))])
_CELL = pa.schema([("key", pa.string()), ("sheet", pa.string()), ("row_idx", pa.int32()), ("col_idx", pa.int32()), ("raw", pa.string()), ("kind", pa.string())])

#: Metadata of an object beside it, where a store has none of its own.
SIDECAR = ".metadata.json"


class FolderStore:
    """Files below a folder; a prefix is a folder at the top, '' the files beside them."""

    def __init__(self, path: str):
        if "://" in path:
            self.files, self.root = pyarrow.fs.FileSystem.from_uri(path)
        else:
            self.files, self.root = pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")
        self.root = self.root.rstrip("/")

    def _listed(self, folder: str, recursive: bool) -> list[pyarrow.fs.FileInfo]:
        return self.files.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True, recursive=recursive))

    def prefixes(self) -> list[str]:
        return ["", *sorted(i.base_name + "/" for i in self._listed(self.root, False) if i.type == pyarrow.fs.FileType.Directory)]

    def page(self, prefix: str, after: str | None, most: int) -> list[tuple[str, int, int, dict[str, str]]]:
        """Up to ``most`` objects (key, size, milliseconds, metadata) of a prefix, in order of keys, beyond the key ``after``."""
        found = [i for i in self._listed(f"{self.root}/{prefix}".rstrip("/"), bool(prefix)) if i.type == pyarrow.fs.FileType.File and not i.base_name.endswith(SIDECAR)]
        keyed = sorted((i.path[len(self.root) + 1 :], i.size, int(i.mtime.timestamp() * 1000)) for i in found)
        return [(*o, self.metadata(o[0])) for o in [o for o in keyed if after is None or o[0] > after][:most]]

    def metadata(self, key: str) -> dict[str, str]:
        path = f"{self.root}/{key}{SIDECAR}"
        if self.files.get_file_info(path).type != pyarrow.fs.FileType.File:
            return {}
        with self.files.open_input_stream(path) as source:
            return json.loads(source.read())

    def content(self, key: str) -> bytes:
        with self.files.open_input_stream(f"{self.root}/{key}") as source:
            return source.read()


def _named(reference: str):
    module, _, name = reference.partition(":")
    return getattr(importlib.import_module(module), name)


def store_of(options: dict[str, str]):
    return _named(options["store"])(options["path"]) if options.get("store") else FolderStore(options["path"])


class Prefixes(InputPartition):
    def __init__(self, prefixes: list[str]):
        super().__init__(prefixes)
        self.prefixes = prefixes


def _may_hold(prefix: str, wanted: str, whole: bool) -> bool:
    """Whether keys of a prefix may start with ``wanted``, or be it."""
    if prefix == "":
        return "/" not in wanted
    return wanted.startswith(prefix) or (not whole and prefix.startswith(wanted))


class _Listing:
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.tests: list[tuple[tuple[str, ...], bool]] = []  # all of them: (any of these, whole key)
        if options.get("prefix"):
            self.tests.append(((options["prefix"],), False))

    def planned(self) -> list[Prefixes]:
        wanted = [p for p in store_of(self.options).prefixes() if all(any(_may_hold(p, w, whole) for w in any_of) for any_of, whole in self.tests)]
        per = int(self.options.get("prefixes", PREFIXES))
        return [Prefixes(wanted[k : k + per]) for k in range(0, len(wanted), per)]

    def pages(self, prefixes: list[str]) -> Iterator[list[tuple]]:
        store, most, start = store_of(self.options), int(self.options.get("page", PAGE)), self.options.get("prefix", "")
        for prefix in prefixes:
            after = None
            while page := store.page(prefix, after, most):
                yield [o for o in page if o[0].startswith(start)]
                after = page[-1][0]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_OBJECT)
    return pa.RecordBatch.from_arrays([pa.array([list(m.items()) for m in c] if f.name == "metadata" else c, f.type) for c, f in zip(columns, _OBJECT)], schema=_OBJECT)


class _Pushed:
    """For sessions that push filters to Python sources; in others Spark refuses a reader that takes them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",):
                self.tests.append(((f.value,), True))
            elif isinstance(f, In) and f.attribute == ("key",):
                self.tests.append((tuple(f.value), True))
            elif isinstance(f, StringStartsWith) and f.attribute == ("key",):
                self.tests.append(((f.value,), False))
            yield f  # a prefix holds other keys too, so Spark filters again


class _Reader(_Listing, DataSourceReader):
    def partitions(self) -> list[Prefixes]:
        return self.planned()


class ObjectReader(_Reader):
    def read(self, partition: Prefixes) -> Iterator[pa.RecordBatch]:
        for page in self.pages(partition.prefixes):
            yield _batch(page)


class CellReader(_Reader):
    """Cells of every workbook; ``reader`` names a function (content, key) -> cells, by default the library's."""

    def read(self, partition: Prefixes) -> Iterator[pa.RecordBatch]:
        from tidewell.sources.objects import SHEETS

        reader = _named(self.options.get("reader") or "tidewell.sources.extract:sheet_cells")
        store = store_of(self.options)
        for page in self.pages(partition.prefixes):
            for key, *_ in page:
                if key.lower().endswith(SHEETS):
                    rows = [(key, *cell) for cell in reader(store.content(key), key)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CELL)], schema=_CELL)


class PushedObjectReader(_Pushed, ObjectReader):
    pass


class PushedCellReader(_Pushed, CellReader):
    pass


class ObjectStream(_Listing, DataSourceStreamReader):
    """What was changed in a store, by the time of the change; a batch that runs again lists the same times."""

    def initialOffset(self) -> dict:
        return {"ms": int(self.options.get("since", -1))}

    def latestOffset(self) -> dict:
        return {"ms": int(time.time() * 1000) - int(self.options.get("grace", 0))}

    def partitions(self, start: dict, end: dict) -> list[Prefixes]:
        out = self.planned()
        for p in out:
            p.between = (start["ms"], end["ms"])
        return out

    def read(self, partition: Prefixes) -> Iterator[pa.RecordBatch]:
        low, high = partition.between
        for page in self.pages(partition.prefixes):
            yield _batch([o for o in page if low < o[2] <= high])


class Objects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return OBJECTS

    def reader(self, schema) -> DataSourceReader:
        return (PushedObjectReader if self.options.get("pushdown") == "true" else ObjectReader)(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ObjectStream(dict(self.options))


class Cells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cells"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return (PushedCellReader if self.options.get("pushdown") == "true" else CellReader)(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Objects)
    spark.dataSource.register(Cells)


def list_store(spark: SparkSession, folder: str, store: str = "", **options) -> DataFrame:
    """(path, key, metadata) of a store's objects, metadata decoded; a path is the key, for :func:`read_store`."""
    register(spark)
    reader = spark.read.format("objects").option("path", folder).option("store", store)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load().select(F.col("key").alias("path"), "key", percent_decode(F.col("metadata")).alias("metadata"))


def read_store(objects: DataFrame, folder: str, store: str = "") -> DataFrame:
    """``objects`` (path, key, metadata) with ``content``, fetched by the tasks that hold them, one at a time."""
    options = {"path": folder, "store": store}

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = store_of(options)
        for batch in batches:
            for k in range(len(batch)):
                row = batch.iloc[k : k + 1]
                yield row.assign(content=[source.content(row["key"].iloc[0])])

    slim = objects.select("path", "key").mapInPandas(fetch, "path string, key string, content binary")
    return slim.join(objects.select(F.col("path").alias("__path"), "metadata"), F.col("path") == F.col("__path")).drop("__path")
