"""Spark data sources ``hdt`` and ``ttl``: a partition for each file, rows as Arrow batches.

Options of both: ``paths``, a JSON list of paths or of [graph, path] pairs (or the path of ``load``). hdt also takes ``s``,
``p``, ``o``, terms that the triples must have, matched on ids within the file, and ``verify`` (payload checksums).
Writing makes one file of each partition, with its triples as a sorted set; empty partitions make none. Partition by
subject first, so that a subject's triples meet in one file.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import codec, turtle

SCHEMA = "g string, s string, p string, o string"
_ARROW = pa.schema([(c, pa.string()) for c in "gspo"])
_TERMS = pa.schema([(c, pa.large_string()) for c in "spo"])
_BATCH = 1 << 16


def read_bytes(path: str) -> bytes:
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_file(inner) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


def write_bytes(path: str, data: bytes) -> None:
    """The whole file or none: written aside, then moved into place."""
    aside = f"{path}.{uuid.uuid4().hex}.part"
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        aside = inner + aside[len(path) :]
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(aside) as f:
            f.write(data)
        system.move(aside, inner)
        return
    with open(aside, "wb") as f:
        f.write(data)
    os.replace(aside, path)


@dataclass
class File(InputPartition):
    graph: str
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options):
        listed = json.loads(options["paths"]) if options.get("paths") else [options["path"]]
        self.files = [File("", x) if isinstance(x, str) else File(*x) for x in listed]
        self.fixed = {k: options[k] for k in "spo" if options.get(k) is not None}
        self.verify = options.get("verify", "false") == "true"
        self.base = options.get("base", "")

    def partitions(self):
        return self.files

    def batch(self, graph: str, columns) -> pa.RecordBatch:
        named = pa.repeat(pa.scalar(graph, pa.string()), len(columns[0]))
        return pa.RecordBatch.from_arrays([named, *(x.cast(pa.string()) if isinstance(x, pa.Array) else pa.array(x, pa.string()) for x in columns)], schema=_ARROW)


class HdtReader(_Reader):
    def read(self, partition: File):
        for columns in codec.decode(read_bytes(partition.path), self.verify).batches(self.fixed, _BATCH):
            yield self.batch(partition.graph, columns)


class TurtleReader(_Reader):
    def read(self, partition: File):
        rows: list = []
        for t in turtle.parse(read_bytes(partition.path).decode("utf-8-sig"), self.base):
            if all(t["spo".index(k)] == v for k, v in self.fixed.items()):
                rows.append(t)
            if len(rows) == _BATCH:
                yield self.batch(partition.graph, tuple(zip(*rows)))
                rows = []
        if rows:
            yield self.batch(partition.graph, tuple(zip(*rows)))


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class Writer(DataSourceArrowWriter):
    """Files are named by the attempt; those of finished tasks of a failed job are removed by abort."""

    def __init__(self, folder: str, overwrite: bool, suffix: str):
        self.folder, self.overwrite, self.suffix = folder, overwrite, suffix

    def write(self, iterator):
        batches = [batch.select(list("spo")).cast(_TERMS) for batch in iterator]
        columns = [pa.chunked_array([x.column(c) for x in batches], pa.large_string()).combine_chunks() for c in "spo"]
        if not len(columns[0]):
            return Written(None)
        path = f"{self.folder}/part-{uuid.uuid4().hex}{self.suffix}"
        if "://" not in path:
            os.makedirs(self.folder, exist_ok=True)
        write_bytes(path, codec.encode_columns(*columns) if self.suffix == ".hdt" else self.turtle(columns))
        return Written(path)

    def turtle(self, columns: list[pa.Array]) -> bytes:
        return "".join(turtle.serialize(sorted(set(zip(*(x.to_pylist() for x in columns)))))).encode("utf-8")

    def files(self):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        return system, [f.path for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if f.path.endswith(self.suffix)]

    def commit(self, messages):
        if self.overwrite:
            new = {m.path.rpartition("/")[2] for m in messages if m and m.path}
            system, now = self.files()
            for path in now:
                if path.rpartition("/")[2] not in new:
                    system.delete_file(path)

    def abort(self, messages):
        made = {m.path.rpartition("/")[2] for m in messages if m and m.path}
        system, now = self.files()
        for path in now:
            if path.rpartition("/")[2] in made:
                system.delete_file(path)


class HdtSource(DataSource):
    @classmethod
    def name(cls):
        return "hdt"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return HdtReader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options["path"].rstrip("/"), overwrite, ".hdt")


class TurtleSource(DataSource):
    @classmethod
    def name(cls):
        return "ttl"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TurtleReader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options["path"].rstrip("/"), overwrite, ".ttl")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HdtSource)
    spark.dataSource.register(TurtleSource)


def read(spark: SparkSession, form: str, files: list, **options: str) -> DataFrame:
    """Quads of many files (paths, or [graph, path]) in one scan."""
    register(spark)
    if not files:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format(form).options(paths=json.dumps(files), **options).load()


def listing(folder: str, suffix: str = ".hdt") -> list[str]:
    """Files of a written folder, with the scheme of the folder."""
    from pyarrow import fs

    if "://" not in folder:
        return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(suffix))
    system, inner = fs.FileSystem.from_uri(folder)
    head = folder[: len(folder.rstrip("/")) - len(inner.rstrip("/"))] if folder.rstrip("/").endswith(inner.rstrip("/")) else folder.split("://")[0] + "://"
    return sorted(head + f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(suffix))
