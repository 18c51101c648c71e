"""Documents packed into chunks of a few MB, and questions that chunks put to the whole corpus.

A chunk is one row: the ids and byte lengths of its documents and their texts, joined by a
line feed and compressed. The table is bucketed by chunk, which moves each text once, so that answers join
it without moving texts again. A question (``ask``) sends, for each chunk, distinct 64-bit keys with counts to the
partition that the key's leading bits name; ``answer`` sums the counts there and sends them
back in the order in which they were asked, so keys travel one way only.
A row is what a chunk asks of a partition. Chunks and partitions both grow with the root of the corpus beyond
``ROOT_FROM`` (2 MB and 16 MB of keys there, some 40 times these at 100 TB), so that a row always holds hundreds of
keys and neither rows nor their heads outgrow the text. Memory of a task: one chunk, or the keys of one
partition. A single key costs one entry for each chunk that has it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import bucketed, buckets, text_bytes

CHUNK_BYTES = 2 << 20
ROOT_FROM = 50 << 30
_SLOTS = 1 << 20
CHUNK_SCHEMA = "chunk long, ids array<long>, lens array<long>, raw long, blob binary"
#: pid < 0: state that a chunk keeps for its next pass.
ASK_SCHEMA = "pid int, chunk long, size long, data binary"


@dataclass
class Chunk:
    """Texts of one chunk. lens is -1 for a null text; starts are offsets into buf."""

    number: int
    ids: list
    lens: np.ndarray
    starts: np.ndarray
    buf: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return self.starts + np.maximum(self.lens, 0)


@dataclass
class Store:
    df: DataFrame
    total_bytes: int
    documents: int
    growth: float = 1.0
    buckets: int = 1

    def partitions(self, units: float, each: int) -> int:
        return max(1, int(np.ceil(units / (each * self.growth))))


def growth(total_bytes: int) -> float:
    """How many times as large as in a small corpus chunks and partitions are."""
    return min(max(1.0, total_bytes / ROOT_FROM) ** 0.5, 48.0)


def deflate(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def inflate(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _pack(chunk_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        ids, lens, texts, held = [], [], [], 0

        def row():
            blob = deflate(b"\n".join(texts))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([held], pa.int64()), pa.array([blob], pa.binary())],
                names=["chunk", "ids", "lens", "raw", "blob"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                data = text.as_py()
                ids.append(doc)
                lens.append(-1 if data is None else len(data))
                texts.append(data or b"")
                held += len(texts[-1]) + 1
                if held >= chunk_bytes or len(ids) >= _SLOTS:
                    yield row()
                    ids, lens, texts, held = [], [], [], 0
                    number += 1
        if ids:
            yield row()

    return pack


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Store:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # The planner's estimate sets sizes only: any gives the same results.
    grown, n = growth(text_bytes(rows)), buckets(rows)
    df = bucketed(rows.mapInArrow(_pack(int(chunk_bytes * grown)), CHUNK_SCHEMA), "chunk", n, "chunks")
    size = df.agg(F.sum("raw").alias("raw"), F.sum(F.size("ids")).alias("n")).first()
    return Store(df, size.raw or 0, size.n or 0, grown, n)


def chunk_of(number, ids, lens, blob) -> Chunk:
    lens = np.asarray(lens, np.int64)
    kept = np.maximum(lens, 0)
    starts = np.cumsum(kept + 1) - kept - 1
    return Chunk(number, ids, lens, starts, np.frombuffer(inflate(blob), np.uint8))


def chunks_in(table: pa.Table | pa.RecordBatch) -> Iterator[Chunk]:
    for i in range(table.num_rows):
        yield chunk_of(*(table.column(c)[i].as_py() for c in ("chunk", "ids", "lens", "blob")))


def ask_rows(chunk: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> list[tuple]:
    """Rows of ASK_SCHEMA for sorted distinct keys; counts has one row for each counter."""
    pid = partition_of(keys, parts)
    cut = np.flatnonzero(np.diff(pid, prepend=-1, append=parts))
    return [(int(pid[a]), chunk, b - a, deflate(tk.planes(keys[a:b]) + b"".join(tk.planes(np.ascontiguousarray(c[a:b])) for c in counts))) for a, b in zip(cut[:-1], cut[1:]) if b > a]


def partition_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """In ascending order for sorted keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def rows_to_arrow(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


ASK_ARROW = pa.schema([("pid", pa.int32()), ("chunk", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])


def unpack_ask(data: bytes, n: int, counters: int, dtype=np.uint32) -> tuple[np.ndarray, list[np.ndarray]]:
    raw, width = inflate(data), np.dtype(dtype).itemsize
    keys = tk.unplanes(raw[: 8 * n], np.uint64)
    return keys, [tk.unplanes(raw[8 * n + width * n * i : 8 * n + width * n * (i + 1)], dtype) for i in range(counters)]


def sum_by_key(keys: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each entry the number of its key; the distinct keys; the sums for each of these."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    group = np.empty(len(keys), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    sums = [np.add.reduceat(c[order].astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64) for c in counts]
    return group, ordered[first], sums


def answer(asked: DataFrame, counters: int, reply: Callable[[list[np.ndarray], np.ndarray], bytes], extra: Callable | None = None) -> DataFrame:
    """Sum counters by key. reply(sums, group of each entry) makes the answer to one chunk's keys;
    extra(sums) makes a further row for chunk -1."""

    def run(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(c).to_pylist() for c in ("pid", "chunk", "size", "data"))))
        if rows[0][0] < 0:
            return group.select(ASK_ARROW.names)
        parts = [unpack_ask(data, n, counters) for _, _, n, data in rows]
        number, _, sums = sum_by_key(np.concatenate([k for k, _ in parts]), [np.concatenate([c[i] for _, c in parts]) for i in range(counters)])
        out, at = [], 0
        for pid, chunk, n, _ in rows:
            out.append((pid, chunk, n, reply(sums, number[at : at + n])))
            at += n
        if extra:
            out.append((rows[0][0], -1, 0, extra(sums)))
        return rows_to_arrow(out, ASK_ARROW)

    return asked.groupBy("pid").applyInArrow(run, ASK_SCHEMA)


def by_chunk(base: Store, answers: DataFrame, function: Callable, schema: str, sized: bool = False) -> DataFrame:
    """function(chunk, {pid: data}) -> arrow table, for each chunk with what came back to it (sized: {pid: (size, data)})."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = next(chunks_in(left), None)
        if chunk is None:
            return empty_like(schema)
        data = right.column("data").to_pylist()
        return function(chunk, dict(zip(right.column("pid").to_pylist(), zip(right.column("size").to_pylist(), data) if sized else data)))

    return base.df.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
_KINDS |= {"array<long>": pa.list_(pa.int64()), "array<struct<start: long, end: long>>": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a row type written as above; tasks have no JVM to parse it."""
    fields, depth, part = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            fields.append((name, _KINDS[kind]))
            part = ""
        else:
            part += c
    return pa.schema(fields)


def empty_like(ddl: str) -> pa.Table:
    return arrow_schema(ddl).empty_table()
