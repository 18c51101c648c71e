"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by the number of their shingles (classes whose bound in words doubles). For a class with
bound m, documents are searched in windows of 2m words, m apart, so that each passage of at most m
words lies whole in a window of comparable size: an item contained in the window then has a Jaccard
similarity with it that does not fall with the length of the document. Item and window collide if
they agree in one of ``HASHES`` minima; a collision is verified by exact containment of the item's
distinct shingles in those of the whole document.

1. Items are hashed by tasks: their shingles, and as keys their minima (with class and function). A
   bitmap of all shingles of items, 2^``BITS`` bits whatever their number, goes to all tasks.
2. One pass over the documents finds the shingles that the bitmap has (few documents have any), and the minima
   of the windows around them. A minimum that the bitmap lacks is no item's, so it is left out. What is found is
   written as a table: a row for each document that has something.
3. Documents and items are joined by key; of the pairs, the shared shingles are joined and counted. These are
   shuffle joins (Spark broadcasts a side that it measures as small); nothing but the bitmap goes to the driver.

An item of n shingles and contained share c agrees with its window of |W| shingles in each minimum with
probability c n / (|W| + (1-c) n). Items of at most ``FEW`` shingles, for which this is least (1/12 for an item of 5
words), collide by any of their shingles instead, which misses none. For the others it is at least 10/63
with the default arguments (c n rounded up, n = 13), so an item is missed with probability below 1e-7 for 96 minima.
That holds for items that lie together; of those whose shingles are spread over more than a window it finds fewer.

Defined results: items and documents without words have no shingles and match nothing; fewer words
than ``words_each`` are one shingle; null texts match nothing; null ids are returned as null;
repeated rows each get their pairs; very long texts are searched whole, in one task each; empty tables give
an empty result; other columns aren't read, whatever their names, and pass ``decontaminate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunkstore as cs
from . import textkernel as tk
from .common import materialize
from .jaccard import _texts, shingle_sets

HASHES = 96
FEW = 12
BITS = 26
SCHEMA = "doc_id long, item_id long, n_shared long, n_item_shingles long"
_U = np.uint64
_SEEDS = tk.mix(np.arange(1, HASHES + 1, dtype=_U) * _U(0xA0761D6478BD642F))
_BLOCKS = 256


def bound(n_shingles: int, k: int) -> int:
    """The class of items of so many shingles: its bound in words."""
    return 8 << max(0, int(np.ceil(np.log2(max(n_shingles + k - 1, 8) / 8))))


def _minima(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash function, the least value of the shingles, and which of them has it."""
    values = tk.mix(s[None, :] ^ _SEEDS[:, None])
    at = values.argmin(axis=1)
    return values[np.arange(HASHES), at], at


def _keys(minima: np.ndarray, m: int) -> np.ndarray:
    # Class and function go into the key, so minima only meet their own kind.
    return tk.mix(minima ^ _SEEDS ^ _U(m))


def item_keys(s: np.ndarray, k: int) -> np.ndarray:
    """Keys by which documents find an item of shingles s."""
    return s if len(s) <= FEW else _keys(_minima(s)[0], bound(len(s), k))


class Bitmap:
    """Which shingles may be an item's."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(s: np.ndarray) -> np.ndarray:
        return (s >> _U(64 - BITS)).astype(np.int64)

    def has(self, s: np.ndarray) -> np.ndarray:
        at = self.places(s)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def document_keys(g: np.ndarray, hit: np.ndarray, bounds: list[int], k: int) -> np.ndarray:
    """Keys of a document whose shingles in order are g, of which the bitmap has ``hit``."""
    at = np.flatnonzero(hit)
    found = [np.unique(g[at])]
    for m in bounds:
        width = 2 * m - k + 1
        for w in np.unique(np.concatenate([at // m, np.maximum(at // m - 1, 0)])).tolist():
            window = g[w * m : w * m + width]
            least, which = _minima(window)
            found.append(_keys(least, m)[hit[w * m : w * m + width][which]])
    return np.unique(np.concatenate(found))


def search(bitmap: Bitmap, bounds: list[int], texts: list[bytes], k: int):
    """(number, distinct shingles that the bitmap has, keys) of the texts that have any."""
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    starts, _, h = tk.words(buf, lower=True)
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, begin + sizes)
    every = tk.grams(h, k)
    # One look at all shingles: most documents hold none of the items'.
    hit = bitmap.has(every)
    upto = np.concatenate([[0], np.cumsum(hit)])
    for i, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
        if b - a >= k:
            if upto[b - k + 1] > upto[a]:
                part = hit[a : b - k + 1]
                yield i, np.unique(every[a : b - k + 1][part]), document_keys(every[a : b - k + 1], part, bounds, k)
        elif b > a:
            g = tk.grams(h[a:b], b - a)
            if bitmap.has(g)[0]:
                yield i, g, g


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _items(items: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """row, item_id, n, m, shingles and keys of each item that has shingles."""

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in _texts(batch, 1):
                sets = shingle_sets(texts, k)
                kept = [i for i, s in enumerate(sets) if len(s)]
                rows = [(number + i, ids[a + i].as_py(), len(sets[i]), 0 if len(sets[i]) <= FEW else bound(len(sets[i]), k), _long(sets[i]), _long(item_keys(sets[i], k))) for i in kept]
                number += b - a
                yield from cs.rows_to_arrow(rows, arrow).to_batches()

    schema = "row long, item_id long, n long, m long, shingles array<long>, keys array<long>"
    arrow = cs.arrow_schema(schema)
    return materialize(items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema), "items")


def _bitmap(items: DataFrame) -> np.ndarray:
    """Bits of all shingles of items, merged by tasks block by block."""

    def mark(batches):
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            bits[Bitmap.places(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(_U))] = True
        for i, part in enumerate(np.split(np.packbits(bits, bitorder="little"), _BLOCKS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([cs.deflate(part.tobytes())], pa.binary())], names=["block", "data"])

    def merge(group: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(cs.inflate(x.as_py()), np.uint8) for x in group.column("data")])
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "data": pa.array([cs.deflate(total.tobytes())], pa.binary())})

    out = np.zeros((_BLOCKS, (1 << BITS) // 8 // _BLOCKS), np.uint8)
    for row in items.select("shingles").mapInArrow(mark, "block int, data binary").groupBy("block").applyInArrow(merge, "block int, data binary").collect():
        out[row.block] = np.frombuffer(cs.inflate(bytes(row.data)), np.uint8)
    return out.ravel()


def _pairs(rows: DataFrame, items: DataFrame, percent: int, k: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: a struct ``tag`` and text. Tables of the documents that have something (row, tag) and of the
    items, and the pairs (doc, item, shared) that are contained."""
    spark = rows.sparkSession
    it = _items(items, k, id_col, text_col)
    bounds = sorted(r.m for r in it.where("m > 0").select("m").distinct().collect())  # a class for each doubling of length
    sent = spark.sparkContext.broadcast(_bitmap(it))  # 8 MB, whatever the items
    schema = f"row long, tag {rows.schema['tag'].dataType.simpleString()}, hits array<long>, keys array<long>"

    def run(batches):
        bitmap = Bitmap(sent.value)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, texts in _texts(batch, 1):
                found = list(search(bitmap, bounds, texts, k))
                if found:
                    at = pa.array([a + i for i, _, _ in found])
                    lists = [pa.array([_long(f[j]) for f in found], pa.list_(pa.int64())) for j in (1, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array([number + i for i, _, _ in found], pa.int64()), batch.column(0).take(at), *lists], names=["row", "tag", "hits", "keys"])
                number += b - a

    docs = materialize(rows.select("tag", "text").mapInArrow(run, schema), "touched")
    pairs = docs.select(F.col("row").alias("doc"), F.explode("keys").alias("key")).join(it.select(F.col("row").alias("item"), F.explode("keys").alias("key")), "key").select("doc", "item").distinct()
    wanted = pairs.join(it.select(F.col("row").alias("item"), "n", F.explode("shingles").alias("s")), "item")
    shared = wanted.join(docs.select(F.col("row").alias("doc"), F.explode("hits").alias("s")), ["doc", "s"]).groupBy("doc", "item", "n").agg(F.count(F.lit(1)).alias("shared"))
    return docs, it, shared.where(100 * F.col("shared") >= percent * F.col("n"))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 75, words_each: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (SCHEMA): items of which at least that share of distinct shingles is in the document."""
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id")).alias("tag"), F.col(text_col).cast("string").alias("text"))
    found, it, pairs = _pairs(rows, items, percent, words_each, item_id, item_text)
    named = pairs.join(found.select(F.col("row").alias("doc"), "tag.doc_id"), "doc").join(it.select(F.col("row").alias("item"), "item_id"), "item")
    return named.select("doc_id", "item_id", F.col("shared").alias("n_shared"), F.col("n").alias("n_item_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 75, words_each: int = 5, id_col: str = "doc_id", text_col: str = "text", item_text: str = "text") -> DataFrame:
    """docs without the rows that contain an item; all columns as they were. Rows of equal text share their fate."""
    text = F.col(text_col).cast("string")
    digest = [F.xxhash64(F.lit(i), text) for i in (1, 2)]  # 128 bits name a text
    rows = docs.select(F.struct(digest[0].alias("x"), digest[1].alias("y")).alias("tag"), text.alias("text"))
    found, _, pairs = _pairs(rows, items.select(F.lit(0).cast("long").alias("i"), F.col(item_text).alias("t")), percent, words_each, "i", "t")
    names = ["x", "y"]
    while any(c.lower() in names for c in docs.columns):
        names = [f"_{n}" for n in names]
    gone = found.join(pairs.select(F.col("doc").alias("row")), "row", "left_semi").select(F.col("tag.x").alias(names[0]), F.col("tag.y").alias(names[1])).distinct()
    return docs.join(materialize(gone, "contaminated"), (digest[0] == F.col(names[0])) & (digest[1] == F.col(names[1])), "left_anti")
