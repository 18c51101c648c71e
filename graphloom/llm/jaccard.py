"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes that its links make.

Shingles are put in one global order: by the class of their estimated document frequency, rarest
first, then by hash. Two sets with Jaccard of at least t share at least l shingles of their
l-prefixes, which hold n - ceil(t n) + l shingles. Each document takes the l with the least
estimated cost: its prefix entries and their frequencies, plus the candidates that share l of
them. A pair is a candidate if it shares as many prefix entries as the lesser l of the two, where
entries that the sizes or positions rule out do not count; candidates are verified on whole sets.

Whole results under skew:
- documents with equal sets are one node (their representative), joined by their set's digest;
- entries of one shingle with up to ``RUN`` documents are paired; of longer runs each document
  is first paired with one of about its size only, that which is in most long runs;
- once those links are verified and components known, all pairs of a long run that are still in
  different components and that sizes and positions allow are verified as well. Pairs within a
  component are left out: they can't change it;
- a shingle that the counters put in more than ``RUN_EACH`` documents is dealt to that many parts, each a
  run of its own; as every shingle deals its documents anew, near copies that share several still meet. Then the
  parts are compared two by two, but for those of one component, so that no task has all of a shingle.

Frequencies come from counts over all documents in a sketch of fixed size (2^21 counters, 2 MB as
sent to tasks); they steer the order only, any order gives the same links.

Defined results: a null text and one without words have no shingles and link with nothing;
fewer words than ``words_each`` are one shingle; repeated rows and equal texts are one class;
null ids take part, but a class is named by its smallest non-null id; a very long text is hashed whole,
in one task; an empty table gives an empty result; other columns aren't read, whatever their names, and pass
``representatives``.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunkstore as cs
from . import textkernel as tk
from .common import bucketed, buckets, materialize
from .components import components

BITS = 21
RUN = 24
#: Entries of one shingle that a task takes at most, as the counters estimate them.
RUN_EACH = 200_000
_MOST = 6
_VERIFY = 40.0
_DOC = "gid long, doc_id long, n long, sig1 long, sig2 long, bits binary, blob binary"
#: Bits of a set's parity bitmap, as a power of two.
PARITY = 11
_BLOCK = 1 << 20
#: Prefix entries that a task sorts at once.
ENTRIES_EACH = 1_200_000


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    starts, _, h = tk.words(buf, lower=True)
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, begin + sizes)
    g = tk.grams(h, k)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        else:
            out.append(tk.grams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _texts(batch: pa.RecordBatch, column: int, size: int = _BLOCK):
    """(from, to, texts) in blocks of about that many bytes."""
    texts, held, a = [], 0, 0
    for i, x in enumerate(batch.column(column).cast(pa.binary())):
        texts.append(x.as_py() or b"")
        held += len(texts[-1])
        if held >= size:
            yield a, i + 1, texts
            texts, held, a = [], 0, i + 1
    if texts:
        yield a, batch.num_rows, texts


def _begin(k: int):
    def run(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        for batch in batches:
            known = batch.column(1).is_valid()
            for a, b, texts in _texts(batch, 1):
                sets = shingle_sets(texts, k)
                sigs = np.zeros((2, b - a), np.int64)
                bits = []
                for i, s in enumerate(sets):
                    m = tk.mix(s)
                    bits.append(np.packbits(np.bincount((m >> np.uint64(64 - PARITY)).astype(np.int64), minlength=1 << PARITY).astype(np.uint8) & 1).tobytes())
                    if len(s):
                        sigs[:, i] = np.array([m.sum(), np.bitwise_xor.reduce(m)], np.uint64).view(np.int64)
                blobs = [cs.deflate(t) if ok else None for t, ok in zip(texts, known[a:b].to_pylist())]
                columns = [pa.array(np.arange(number, number + b - a)), batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs[0]), pa.array(sigs[1]), pa.array(bits, pa.binary()), pa.array(blobs, pa.binary()), *(c.slice(a, b - a) for c in batch.columns[2:])]
                number += b - a
                yield pa.RecordBatch.from_arrays(columns, names=["gid", "doc_id", "n", "sig1", "sig2", "bits", "blob", *batch.schema.names[2:]])

    return run


def _sets(batch: pa.RecordBatch, k: int):
    blobs = pa.RecordBatch.from_arrays([pa.array([cs.inflate(x.as_py()) for x in batch.column("blob")], pa.binary())], names=["t"])
    gids = batch.column("gid").to_numpy()
    for a, b, texts in _texts(blobs, 0):
        yield gids[a:b], shingle_sets(texts, k)


def _sketch(docs: DataFrame, k: int) -> tuple[np.ndarray, float]:
    """Counters of all documents' distinct shingles, and how many fall on one by chance."""
    blocks = 16

    def count(batches):
        total = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            for _, sets in _sets(batch, k):
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS).astype(np.uint32)
        if total.any():
            for i, part in enumerate(np.split(total, blocks)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([cs.deflate(tk.planes(part))], pa.binary())], names=["block", "data"])

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros((1 << BITS) // blocks, np.uint64)
        for x in group.column("data"):
            total += tk.unplanes(cs.inflate(x.as_py()), np.uint32)
        # Two counters a doubling are enough for an order: one byte for each.
        code = np.round(np.log2(total.astype(float) + 1) * 4).astype(np.uint8)
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "data": pa.array([cs.deflate(code.tobytes())], pa.binary()), "total": pa.array([int(total.sum())], pa.int64())})

    out = docs.mapInArrow(count, "block int, data binary").groupBy("block").applyInArrow(merge, "block int, data binary, total long").collect()
    codes = np.zeros((blocks, (1 << BITS) // blocks), np.uint8)
    for row in out:
        codes[row.block] = np.frombuffer(cs.inflate(bytes(row.data)), np.uint8)
    return codes.ravel(), sum(r.total for r in out) / (1 << BITS)


_ENTRY = [("token", np.uint64), ("gid", np.int64), ("n", np.uint32), ("at", np.uint32), ("need", np.uint8), ("part", np.uint16)]


def _prefixes(k: int, percent: int, codes, mean: float, parts: int):
    noise = mean + 3 * np.sqrt(mean)

    def run(batches):
        common = codes.value
        for batch in batches:
            for gids, sets in _sets(batch, k):
                columns: list[list[np.ndarray]] = [[] for _ in _ENTRY]
                for gid, s in zip(gids, sets):
                    n = len(s)
                    code = common[(s >> np.uint64(64 - BITS)).astype(np.int64)]
                    guess = np.maximum(np.exp2(code / 4.0) - 1 - noise, 0)
                    kind = np.where(guess > 0, code, 0)
                    order = np.argsort(kind, kind="stable")
                    shortest = n + (-percent * n // 100) + 1
                    most = min(_MOST, n - shortest + 1)
                    cost = np.cumsum(1 + guess[order[: shortest + most - 1]])[shortest - 1 :]
                    chance = np.cumsum(guess[order[: shortest + most - 1]])[shortest - 1 :]
                    need = int(np.argmin(cost + _VERIFY * chance / np.arange(1, most + 1))) + 1
                    m = shortest + need - 1
                    # Prefixes hold small hashes: mixed again they spread evenly over partitions.
                    token = tk.mix(s[order[:m]])
                    split = np.minimum(np.ceil(guess[order[:m]] / RUN_EACH), 65_535).astype(np.uint64)
                    part = np.where(split > 1, tk.mix(token ^ tk.mix(np.array([gid]).astype(np.uint64))) % np.maximum(split, np.uint64(1)) + np.uint64(1), np.uint64(0))
                    for c, v in zip(columns, (token, np.full(m, gid, np.int64), np.full(m, n, np.uint32), np.arange(m, dtype=np.uint32), np.full(m, need, np.uint8), part.astype(np.uint16))):
                        c.append(v)
                if not columns[0]:
                    continue
                data = [np.concatenate(c) for c in columns]
                pid = cs.partition_of(np.where(data[-1] > 0, tk.mix(data[0] + data[-1].astype(np.uint64)), data[0]), parts)
                order = np.lexsort((data[0], pid))
                data, pid = [c[order] for c in data], pid[order]
                cut = np.flatnonzero(np.diff(pid, prepend=-1, append=parts))
                rows = [(int(pid[a]), 0, int(b - a), cs.deflate(b"".join(tk.planes(np.ascontiguousarray(c[a:b])) for c in data))) for a, b in zip(cut[:-1], cut[1:]) if b > a]
                yield from cs.rows_to_arrow(rows, cs.ASK_ARROW).to_batches()

    return run


def _entries(group: pa.Table) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in _ENTRY]
    for n, data in zip(group.column("size").to_pylist(), group.column("data").to_pylist()):
        raw, at = cs.inflate(data), 0
        for c, (_, kind) in zip(out, _ENTRY):
            width = np.dtype(kind).itemsize * n
            c.append(tk.unplanes(raw[at : at + width], kind))
            at += width
    return [np.concatenate(c) for c in out]


def possible(nx, ny, ix, iy, need, percent: int) -> np.ndarray:
    """Whether sizes and positions of one of the first ``need`` shared entries allow a link."""
    least, most = np.minimum(nx, ny), np.maximum(nx, ny)
    ok = 100 * least >= percent * most
    share = -(-percent * (nx + ny) // (100 + percent))
    return ok & (np.minimum(nx - ix, ny - iy) + need - 1 >= share)


#: kind 0: candidates a and b, shared entries, entries needed; 1: the long runs of group a (data); 2: document b is in these.
_FOUND = "kind int, a long, b long, shared long, need long, data binary"
_RUNS = [("token", np.uint64), ("gid", np.int64), ("n", np.int64), ("at", np.int64), ("need", np.int64), ("part", np.int64)]


def _found(arrow: pa.Schema, kind: int, a, b, shared=None, need=None, data=None) -> pa.Table:
    zero = np.zeros(len(a), np.int64)
    columns = (np.full(len(a), kind, np.int32), a, b, zero if shared is None else shared, zero if need is None else need, data or [None] * len(a))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _candidates(percent: int):
    arrow = cs.empty_like(_FOUND).schema

    def run(group: pa.Table) -> pa.Table:
        token, gid, n, at, need, part = _entries(group)
        order = np.lexsort((gid, n, part, token))
        token, gid, n, at, need, part = (c[order] for c in (token, gid, n.astype(np.int64), at.astype(np.int64), need.astype(np.int64), part.astype(np.int64)))
        first = _run_starts(token, part)
        size = np.diff(np.append(first, len(token)))
        dealt = part[first] > 0
        pairs: list[tuple] = []
        for m in np.unique(size[(size > 1) & (size <= RUN) & ~dealt]).tolist():
            runs = first[(size == m) & ~dealt]
            i, j = np.triu_indices(m, 1)
            for block in np.array_split(runs, -(-len(runs) * len(i) // (1 << 20))):
                x, y = (block[:, None] + i).ravel(), (block[:, None] + j).ravel()
                low = np.minimum(need[x], need[y])
                ok = possible(n[x], n[y], at[x], at[y], low, percent)
                x, y, low = x[ok], y[ok], low[ok]
                pairs.append((np.minimum(gid[x], gid[y]), np.maximum(gid[x], gid[y]), low, np.zeros(len(x), bool)))
        long = np.flatnonzero(np.repeat((size > RUN) | dealt, size))
        if len(long):
            # Each to the one of about its size that is in most long runs here: an original shares
            # shingles with all its copies, which the copies' own changes don't.
            which, number, often = np.unique(gid[long], return_inverse=True, return_counts=True)
            for shift in (0.0, 0.5):
                about = np.floor(np.log(n[long]) / np.log(1.15) + shift).astype(np.int64)
                order = np.lexsort((gid[long], -often[number], about, part[long], token[long]))
                there = long[order]
                head = np.concatenate([[True], (token[there][1:] != token[there][:-1]) | (part[there][1:] != part[there][:-1]) | (about[order][1:] != about[order][:-1])])
                centre = gid[there][np.maximum.accumulate(np.where(head, np.arange(len(there)), 0))]
                x, y = np.minimum(centre, gid[there]), np.maximum(centre, gid[there])
                ok = x != y
                pairs.append((x[ok], y[ok], np.zeros(ok.sum(), np.int64), np.ones(ok.sum(), bool)))
        tables = []
        if pairs:
            a, b, low, star = (np.concatenate(c) for c in zip(*pairs))
            order = np.lexsort((b, a))
            a, b, low, star = a[order], b[order], low[order], star[order]
            head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
            if len(head):
                shared = np.add.reduceat(np.where(star, 1 << 20, 1), head)
                tables.append(_found(arrow, 0, a[head], b[head], shared, np.maximum.reduceat(low, head)))
        if len(long):
            pid = group.column("pid")[0].as_py()
            runs = cs.deflate(b"".join(tk.planes(np.ascontiguousarray(c[long])) for c in (token, gid, n, at, need, part)))
            tables.append(_found(arrow, 1, np.array([pid]), np.array([len(long)]), data=[runs]))
            tables.append(_found(arrow, 2, np.full(len(which), pid), which))
        return pa.concat_tables(tables) if tables else arrow.empty_table()

    return run


def _run_starts(token: np.ndarray, part: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (part[1:] != part[:-1])]))


@dataclass
class _Run:
    """Entries of a shingle by ascending size, with the documents' components and parity bitmaps."""

    gid: np.ndarray
    n: np.ndarray
    at: np.ndarray
    need: np.ndarray
    root: np.ndarray
    bits: np.ndarray

    def pack(self) -> bytes:
        return cs.deflate(b"".join(np.ascontiguousarray(c).tobytes() for c in (self.gid, self.n, self.at, self.need, self.root, self.bits)))

    @staticmethod
    def unpack(data: bytes) -> _Run:
        width = 5 + (1 << PARITY) // 64
        x = np.frombuffer(cs.inflate(data), np.int64)
        m = len(x) // width
        return _Run(*(x[m * i : m * i + m] for i in range(5)), x[5 * m :].reshape(m, -1).view(np.uint64))


def _linkable(x: _Run, y: _Run, percent: int):
    """Pairs of entries of x and y (or of x, if they are the same) in different components that may link.

    Two sets differ in at least as many shingles as their parity bitmaps differ in bits, which
    bounds what they share from above."""
    since = np.searchsorted(y.n * 100, percent * x.n, side="left")
    until = np.searchsorted(y.n * percent, 100 * x.n, side="right")
    for lo in range(0, len(x.gid), 512):
        hi = min(lo + 512, len(x.gid))
        end = int(until[lo:hi].max())
        for c in range(lo if x is y else int(since[lo:hi].min()), end, 1 << 13):
            d = min(c + (1 << 13), end)
            apart = x.root[lo:hi, None] != y.root[None, c:d]
            if x is y:
                apart &= np.arange(lo, hi)[:, None] < np.arange(c, d)[None, :]
            i, j = np.nonzero(apart)
            i, j = i + lo, j + c
            ok = np.flatnonzero(possible(x.n[i], y.n[j], x.at[i], y.at[j], np.minimum(x.need[i], y.need[j]), percent))
            for some in np.array_split(ok, len(ok) // 50_000 + 1):
                p, q = i[some], j[some]
                differ = np.bitwise_count(x.bits[p] ^ y.bits[q]).sum(axis=1, dtype=np.int64)
                total = x.n[p] + y.n[q]
                near = differ <= total - 2 * -(-percent * total // (100 + percent))
                p, q = x.gid[p[near]], y.gid[q[near]]
                yield np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1)


class _Pairs:
    """Distinct pairs, gathered piece by piece."""

    def __init__(self):
        self.found, self.held, self.size = np.zeros((0, 2), np.int64), [], 0

    def add(self, pairs: np.ndarray) -> None:
        self.held.append(pairs)
        self.size += len(pairs)
        if self.size > 1 << 20:
            self.all()

    def all(self) -> np.ndarray:
        if self.held:
            self.found = np.unique(np.concatenate([self.found, *self.held]), axis=0)
            self.held, self.size = [], 0
        return self.found


#: kind 0: the pair a and b; 1: a part of a dealt shingle (token, part), its least and greatest component, its entries.
_CROSS = "kind int, a long, b long, token long, part long, low long, high long, data binary"


def _crossing(percent: int):
    """Pairs of a shingle's documents in different components that may link; each once a group."""
    arrow = cs.empty_like(_CROSS).schema

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        pairs, rows = _Pairs(), []
        raw, m = cs.inflate(left.column("data")[0].as_py()), left.column("entries")[0].as_py()
        token, gid, n, at, need, part = (tk.unplanes(raw[8 * m * i : 8 * m * (i + 1)], kind) for i, (_, kind) in enumerate(_RUNS))
        known, roots = right.column("b").to_numpy(), right.column("root").to_numpy()
        order = np.argsort(known)
        at_doc = order[np.searchsorted(known[order], gid)]
        root = roots[at_doc]
        every = np.frombuffer(b"".join(right.column("bits").to_pylist()), np.uint64).reshape(len(known), -1)
        # Runs come by shingle and size. Those within one component are done, but for the other parts.
        first = _run_starts(token, part)
        low, high = np.minimum.reduceat(root, first), np.maximum.reduceat(root, first)
        for i, j, a, b in zip(first.tolist(), [*first[1:].tolist(), m], low.tolist(), high.tolist()):
            if a < b or part[i]:
                entries = _Run(*(c[i:j] for c in (gid, n, at, need, root)), every[at_doc[i:j]])
                if a < b:
                    for found in _linkable(entries, entries, percent):
                        pairs.add(found)
                if part[i]:
                    rows.append((1, None, None, int(token[i : i + 1].view(np.int64)[0]), int(part[i]), a, b, entries.pack()))
        rows += [(0, a, b, *[None] * 5) for a, b in pairs.all().tolist()]
        return cs.rows_to_arrow(rows, arrow)

    return run


def _between_parts(crossing: DataFrame, percent: int) -> DataFrame:
    """Such pairs of documents in different parts of a dealt shingle: the parts two by two."""
    parts = crossing.where("kind = 1").select("token", "part", "low", "high", "data")
    x, y = (parts.select("token", *(F.col(c).alias(f"{c}_{k}") for c in parts.columns[1:])) for k in "xy")
    met = x.join(y, "token").where("part_x < part_y and not (low_x = high_x and low_y = high_y and low_x = low_y)")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                pairs = _Pairs()
                for found in _linkable(*(_Run.unpack(batch.column(k)[i].as_py()) for k in (0, 1)), percent):
                    pairs.add(found)
                got = pairs.all()
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["a", "b"])

    return met.select("data_x", "data_y").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those whose whole sets link."""
    left = docs.select(F.col("gid").alias("a"), F.col("blob").alias("text_a"))
    right = docs.select(F.col("gid").alias("b"), F.col("blob").alias("text_b"))

    def run(batches):
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def shingles(gid, blob):
            if gid in held:
                held.move_to_end(gid)
            else:
                held[gid] = shingle_sets([cs.inflate(blob.as_py())], k)[0]
                while len(held) > 32:
                    held.popitem(last=False)
            return held[gid]

        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            ok = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = shingles(a[i], batch.column("text_a")[i]), shingles(b[i], batch.column("text_b")[i])
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    # Both are sorted sets: shared values are neighbours once sorted together.
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    same = int((both[1:] == both[:-1]).sum())
                    ok[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _solve(docs: DataFrame, percent: int, k: int, id_col: str, text_col: str, rest: list[str]) -> tuple[DataFrame, DataFrame]:
    """The documents' table (_DOC, and rest as a struct), and its distinct sets with their class:
    sig1, sig2, n, root, least (smallest id), best (row of the smallest id)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest")] if rest else []))
    schema = _DOC + (f", rest {rows.schema['rest'].dataType.simpleString()}" if rest else "")
    texts = bucketed(rows.mapInArrow(_begin(k), schema), "gid", buckets(rows), "shingled")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "gid")).alias("best")
    nodes = materialize(texts.where("n > 0").groupBy("sig1", "sig2", "n").agg(F.min("gid").alias("node"), F.min("doc_id").alias("least"), best), "nodes")
    alone = texts.join(nodes.select(F.col("node").alias("gid")), "gid", "left_semi").select("gid", "blob")

    codes, mean = _sketch(alone, k)
    parts = max(1, int(np.ceil(mean * (1 << BITS) * 0.27 / ENTRIES_EACH)))
    sent = spark.sparkContext.broadcast(codes)  # 2 MB, whatever the input
    entries = alone.mapInArrow(_prefixes(k, percent, sent, mean, parts), cs.ASK_SCHEMA)
    found = materialize(entries.groupBy("pid").applyInArrow(_candidates(percent), _FOUND), "candidates")

    pairs = found.where("kind = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("a", "b")
    links = materialize(_verified(pairs, texts, k, percent), "links")
    roots = components(links)
    inside = found.where("kind = 2").select("a", "b").join(roots.select(F.col("u").alias("b"), F.col("v").alias("root")), "b", "left").select(F.col("a").alias("part"), "b", F.coalesce("root", "b").alias("root"))
    inside = inside.join(texts.select(F.col("gid").alias("b"), "bits"), "b")
    runs = found.where("kind = 1").select(F.col("a").alias("part"), F.col("b").alias("entries"), "data")
    crossing = materialize(runs.groupBy("part").cogroup(inside.groupBy("part")).applyInArrow(_crossing(percent), _CROSS), "crossing")
    crossing = materialize(crossing.where("kind = 0").select("a", "b").union(_between_parts(crossing, percent)).distinct(), "crossing")
    if not crossing.isEmpty():
        more = materialize(_verified(crossing, texts, k, percent), "links")
        if not more.isEmpty():
            roots = components(links.union(more))
    return texts, nodes.join(roots.select(F.col("u").alias("node"), "v"), "node", "left").withColumn("root", F.coalesce("v", "node"))


def jaccard_classes(docs: DataFrame, percent: int = 75, words_each: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    texts, nodes = _solve(docs, percent, words_each, id_col, text_col, [])
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = nodes.join(named, "root").select("sig1", "sig2", "n", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return texts.select("doc_id", "n", "sig1", "sig2").join(classes, ["sig1", "sig2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def representatives(docs: DataFrame, percent: int = 75, words_each: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, that with the smallest id (of rows with that same id any
    one); rows without words all stay. Columns are as they were."""
    rest = [c for c in docs.columns if c != text_col]
    texts, nodes = _solve(docs, percent, words_each, id_col, text_col, rest)
    best = nodes.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.gid").alias("gid"))
    kept = texts.join(best.union(texts.where("n = 0").select("gid")), "gid", "left_semi").select("blob", "rest")
    kind = docs.schema

    def back(batches):
        for batch in batches:
            text = pa.array([None if x is None else cs.inflate(x) for x in batch.column(0).to_pylist()], pa.binary()).cast(pa.string())
            others = dict(zip(rest, batch.column(1).flatten()))
            yield pa.RecordBatch.from_arrays([text if c == text_col else others[c] for c in docs_columns], names=docs_columns)

    docs_columns = docs.columns
    return kept.mapInArrow(back, kind)
