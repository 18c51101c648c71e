"""Deleted-interpolation language model: n-gram maximum-likelihood estimates of all orders, mixed
with weights for each bucket of the context's frequency, learned by expectation-maximisation.

Training documents are split in two by a further remainder of the id's checksum. For the weights,
estimates come from one part and are held against the n-grams of the other, the held-out
counts; the scores then use the counts of both parts. The estimates of a word w after h are
c(hw)/c(h), c(w)/N and 1/(V+1); a context never seen has the last two only.

All counts are exact and cover all training documents. Each chunk of documents asks for the
counts of its distinct n-grams (see chunkstore) and is then scored on its own. What the
driver gathers is a histogram over a grid of fixed size (context bucket by log estimates), whose
range is that of 64-bit counts: no estimate or context is clipped at any size of the corpus. A cell has the
mean of its log estimates, so the grid costs second-order terms only.

Defined results: a null or empty text is one end token; a null id counts as the empty text in the
checksum (training); repeated rows count as often as they occur; an empty table gives an empty
result; other columns aren't read, whatever their names. Text is taken whole, A-Z in lower case, a very long one
in the task of its chunk.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunkstore as cs
from . import textkernel as tk
from .common import bucketed

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_OUT = cs.empty_like(SCHEMA).schema
_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
FOLDS, HELD_OUT, WEIGHTS_FROM = 5, 1, 0
_GRID, _STEPS = 8, 8 * 64 + 2  # eight steps a factor of two, down to 2^-64; and none
_BUCKETS = 65


def fold(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


class _Tokens:
    """Tokens of a chunk with the end of each document, what precedes each, and n-gram keys."""

    def __init__(self, chunk: cs.Chunk):
        starts, _, h = tk.words(chunk.buf, lower=True)
        first, last = np.searchsorted(starts, chunk.starts), np.searchsorted(starts, chunk.ends)
        self.folds = np.array([fold(x) for x in chunk.ids], np.int64)
        n_docs = len(chunk.ids)
        size = last - first + 1
        self.begin = np.cumsum(size) - size
        self.end = self.begin + size
        self.token = np.empty(int(size.sum()), np.uint64)
        ends = self.end - 1
        is_end = np.zeros(len(self.token), bool)
        is_end[ends] = True
        self.token[is_end], self.token[~is_end] = _END, h
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[self.begin] = _BEGIN
        self.pair = tk.mix(self.before * np.uint64(0xD6E8FEB86659FD93) + self.token)
        self.of_doc = np.repeat(np.arange(n_docs), size)

    def keys(self):
        """Distinct keys of single tokens (with the begin mark) and of pairs, and the number of each token's."""
        marks = np.full(len(self.begin), _BEGIN)
        single, which = np.unique(np.concatenate([self.token, marks]), return_inverse=True)
        pair, of_pair = np.unique(self.pair, return_inverse=True)
        before = np.searchsorted(single, self.before)
        return single, which, pair, of_pair, before


def _counts(number: np.ndarray, part: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.bincount(number[part == p], minlength=n).astype(np.uint32) for p in (0, 1)]


def _ask(chunk: cs.Chunk, parts: int) -> list[tuple]:
    t = _Tokens(chunk)
    single, which, pair, of_pair, _ = t.keys()
    # 0: for the estimates, 1: for the weights, 2: not learned from.
    part = np.where(t.folds == HELD_OUT, 2, np.where(t.folds == WEIGHTS_FROM, 1, 0))
    of = part[t.of_doc]
    ones = cs.ask_rows(chunk.number, single, _counts(which, np.concatenate([of, part]), len(single)), parts)
    twos = cs.ask_rows(chunk.number, pair, _counts(of_pair, of, len(pair)), parts)
    return [(2 * p, c, n, d) for p, c, n, d in ones] + [(2 * p + 1, c, n, d) for p, c, n, d in twos]


def _pack(values: list[np.ndarray]) -> bytes:
    return cs.deflate(b"".join(tk.planes(np.ascontiguousarray(v)) for v in values))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = cs.inflate(data)
    return [tk.unplanes(raw[: len(raw) // 2], np.uint64), tk.unplanes(raw[len(raw) // 2 :], np.uint64)]


def _reply(sums: list[np.ndarray], number: np.ndarray) -> bytes:
    return _pack([s[number] for s in sums])


_JOINED = "chunk long, ids array<long>, lens array<long>, blob binary, singles binary, pairs binary"
_JOINED_ARROW = cs.empty_like(_JOINED).schema


def _join(chunk_row: pa.Table, right: pa.Table) -> pa.Table:
    if not chunk_row.num_rows:
        return _JOINED_ARROW.empty_table()
    back = dict(zip(right.column("pid").to_pylist(), right.column("data").to_pylist()))
    out = []
    for kind in (0, 1):
        parts = [_unpack(back[p]) for p in sorted(k for k in back if k % 2 == kind)]
        out.append(_pack([np.concatenate([p[i] for p in parts]) for i in (0, 1)]))
    return pa.Table.from_arrays([*(chunk_row.column(c) for c in ("chunk", "ids", "lens", "blob")), pa.array([out[0]], pa.binary()), pa.array([out[1]], pa.binary())], schema=_JOINED_ARROW)


def _looked_up(batch: pa.RecordBatch, i: int):
    chunk = next(cs.chunks_in(batch.slice(i, 1)))
    return chunk, _Tokens(chunk), _unpack(batch.column("singles")[i].as_py()), _unpack(batch.column("pairs")[i].as_py())


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(count.astype(float) + 1)).astype(np.int64), _BUCKETS - 1)


def _step(p: np.ndarray) -> np.ndarray:
    """Number of a probability's step on the grid; 0: none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(-np.log2(p) * _GRID), 0, _STEPS - 2) + 1, 0).astype(np.int64)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def fit_weights(bucket, p2, p1, p0: float, times, rounds: int = 60) -> np.ndarray:
    """Mixture weights for each bucket by expectation-maximisation on weighted events."""
    weights = np.tile([0.4, 0.4, 0.2], (_BUCKETS, 1))
    parts = np.stack([p2, p1, np.full(len(p1), p0)], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * parts
        share *= (times / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        # One event for each part keeps a bucket with few events from dropping one.
        total = np.stack([np.bincount(bucket, share[:, k], _BUCKETS) for k in range(3)], axis=1) + [0.1, 0.1, 0.01]
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base score and model score of each document (SCHEMA)."""
    base = cs.store(docs, id_col, text_col, 4 << 20)
    parts = base.partitions(base.total_bytes / 7, 1 << 20)

    def begin(batches):
        for batch in batches:
            for chunk in cs.chunks_in(batch):
                yield from cs.rows_to_arrow(_ask(chunk, parts), cs.ASK_ARROW).to_batches()

    def totals(sums):
        return np.array([int(sums[0].sum()), int(sums[1].sum()), int((sums[0] > 0).sum()), int(((sums[0] + sums[1]) > 0).sum())], np.int64).tobytes()

    replies = cs.answer(base.df.mapInArrow(begin, cs.ASK_SCHEMA), 2, _reply, totals)
    spark = docs.sparkSession
    # Both the answers by chunk and the totals (chunk -1) come from one table.
    held = bucketed(replies, "chunk", base.buckets, "ngrams")
    sizes = held.where("chunk = -1").select((F.col("pid") % 2).alias("kind"), "data").where("kind = 0")
    figures = _sum_totals(sizes)
    n_a, n_b, v_a, v_all = figures
    # The begin mark is a context, not a token; each training document has one.
    marks = _training_documents(base)
    n_a, n_b = n_a - marks[0], n_b - marks[1]
    v_a, v_all = v_a - (marks[0] > 0), v_all - (sum(marks) > 0)

    joined = base.df.groupBy("chunk").cogroup(held.where("chunk >= 0").groupBy("chunk")).applyInArrow(_join, _JOINED)

    def histogram(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, t, one, two = _looked_up(batch, i)
                at = np.flatnonzero((t.folds == WEIGHTS_FROM)[t.of_doc])
                if not len(at):
                    continue
                _, which, _, of_pair, before = t.keys()
                context = one[0][before[at]]
                p2, p1 = _ratio(two[0][of_pair[at]], context), one[0][which[at]] / max(1, n_a)
                code = (_bucket(context) * _STEPS + _step(p2)) * _STEPS + _step(p1)
                codes, of, times = np.unique(code, return_inverse=True, return_counts=True)
                logs = (np.bincount(of, np.log2(np.where(p > 0, p, 1.0)), len(codes)) for p in (p2, p1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (codes, times, *logs)], names=["code", "times", "log2", "log1"])

    events = joined.mapInArrow(histogram, "code long, times long, log2 double, log1 double").groupBy("code").agg(*(F.sum(c).alias(c) for c in ("times", "log2", "log1"))).toPandas()
    code, times = events["code"].to_numpy(np.int64), events["times"].to_numpy(float)
    # A cell of the grid stands for the geometric mean of the estimates in it.
    mean = lambda s, c: np.where(s > 0, np.exp2(events[c].to_numpy(float) / times), 0.0)
    weights = fit_weights(code // _STEPS**2, mean(code // _STEPS % _STEPS, "log2"), mean(code % _STEPS, "log1"), 1 / (v_a + 1), times)

    def score(batches):
        n, v = n_a + n_b, v_all
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, t, one, two = _looked_up(batch, i)
                _, which, _, of_pair, before = t.keys()
                c1, c2 = one[0] + one[1], two[0] + two[1]
                count, context = c1[which[: len(t.token)]], c1[before]
                w = weights[_bucket(context)]
                p = w[:, 0] * _ratio(c2[of_pair], context) + w[:, 1] * (count / max(1, n)) + w[:, 2] / (v + 1)
                # Where the context was never seen its estimate has no weight.
                p = np.where(context > 0, p, p / (w[:, 1] + w[:, 2]))
                sums = lambda x: np.add.reduceat(x, t.begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip((chunk.ids, t.folds == HELD_OUT, t.end - t.begin, sums((count > 0).astype(np.int64)), np.full(len(chunk.ids), n), sums(np.log10((count + 0.5) / (n + 0.5 * (v + 1)))), sums(np.log10(p))), _OUT)],
                    schema=_OUT,
                )

    return joined.mapInArrow(score, SCHEMA)


def _sum_totals(rows: DataFrame) -> list[int]:
    """Sums of the partitions' totals: four numbers, added up in the tasks first."""

    def add(batches):
        total = np.zeros(4, np.int64)
        for batch in batches:
            for x in batch.column("data"):
                total += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in total], names=list("abcd"))

    out = rows.select("data").mapInArrow(add, "a long, b long, c long, d long").agg(*(F.sum(c) for c in "abcd")).first()
    return [x or 0 for x in out]


def _training_documents(base: cs.Store) -> tuple[int, int]:
    rest = F.expr("crc32(cast(coalesce(cast(id as string), '') as binary)) % 5")
    row = base.df.select(F.explode("ids").alias("id")).select(rest.alias("r")).agg(F.count_if(~F.col("r").isin(HELD_OUT, WEIGHTS_FROM)).alias("a"), F.count_if(F.col("r") == WEIGHTS_FROM).alias("b")).first()
    return row.a, row.b
