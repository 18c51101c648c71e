"""Substring dedup by level-wise doubling over word windows.

A window of ``min_words`` words can only be repeated if the shorter windows in it are. So
lengths go up by doubling (for 35 words: 9, 18, 35). At each length a window that is still a
candidate asks about one shorter window in it, that with the smallest hash, so that equal
windows ask about equal ones; those repeated nowhere end there, those repeated at that length
alone are extended to the next. At the last length each surviving window asks about itself.

Defined results: a null text has no words; texts of fewer than ``min_words`` words lose none;
repeated rows and equal texts are repeats of each other (both lose the passage); overlapping
repeats within a document count; ids may be null or repeated, as each row is its own document;
a very long text is split into words in blocks, in the task of its chunk; an empty table gives an empty
result. Only the id and the text are read of the columns, whatever the others are named.
Windows are compared by 64-bit hashes, after their parts were found repeated as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunkstore as cs
from . import textkernel as tk

SCHEMA = "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_sha256 string"
_KEYS_EACH = 1 << 20


def levels(min_words: int, least: int = 8) -> list[int]:
    """Doubling lengths that end with min_words."""
    out = [min_words]
    while (out[0] + 1) // 2 >= least:
        out.insert(0, (out[0] + 1) // 2)
    return out


class _Text:
    """Words of a chunk, and which windows stay within a document."""

    def __init__(self, chunk: cs.Chunk, width: int):
        self.chunk = chunk
        self.starts, self.ends, self.hashes = tk.words(chunk.buf)
        self.first = np.searchsorted(self.starts, chunk.starts)
        self.last = np.searchsorted(self.starts, chunk.ends)
        n = max(0, len(self.starts) - width + 1)
        end = np.repeat(self.last, self.last - self.first)[:n]
        self.valid = np.arange(n) + width <= end

    def questions(self, alive: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidate windows; the part that each asks about; hashes of all parts."""
        windows = np.flatnonzero(alive)
        g = tk.grams(self.hashes, length)
        return windows, tk.minima(g, width - length + 1)[windows], g


def _even(minima: np.ndarray) -> np.ndarray:
    """Minima are small values: mixed again they spread evenly over partitions."""
    return tk.mix(minima)


def _ask(text: _Text, alive: np.ndarray, length: int, width: int, parts: int) -> list[tuple]:
    _, part, g = text.questions(alive, length, width)
    keys, counts = np.unique(_even(g[np.unique(part)]), return_counts=True)
    state = np.packbits(alive).tobytes()
    number = text.chunk.number
    # The state travels beside the questions: nothing is computed twice.
    return [*cs.ask_rows(number, keys, [np.minimum(counts, 2).astype(np.uint32)], parts), (-1 - number % parts, number, len(alive), cs.deflate(state))]


def _resolve(text: _Text, back: dict, length: int, width: int) -> np.ndarray:
    state = next(v for k, v in back.items() if k < 0)
    n = len(text.valid)
    alive = np.unpackbits(np.frombuffer(cs.inflate(state), np.uint8), count=n).astype(bool) if n else np.zeros(0, bool)
    if not alive.any():
        return alive
    windows, part, g = text.questions(alive, length, width)
    at, which = np.unique(part, return_inverse=True)
    keys, of = np.unique(_even(g[at]), return_inverse=True)
    bits = np.concatenate([np.unpackbits(np.frombuffer(cs.inflate(back[p][8:]), np.uint8), count=int.from_bytes(back[p][:8], "little")) for p in sorted(k for k in back if k >= 0)])
    assert len(bits) == len(keys)
    alive[windows] = bits[of][which].astype(bool)
    return alive


def _repeated(sums: list[np.ndarray], number: np.ndarray) -> bytes:
    return len(number).to_bytes(8, "little") + cs.deflate(np.packbits(sums[0][number] >= 2).tobytes())


def repeated_windows(base: cs.Store, min_words: int, finish: Callable[[_Text, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """finish(words of a chunk, starts of its repeated windows as a mask) for each chunk."""
    steps = levels(min_words)
    parts = base.partitions(base.total_bytes / 6, 4 * _KEYS_EACH)

    def begin(batches):
        for batch in batches:
            for chunk in cs.chunks_in(batch):
                text = _Text(chunk, min_words)
                rows = _ask(text, text.valid, steps[0], min_words, parts)
                yield from cs.rows_to_arrow(rows, cs.ASK_ARROW).to_batches()

    asked = base.df.mapInArrow(begin, cs.ASK_SCHEMA)
    for now, then in zip(steps, [*steps[1:], None]):

        def step(chunk, back, now=now, then=then):
            text = _Text(chunk, min_words)
            alive = _resolve(text, back, now, min_words)
            if then is None:
                return finish(text, alive)
            return cs.rows_to_arrow(_ask(text, alive, then, min_words, parts), cs.ASK_ARROW)

        asked = cs.by_chunk(base, cs.answer(asked, 1, _repeated), step, cs.ASK_SCHEMA if then else schema)
    return asked


_OUT = cs.empty_like(SCHEMA).schema


def dedup_substrings(docs: DataFrame, min_words: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word ranges to remove from each document (``removed``), and a digest of what is kept."""

    def finish(text: _Text, alive: np.ndarray) -> pa.Table:
        gone = tk.cover(np.flatnonzero(alive), min_words, len(text.starts))
        buf, rows = text.chunk.buf, []
        for k, doc in enumerate(text.chunk.ids):
            a, b = int(text.first[k]), int(text.last[k]) if text.chunk.lens[k] > 0 else int(text.first[k])
            out = gone[a:b]
            words = buf[text.chunk.starts[k] : text.chunk.starts[k] + max(text.chunk.lens[k], 0)].tobytes().split()
            if out.any():
                words = [w for w, g in zip(words, out) if not g]
            s, e = tk.runs(out)
            rows.append((doc, b - a, int(out.sum()), [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())], hashlib.sha256(b" ".join(words)).hexdigest()))
        return cs.rows_to_arrow(rows, _OUT)

    return repeated_windows(cs.store(docs, id_col, text_col), min_words, finish, SCHEMA)
