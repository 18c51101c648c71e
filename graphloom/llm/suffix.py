"""Suffix-array dedup: maximal repeats of at least ``min_bytes`` bytes, with all occurrences.

1. Every window of ``min_bytes`` bytes names an anchor, that k-gram in it with the smallest hash.
   Equal windows name equal anchors, so a window whose anchor occurs once is not repeated.
2. For each anchor that occurs twice or more, the stretch of text under the windows that name it
   goes to the partition of the anchor's key, once for each chunk that has it; where it occurs stays with the chunk.
3. In a partition an enhanced suffix array (order and common-prefix lengths) of the distinct stretches is
   built by rank doubling; a stack scan visits its tree of common-prefix intervals. An interval
   of at least ``min_bytes`` whose occurrences have different bytes on the left is a maximal
   repeat: it is a group, with all its occurrences. An edge of a stretch counts as different.
4. Groups go back to the chunks, which put their own places to them (``maximal_repeats``); the union of the
   occurrences is removed (``dedup_suffixes``).

A repeat longer than a stretch is output as overlapping pieces, one for each anchor; the
union of its bytes is the same. Memory of a task: the distinct stretches of one partition, whose number
follows the corpus.
Anchors with more than ``HOT`` occurrences are divided: their windows are classed by where in them the anchor
lies, in steps of ``STEP`` bytes, and each class is keyed by the bytes that all its windows have in
common, all but ``STEP`` of a window. So a common line with neighbours of its own in each document is spread by
these neighbours; what still meets has ``min_bytes - STEP`` bytes in common and is sent as STEP bytes more than a window.

Defined results: a null text is empty; texts shorter than ``min_bytes`` lose nothing; repeated
rows and equal texts are repeats of each other; ids may be null or repeated; a very long text is hashed in
blocks of whole documents, in the task of its chunk; an empty table gives an empty result; other columns
aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunkstore as cs
from . import textkernel as tk
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<struct<start: long, end: long>>, kept_sha256 string"
OCCURRENCES = "group long, length long, doc_id long, start long"
ANCHOR = 40
HOT, STEP = 20_000, 20
_BYTES_EACH = 3 << 19
_OUT, _PLACES = cs.empty_like(SCHEMA).schema, cs.empty_like(OCCURRENCES).schema


class _Windows:
    """Windows of a chunk by their anchors; documents are apart."""

    def __init__(self, chunk: cs.Chunk, width: int):
        self.chunk, self.width = chunk, width
        starts, anchors, keys = [], [], []
        # In blocks of whole documents, so that the 64-bit arrays stay small.
        for a, b in _blocks(chunk):
            lo, hi = int(chunk.starts[a]), int(chunk.ends[b - 1])
            if hi - lo < width:
                continue
            g = tk.grams(tk.byte_values(chunk.buf[lo:hi]), ANCHOR)
            at = tk.minima(g, width - ANCHOR + 1)
            valid = np.zeros(hi - lo + 1, np.int32)
            sizes = chunk.ends[a:b] - chunk.starts[a:b]
            enough = sizes >= width
            np.add.at(valid, chunk.starts[a:b][enough] - lo, 1)
            np.subtract.at(valid, chunk.ends[a:b][enough] - lo - width + 1, 1)
            ok = np.cumsum(valid[: len(at)]) > 0
            s = np.flatnonzero(ok)
            starts.append(s + lo)
            anchors.append(at[s] + lo)
            first = np.flatnonzero(np.diff(at[s], prepend=-1))
            keys.append(tk.mix(g[at[s[first]]]))  # minima are small: mixed again, keys are even
        z = np.zeros(0, np.int64)
        self.starts = np.concatenate(starts) if starts else z
        anchor = np.concatenate(anchors) if anchors else z
        #: A stretch: consecutive windows that name the same anchor.
        cut = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(self.starts, prepend=-2) != 1))
        self.first, self.last = self.starts[cut], self.starts[np.append(cut[1:], len(self.starts)) - 1] if len(cut) else z
        of = anchor[cut]
        at_key = np.flatnonzero(np.diff(anchor, prepend=-1) != 0)
        every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.key = every[np.searchsorted(anchor[at_key], of)] if len(cut) else every
        self.anchors = of


def _blocks(chunk: cs.Chunk, size: int = 1 << 20):
    a = 0
    while a < len(chunk.ids):
        b = max(a + 1, int(np.searchsorted(chunk.ends, chunk.starts[a] + size, side="right")))
        yield a, b
        a = b


def _ask(chunk: cs.Chunk, width: int, parts: int) -> list[tuple]:
    w = _Windows(chunk, width)
    _, once = np.unique(w.anchors, return_index=True)
    keys, counts = np.unique(w.key[once], return_counts=True)
    return cs.ask_rows(chunk.number, keys, [counts.astype(np.uint32)], parts)


def _verdicts(sums: list[np.ndarray], number: np.ndarray) -> bytes:
    """Of each anchor 0: occurs once, 1: is repeated, 2: is hot."""
    return cs.deflate(((sums[0] >= 2).astype(np.uint8) + (sums[0] > HOT))[number].tobytes())


def _divided(w: _Windows, data: bytes, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches ``hot`` by classes: first and last windows, and keys."""
    first, last, keys = [], [], []
    for i in hot.tolist():
        a, s, e = int(w.anchors[i]), int(w.first[i]), int(w.last[i])
        for c in range((a - e) // STEP, (a - s) // STEP + 1):
            lo, hi = max(s, a - c * STEP - STEP + 1), min(e, a - c * STEP)
            # Common to the windows that start from a - (c + 1) STEP + 1 to a - c STEP, whichever of them are here.
            core = data[a - c * STEP : a - (c + 1) * STEP + 1 + w.width]
            first.append(lo)
            last.append(hi)
            keys.append(int.from_bytes(hashlib.blake2b(core, digest_size=8, key=b"%d" % c).digest(), "little"))
    return np.array(first, np.int64), np.array(last, np.int64), np.array(keys, np.uint64)


def _stretches(chunk: cs.Chunk, back: dict, width: int, parts: int) -> list[tuple]:
    """Rows of ASK_SCHEMA: stretches by the partition of their anchor, equal ones once; and their places as
    the chunk's state."""
    w = _Windows(chunk, width)
    if not back or not len(w.key):
        return []
    keys, of = np.unique(w.key, return_inverse=True)
    said = np.concatenate([np.frombuffer(cs.inflate(back[p]), np.uint8) for p in sorted(back)])
    assert len(said) == len(keys)
    data = chunk.buf.tobytes()
    kept = np.flatnonzero(said[of] == 1)
    first, last, key = (np.concatenate([x[kept], y]) for x, y in zip((w.first, w.last, w.key), _divided(w, data, np.flatnonzero(said[of] == 2))))
    pid = cs.partition_of(key, parts)
    order = np.argsort(pid, kind="stable")
    first, last, pid = first[order], last[order], pid[order]
    rows, places = [], []
    cut = np.flatnonzero(np.diff(pid, prepend=-1, append=parts))
    for a, b in zip(cut[:-1], cut[1:]):
        if b == a:
            continue
        seen: dict[bytes, list[int]] = {}
        for s, e in zip(first[a:b].tolist(), (last[a:b] + width).tolist()):
            seen.setdefault(data[s:e], []).append(s)
        places += seen.values()
        sizes, times = (np.array([len(x) for x in y], np.uint32) for y in (seen, seen.values()))
        rows.append((int(pid[a]), chunk.number, len(seen), cs.deflate(sizes.tobytes() + times.tobytes() + b"".join(seen))))
    if rows:
        times, where = np.array([len(x) for x in places], np.int64), np.array([s for x in places for s in x], np.int64)
        rows.append((-1 - chunk.number % parts, chunk.number, len(places), cs.deflate(tk.planes(times) + tk.planes(where))))
    return rows


def suffix_array(text: np.ndarray, room: np.ndarray, depth: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of text by their first ``depth`` bytes at most, and for each pair of
    neighbours the length of the common prefix, up to depth (below ``least``: 0). Suffixes with less
    room than ``least`` are left out: none lies between two that share so much. room: bytes from each
    position to the end of its own string; prefixes don't go beyond it. Ranks are doubled: 8, 16,
    32, ... bytes; suffixes that are alone with their rank are not sorted again."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = np.zeros(n + depth + 8, np.uint8)
    wide[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key <<= np.uint64(8)
        key |= np.where(room > k, wide[k : k + n], np.uint8(0))
    # A string's end sorts before any byte: NUL bytes and ends are told apart by the room.
    rank = _refined(np.zeros(n, np.uint32), np.arange(n), key)
    tied = _tied(rank)
    rank = _refined(rank, tied, np.minimum(room[tied], 8).astype(np.uint64))
    ranks, size = [(8, rank)], 8
    while size < depth:
        step = min(size, depth - size)
        tied = _tied(rank)
        tied = tied[room[tied] >= size]  # shorter ones are equal for good
        nxt = np.zeros(len(tied), np.uint64)
        inside = room[tied] > step
        nxt[inside] = rank[tied[inside] + step] + np.uint64(1)
        rank = _refined(rank, tied, nxt)
        size += step
        ranks.append((size, rank))
    order = np.flatnonzero(room >= least)
    order = order[np.argsort(rank[order], kind="stable")]
    lcp = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    near = next((r for size, r in reversed(ranks) if size <= least), None)
    pair = np.arange(len(a)) if near is None else np.flatnonzero(near[a] == near[b])
    a, b = a[pair], b[pair]
    most = np.minimum(room[a], room[b]).astype(np.int64)
    total = np.where(rank[a] == rank[b], depth, 0)
    live = np.flatnonzero(total == 0)
    for size, r in reversed(ranks[:-1]):
        t = total[live]
        ok = most[live] >= t + size
        at = live[ok]
        total[at[r[a[at] + t[ok]] == r[b[at] + t[ok]]]] += size
    for _ in range(7):
        live = live[most[live] > total[live]]
        live = live[wide[a[live] + total[live]] == wide[b[live] + total[live]]]
        total[live] += 1
    total = np.minimum(total, most)
    lcp[pair + 1] = np.where(total >= least, total, 0)
    return order, lcp


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def _refined(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks (the number of smaller suffixes) once those of ``tied`` that are equal are told apart by key."""
    old = rank[tied]
    # The first keys, of eight bytes, come while no ranks are known; all others are ranks.
    order = np.argsort((old.astype(np.uint64) << np.uint64(32)) | key if old.any() else key)
    old, key = old[order], key[order]
    at = np.arange(len(order))
    head = np.concatenate([[True], old[1:] != old[:-1]]) if len(order) else np.zeros(0, bool)
    new = head.copy()
    new[1:] |= key[1:] != key[:-1]
    out = rank.copy()
    out[tied[order]] = old + (np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))).astype(np.uint32)
    return out


def intervals(order: np.ndarray, lcp: np.ndarray, least: int, left: np.ndarray) -> list[tuple[int, int, int]]:
    """(length, from, to) of the intervals of the common-prefix tree with at least that length
    whose occurrences differ in the byte on the left (left < 0: an edge, unlike all others)."""
    out = []
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return out
    byte = left[order]
    # From 0 up to i: how often the byte on the left differs from that of the neighbour.
    turn = np.zeros(len(order) + 1, np.int64)
    turn[2:] = np.cumsum((byte[1:] != byte[:-1]) | (byte[1:] < 0) | (byte[:-1] < 0))
    for part in np.split(deep, np.flatnonzero(np.diff(deep) != 1) + 1):
        lo = int(part[0])
        stack: list[tuple[int, int]] = []
        for i, x in enumerate(lcp[lo : int(part[-1]) + 1].tolist() + [0], lo):
            begin = i - 1
            while stack and stack[-1][0] > x:
                length, begin = stack.pop()
                if turn[i] > turn[begin + 1]:
                    out.append((length, begin, i))
            if x and (not stack or stack[-1][0] < x):
                stack.append((x, begin))
    return out


def repeat_groups(strings: list[bytes], times: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of at least that length among the strings, of which string k stands for
    times[k] equal ones: group, string, offset and length of each occurrence."""
    sizes = np.array([len(x) for x in strings], np.int64)
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(strings), np.uint8)
    room = (np.repeat(ends, sizes) - np.arange(len(text))).astype(np.int32)
    left = np.full(len(text), -1, np.int16)
    left[1:] = text[:-1]
    left[ends - sizes] = -1
    order, lcp = suffix_array(text, room, int(sizes.max()), least)
    found = intervals(order, lcp, least, left)
    number = np.repeat(np.arange(len(found)), [j - i for _, i, j in found]) if found else np.zeros(0, np.int64)
    at = np.concatenate([order[i:j] for _, i, j in found]) if found else np.zeros(0, np.int64)
    length = np.repeat([x for x, _, _ in found], [j - i for _, i, j in found]) if found else np.zeros(0, np.int64)
    of = np.searchsorted(ends, at, side="right")
    # A string with equal ones is a repeat as a whole, where no group has it beside others already.
    known = np.zeros(len(strings), bool)
    known[of[(at == (ends - sizes)[of]) & (length == sizes[of])]] = True
    whole = np.flatnonzero((times > 1) & (sizes >= least) & ~known)
    return (
        np.concatenate([number, len(found) + np.arange(len(whole))]),
        np.concatenate([of, whole]),
        np.concatenate([at - (ends - sizes)[of], np.zeros(len(whole), np.int64)]),
        np.concatenate([length, sizes[whole]]).astype(np.int64),
    )


def _groups(width: int):
    """The groups of a partition: to each chunk, for each of its stretches, group, offset and length."""

    def run(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(c).to_pylist() for c in ("pid", "chunk", "size", "data"))))
        if rows[0][0] < 0:
            return group.select(cs.ASK_ARROW.names)
        index: dict[bytes, int] = {}
        total: list[int] = []
        held = []
        for _, chunk, n, data in rows:
            raw = cs.inflate(data)
            sizes, times = np.split(np.frombuffer(raw, np.uint32, 2 * n).astype(np.int64), 2)
            end = np.cumsum(sizes) + 8 * n
            ids = np.empty(n, np.int64)
            for k, (a, b) in enumerate(zip((end - sizes).tolist(), end.tolist())):
                i = index.setdefault(raw[a:b], len(index))
                if i == len(total):
                    total.append(0)
                total[i] += int(times[k])
                ids[k] = i
            held.append((chunk, ids))
        number, string, offset, length = repeat_groups(list(index), np.array(total, np.int64), width)
        order = np.lexsort((offset, string))
        number, string, offset, length = number[order], string[order], offset[order], length[order]
        first = np.searchsorted(string, np.arange(len(index) + 1))
        out = []
        for chunk, ids in held:
            count = first[ids + 1] - first[ids]
            pick = np.repeat(first[ids] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            out.append((rows[0][0], chunk, len(ids), cs.deflate(b"".join(map(tk.planes, (count, number[pick], offset[pick], length[pick]))))))
        return cs.rows_to_arrow(out, cs.ASK_ARROW)

    return run


def occurrences(back: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, start in the chunk, and length of what came back to a chunk."""
    state = next((v for k, v in back.items() if k < 0), None)
    if state is None:
        return (np.zeros(0, np.int64),) * 3
    counts, parts = [], []
    for pid in sorted(k for k in back if k >= 0):
        n, raw = back[pid][0], cs.inflate(back[pid][1])
        counts.append(tk.unplanes(raw[: 8 * n], np.int64))
        number, offset, length = (tk.unplanes(x, np.int64) for x in np.split(np.frombuffer(raw, np.uint8, offset=8 * n), 3))
        parts.append(((np.int64(pid) << 32) + number, offset, length))
    count = np.concatenate(counts)
    group, offset, length = (np.concatenate(x) for x in zip(*parts))
    raw = cs.inflate(state[1])
    times, where = tk.unplanes(raw[: 8 * len(count)], np.int64), tk.unplanes(raw[8 * len(count) :], np.int64)
    # Each place of a stretch has all the groups of the stretch.
    of = np.repeat(np.arange(len(count)), times)
    each = count[of]
    pick = np.repeat((np.cumsum(count) - count)[of] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    return group[pick], np.repeat(where, each) + offset[pick], length[pick]


def _places(chunk: cs.Chunk, back: dict) -> pa.Table:
    group, start, length = occurrences(back)
    # Empty documents start where the next one does: the last that starts there has the bytes.
    doc = np.searchsorted(chunk.starts, start, side="right") - 1
    ids = pa.array(chunk.ids, pa.int64()).take(pa.array(doc))
    return pa.Table.from_arrays([pa.array(group), pa.array(length), ids, pa.array(start - chunk.starts[doc] if len(doc) else start)], schema=_PLACES)


def _finish(chunk: cs.Chunk, back: dict) -> pa.Table:
    _, start, length = occurrences(back)
    step = np.bincount(start, minlength=len(chunk.buf) + 1) - np.bincount(start + length, minlength=len(chunk.buf) + 1)
    gone = np.cumsum(step[:-1]) > 0
    rows = []
    for doc, a, b in zip(chunk.ids, chunk.starts.tolist(), chunk.ends.tolist()):
        out = gone[a:b]
        s, e = tk.runs(out)
        kept = chunk.buf[a:b]
        rows.append((doc, b - a, int(out.sum()), len(s), [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())], hashlib.sha256((kept[~out] if len(s) else kept).tobytes()).hexdigest()))
    return cs.rows_to_arrow(rows, _OUT)


def repeats(base: cs.Store, min_bytes: int) -> DataFrame:
    """Groups of maximal repeats by chunk, and the chunks' places (rows of ASK_SCHEMA; see ``occurrences``)."""
    asking = base.partitions(base.total_bytes / 40, 1 << 20)
    sorting = base.partitions(base.total_bytes * 0.8, _BYTES_EACH)

    def begin(batches):
        for batch in batches:
            for chunk in cs.chunks_in(batch):
                yield from cs.rows_to_arrow(_ask(chunk, min_bytes, asking), cs.ASK_ARROW).to_batches()

    def gather(chunk, back):
        return cs.rows_to_arrow(_stretches(chunk, back, min_bytes, sorting), cs.ASK_ARROW)

    asked = base.df.mapInArrow(begin, cs.ASK_SCHEMA)
    stretches = cs.by_chunk(base, cs.answer(asked, 1, _verdicts), gather, cs.ASK_SCHEMA)
    return stretches.groupBy("pid").applyInArrow(_groups(min_bytes), cs.ASK_SCHEMA)


def maximal_repeats(docs: DataFrame, min_bytes: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All occurrences of all groups (OCCURRENCES): bytes ``start`` to ``start + length`` of the document."""
    base = cs.store(docs, id_col, text_col)
    return cs.by_chunk(base, repeats(base, min_bytes), _places, OCCURRENCES, sized=True)


def dedup_suffixes(docs: DataFrame, min_bytes: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte ranges to remove from each document (``removed``), and a digest of what is kept."""
    base = cs.store(docs, id_col, text_col)
    return cs.by_chunk(base, repeats(base, min_bytes), _finish, SCHEMA, sized=True)
