"""The HDT container (version 1, four-section dictionary, bitmap triples in SPO order) in NumPy.

A file is read by one task: it is an interchange format, and many files make many tasks. Patterns are matched on
integer ids; constants are looked up by binary search over blocks, and only blocks with terms of matching rows are decoded.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 16
GLOBAL, HEADER, DICTIONARY, TRIPLES = 1, 2, 3, 4
# Fixed values of the format.
CONTAINER = "<http://purl.org/HDT/hdt#HDTv1>"
FOUR = "<http://purl.org/HDT/hdt#dictionaryFour>"
BITMAP = "<http://purl.org/HDT/hdt#triplesBitmap>"


# Checksums.
def _table(poly: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(poly), t >> 1)
    return t


_C32, _C16 = _table(0x82F63B78), _table(0xA001)
_ROW = 1 << 11


def crc8(data: bytes) -> int:
    c = 0
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c << 1) & 0xFF ^ (7 if c & 0x80 else 0)
    return c


def crc16(data: bytes) -> int:
    c = 0
    for x in data:
        c = c >> 8 ^ int(_C16[(c ^ x) & 0xFF])
    return c


def _apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map over bits, given by the images of the 32 unit vectors."""
    out = np.zeros_like(x)
    for i in range(32):
        out ^= np.where(x >> np.uint32(i) & np.uint32(1), op[i], np.uint32(0))
    return out


def _advance(c: np.ndarray) -> np.ndarray:
    return c >> np.uint32(8) ^ _C32[c & np.uint32(0xFF)]


def crc32c(data: bytes) -> int:
    """Rows of the buffer advance together; since the sum is linear, pairs of rows are then folded."""
    if len(data) < 4 * _ROW:
        c = 0xFFFFFFFF
        for x in data:
            c = c >> 8 ^ int(_C32[(c ^ x) & 0xFF])
        return c ^ 0xFFFFFFFF
    rows = 1 << (-(-len(data) // _ROW) - 1).bit_length()
    buffer = np.zeros(rows * _ROW, dtype=np.uint8)  # leading zeros do not alter a sum that starts at 0
    buffer[-len(data) :] = np.frombuffer(data, dtype=np.uint8)
    buffer[-len(data) : len(buffer) - len(data) + 4] ^= 0xFF  # the same as a start at all ones
    steps = np.ascontiguousarray(buffer.reshape(rows, _ROW).T).astype(np.uint32)
    c = np.zeros(rows, dtype=np.uint32)
    for column in steps:
        c = _advance(c ^ column)
    op = _advance(np.uint32(1) << np.arange(32, dtype=np.uint32))
    for _ in range(_ROW.bit_length() - 1):
        op = _apply(op, op)
    while len(c) > 1:
        c = _apply(op, c[0::2]) ^ c[1::2]
        op = _apply(op, op)
    return int(c[0]) ^ 0xFFFFFFFF


# Numbers and arrays.
def vbyte(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127)
        n >>= 7
    out.append(n | 128)
    return bytes(out)


def bits_needed(n: int) -> int:
    return max(1, int(n).bit_length())


def pack(values: np.ndarray, width: int) -> bytes:
    values = np.asarray(values, dtype=np.uint64)
    bits = np.empty((len(values), width), dtype=np.uint8)
    for i in range(width):
        bits[:, i] = values >> np.uint64(i) & np.uint64(1)
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    out, step = np.zeros(n, dtype=np.int64), 1 << 16  # blocks of whole bytes
    for a in range(0, n, step):
        k = min(step, n - a)
        at = a * width // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-k * width // 8), at), bitorder="little")[: k * width].reshape(k, width)
        for i in range(width):
            out[a : a + k] |= bits[:, i].astype(np.int64) << i
    return out


class Reader:
    def __init__(self, data: bytes, verify: bool = True):
        self.data, self.at, self.verify = data, 0, verify

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("truncated HDT file")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        n = shift = 0
        while True:
            x = self.take(1)[0]
            n |= (x & 127) << shift
            if x & 128:
                return n
            shift += 7

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise ValueError("truncated HDT file")
        out = self.take(end - self.at).decode("utf-8")
        self.at += 1
        return out

    def head_sum(self, start: int) -> None:
        if crc8(self.data[start : self.at]) != self.take(1)[0]:
            raise ValueError("checksum of a section header differs")

    def payload(self, n: int) -> bytes:
        body = self.take(n)
        want = int.from_bytes(self.take(4), "little")
        if self.verify and crc32c(body) != want:
            raise ValueError("checksum of a section differs")
        return body

    def control(self, kind: int) -> tuple[str, dict[str, str]]:
        start = self.at
        if self.take(4) != b"$HDT" or self.take(1)[0] != kind:
            raise ValueError("not an HDT file, or a section is missing")
        form, props = self.text(), self.text()
        if crc16(self.data[start : self.at]) != int.from_bytes(self.take(2), "little"):
            raise ValueError("checksum of a control section differs")
        return form, dict(x.split("=", 1) for x in props.split(";") if "=" in x)

    def array(self) -> np.ndarray:
        start = self.at
        if self.take(1)[0] != 1:
            raise ValueError("unknown array type")
        width = self.take(1)[0]
        n = self.number()
        self.head_sum(start)
        return unpack(self.payload(-(-n * width // 8)), n, width)

    def bitmap(self) -> np.ndarray:
        start = self.at
        if self.take(1)[0] != 1:
            raise ValueError("unknown bitmap type")
        n = self.number()
        self.head_sum(start)
        return np.unpackbits(np.frombuffer(self.payload(-(-n // 8)), np.uint8), bitorder="little")[:n]

    def strings(self) -> Section:
        start = self.at
        if self.take(1)[0] != 2:
            raise ValueError("unknown dictionary section type")
        n, size, block = self.number(), self.number(), self.number()
        self.head_sum(start)
        starts = self.array()
        return Section(n, block, starts, np.frombuffer(self.payload(size), np.uint8))


def copy_runs(target: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, n: np.ndarray) -> None:
    """target[to:to+n] = source[start:start+n] for each run, some 4 MB of runs (or one longer run) at a time."""
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + (1 << 22), side="right")))
        if b == a + 1:
            target[to[a] : to[a] + n[a]] = source[start[a] : start[a] + n[a]]
        else:
            k = n[a:b]
            at = np.arange(ends[b - 1] - done) - np.repeat(ends[a:b] - k - done, k)
            target[np.repeat(to[a:b], k) + at] = source[np.repeat(start[a:b], k) + at]
        a = b


def _flat(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of large strings or binaries, and where each value begins and the last one ends."""
    if not len(terms):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = terms.buffers()
    offsets = np.frombuffer(offsets, np.int64)[terms.offset : terms.offset + len(terms) + 1]
    return np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Section:
    """A front-coded section in the order of bytes. Blocks are decoded on demand, all of a call side by side."""

    def __init__(self, n: int, block: int, starts: np.ndarray, body: np.ndarray):
        blocks = -(-n // block) if block else 0
        if n and (not block or len(starts) < blocks or starts[0] or (np.diff(starts[:blocks]) <= 0).any() or starts[blocks - 1] >= len(body)):
            raise ValueError("damaged dictionary section")
        self.n, self.block, self.starts, self.body = n, block, starts[:blocks], body
        self.ends = np.flatnonzero(body == 0)

    def __len__(self) -> int:
        return self.n

    def _numbers(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers that begin at these bytes, and the places after them."""
        value, at, live, shift = np.zeros(len(at), np.int64), at.copy(), np.arange(len(at)), 0
        while len(live):
            if shift > 56 or at[live].max() >= len(self.body):
                raise ValueError("damaged dictionary section")
            x = self.body[at[live]]
            value[live] |= (x & 127).astype(np.int64) << shift
            at[live] += 1
            live, shift = live[x < 128], shift + 7
        return value, at

    def terms(self, blocks: np.ndarray) -> pa.Array:
        """The terms of these blocks, in their order."""
        held = np.minimum(self.block, self.n - blocks * self.block)
        first = np.cumsum(held) - held
        shared, start, size = (np.zeros(int(held.sum()), np.int64) for _ in range(3))
        at = self.starts[blocks]
        rounds = []  # rows of the first, second, ... term of every block
        for j in range(int(held.max(initial=0))):
            live = np.flatnonzero(held > j)
            row = first[live] + j
            begin = at[live]
            if j:
                shared[row], begin = self._numbers(begin)
            end = np.searchsorted(self.ends, begin)
            if end.max() >= len(self.ends):
                raise ValueError("damaged dictionary section")
            start[row], size[row] = begin, self.ends[end] - begin
            if j and (shared[row] > shared[row - 1] + size[row - 1]).any():
                raise ValueError("damaged dictionary section")
            at[live] = self.ends[end] + 1
            rounds.append(row)
        offsets = np.append(0, np.cumsum(shared + size))
        out = np.empty(offsets[-1], np.uint8)
        copy_runs(out, offsets[:-1] + shared, self.body, start, size)
        for row in rounds[1:]:
            copy_runs(out, offsets[row], out, offsets[row - 1], shared[row])
        terms = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(out))
        terms.validate(full=True)
        return terms

    def at(self, i: int) -> bytes:
        return self.terms(np.array([i // self.block]))[i % self.block].as_py().encode()

    def find(self, term: str) -> int:
        """The place of a term, from 0, or -1: blocks begin with whole terms, so one block is decoded."""
        want = term.encode()

        def head(i: int) -> bytes:
            return self.body[self.starts[i] : self.ends[np.searchsorted(self.ends, self.starts[i])]].tobytes()

        i = bisect_right(range(len(self.starts)), want, key=head) - 1
        if i < 0:
            return -1
        held = self.terms(np.array([i])).to_pylist()
        return i * self.block + held.index(term) if term in held else -1


def control(kind: int, form: str, props: str = "") -> bytes:
    out = b"$HDT" + bytes([kind]) + form.encode() + b"\0" + props.encode() + b"\0"
    return out + crc16(out).to_bytes(2, "little")


def with_sums(head: bytes, body: bytes) -> bytes:
    return head + bytes([crc8(head)]) + body + crc32c(body).to_bytes(4, "little")


def array(values) -> bytes:
    width = bits_needed(max(values, default=0) if isinstance(values, list) else int(values.max(initial=0)))
    return with_sums(b"\1" + bytes([width]) + vbyte(len(values)), pack(values, width))


def bitmap(bits: np.ndarray) -> bytes:
    return with_sums(b"\1" + vbyte(len(bits)), np.packbits(bits.astype(np.uint8), bitorder="little").tobytes())


def shared_prefixes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes that each term has in common with the one before it, compared 32 at a time."""
    width, step = 32, 1 << 16
    size = np.diff(offsets)
    out, most = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    most[1:] = np.minimum(size[1:], size[:-1])
    windows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(width, np.uint8)), width)
    live = np.flatnonzero(most)
    while len(live):
        left = []
        for a in range(0, len(live), step):
            part = live[a : a + step]
            differ = windows[offsets[part] + out[part]] != windows[offsets[part - 1] + out[part]]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            out[part] += same
            left.append(part[(same == width) & (out[part] < most[part])])
        live = np.concatenate(left)
    return np.minimum(out, most)


def strings(terms: pa.Array) -> tuple[bytes, int]:
    """A front-coded section, and the size of its buffer."""
    data, offsets = _flat(terms)
    shared = shared_prefixes(data, offsets)
    shared[::BLOCK] = 0
    inner = np.arange(len(shared)) % BLOCK != 0
    digits = inner.astype(np.int64)
    while (more := inner & (shared >> 7 * digits > 0)).any():
        digits += more
    length = digits + np.diff(offsets) - shared + 1
    ends = np.cumsum(length)
    size = int(ends[-1]) if len(ends) else 0
    body = np.zeros(size, np.uint8)
    for k in range(int(digits.max(initial=0))):
        live = np.flatnonzero(digits > k)
        body[(ends - length)[live] + k] = shared[live] >> 7 * k & 127 | np.where(digits[live] == k + 1, 128, 0)
    copy_runs(body, ends - length + digits, data, offsets[:-1] + shared, np.diff(offsets) - shared)
    head = b"\2" + vbyte(len(shared)) + vbyte(size) + vbyte(BLOCK)
    starts = np.append((ends - length)[::BLOCK], size)
    payload = body.tobytes()
    return head + bytes([crc8(head)]) + array(starts) + payload + crc32c(payload).to_bytes(4, "little"), size


@dataclass
class Graph:
    """A file: dictionary sections, decoded as needed, and id columns, sorted by subject, predicate, object."""

    shared: Section
    subjects: Section
    predicates: Section
    objects: Section
    s: np.ndarray
    p: np.ndarray
    o: np.ndarray

    def __len__(self) -> int:
        return len(self.s)

    @property
    def subject_count(self) -> int:
        return len(self.shared) + len(self.subjects)

    @property
    def object_count(self) -> int:
        return len(self.shared) + len(self.objects)

    def subject_span(self) -> tuple[str, str] | None:
        """The least and the greatest subject, in the order of bytes."""
        ends = [part.at(i) for part in (self.shared, self.subjects) if len(part) for i in (0, len(part) - 1)]
        return (min(ends).decode(), max(ends).decode()) if ends else None

    def predicate_counts(self) -> dict[str, int]:
        n = np.bincount(self.p, minlength=len(self.predicates) + 1)[1:]
        return {t: int(k) for t, k in zip(self._terms("p", np.arange(len(n)))[0].to_pylist(), n)}

    def _sections(self, k: str) -> list[Section]:
        return {"s": [self.shared, self.subjects], "p": [self.predicates], "o": [self.shared, self.objects]}[k]

    def _terms(self, k: str, ids: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Terms that hold all of these ids (from 0), and the place of each id among them."""
        parts, places, before, base = [], np.empty(len(ids), np.int64), 0, 0
        for section in self._sections(k):
            mine = np.flatnonzero((ids >= base) & (ids < base + len(section)))
            if len(mine):
                own = ids[mine] - base
                used = np.zeros(len(section.starts), dtype=bool)
                used[own // section.block] = True
                parts.append(section.terms(np.flatnonzero(used)))
                places[mine] = before + (np.cumsum(used) - 1)[own // section.block] * section.block + own % section.block
                before += len(parts[-1])
            base += len(section)
        return pa.concat_arrays(parts) if parts else pa.array([], pa.large_string()), places

    def _rows(self, fixed: dict[str, str]) -> np.ndarray:
        keep = np.ones(len(self.s), dtype=bool)
        for k, term in fixed.items():
            found, base = 0, 1
            for section in self._sections(k):
                i = section.find(term)
                found, base = found if i < 0 else base + i, base + len(section)
            if not found:
                return np.empty(0, np.int64)
            keep &= getattr(self, k) == found
        return np.flatnonzero(keep)

    def search(self, fixed: dict[str, str]) -> list[np.ndarray]:
        """Columns of terms, as strings, of the triples that agree with the fixed positions (of s, p, o)."""
        rows = self._rows(fixed)
        columns = (self._terms(k, getattr(self, k)[rows] - 1) for k in "spo")
        return [terms.to_numpy(zero_copy_only=False)[places] for terms, places in columns]

    def batches(self, fixed: dict[str, str], step: int) -> Iterator[list[pa.Array]]:
        """The same as Arrow columns, some rows at a time; each term is decoded once."""
        rows = self._rows(fixed)
        columns = [self._terms(k, getattr(self, k)[rows] - 1) for k in "spo"]
        for a in range(0, len(rows), step):
            yield [terms.take(pa.array(places[a : a + step])) for terms, places in columns]


def decode(data: bytes, verify: bool = True) -> Graph:
    """ValueError where the bytes are no HDT file of this kind, or damaged."""
    r = Reader(data, verify)
    r.control(GLOBAL)
    _, props = r.control(HEADER)
    if not props.get("length", "").isdigit():
        raise ValueError("the header names no length")
    r.take(int(props["length"]))
    form, _ = r.control(DICTIONARY)
    if form != FOUR:
        raise ValueError(f"unknown dictionary {form}")
    shared, subjects, predicates, objects = (r.strings() for _ in range(4))
    form, props = r.control(TRIPLES)
    if form != BITMAP or props.get("order") != "1":
        raise ValueError("only bitmap triples in SPO order are supported")
    by, bz, y, z = r.bitmap(), r.bitmap(), r.array(), r.array()
    if len(by) != len(y) or len(bz) != len(z):
        raise ValueError("bitmaps and arrays differ in length")
    pair = np.cumsum(bz, dtype=np.int64) - bz
    subject = np.cumsum(by, dtype=np.int64) - by + 1
    if len(z) and (pair[-1] >= len(y) or z.max() > len(shared) + len(objects) or y.max() > len(predicates) or subject.max() > len(shared) + len(subjects)):
        raise ValueError("an id is out of range")
    return Graph(shared, subjects, predicates, objects, subject[pair], y[pair], z)


def _coded(column) -> tuple[np.ndarray, pa.Array]:
    """Codes of a column of terms, and its distinct terms in the order of their bytes."""
    coded = (column if isinstance(column, pa.Array) else pa.array(column, pa.large_string())).dictionary_encode()
    terms = coded.dictionary.cast(pa.large_binary())
    order = pc.sort_indices(terms).to_numpy()
    rank = np.empty(len(terms), dtype=np.int64)
    rank[order] = np.arange(len(terms))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], terms.take(pa.array(order))


def _ids(terms: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of sorted terms where those among the others come first, and which ones these are."""
    first = pc.is_in(terms, value_set=others).to_numpy(zero_copy_only=False)
    return np.where(first, np.cumsum(first), first.sum() + np.cumsum(~first)), first


def encode(triples) -> bytes:
    """A file of a set of triples of canonical terms; ValueError for none, or for a term with NUL."""
    columns = list(zip(*triples))
    return encode_columns(*columns or ([], [], []))


def encode_columns(s, p, o) -> bytes:
    """The same for columns of terms: sequences of strings, or Arrow arrays of large strings."""
    if not len(s):
        raise ValueError("a graph without triples cannot be written")
    (s, subjects), (p, predicates), (o, objects) = map(_coded, (s, p, o))
    if any((_flat(part)[0] == 0).any() for part in (subjects, predicates, objects)):
        raise ValueError("a term with U+0000 cannot be written")
    sid, both = _ids(subjects, objects)
    oid, known = _ids(objects, subjects)
    parts = [subjects.filter(pa.array(both)), subjects.filter(pa.array(~both)), predicates, objects.filter(pa.array(~known))]
    s, p, o = sid[s], p + 1, oid[o]
    order = np.lexsort((o, p, s))
    s, p, o = s[order], p[order], o[order]
    new = np.append(True, (s[1:] != s[:-1]) | (p[1:] != p[:-1]) | (o[1:] != o[:-1]))
    s, p, o = s[new], p[new], o[new]
    last_pair = np.append((s[1:] != s[:-1]) | (p[1:] != p[:-1]), True)
    ps, py = s[last_pair], p[last_pair]
    last_subject = np.append(ps[1:] != ps[:-1], True)
    sections = [strings(x) for x in parts]
    return b"".join([
        control(GLOBAL, CONTAINER),
        control(HEADER, "ntriples", "length=0;"),
        control(DICTIONARY, FOUR, f"mapping=1;sizeStrings={sum(n for _, n in sections)};"),
        *(x for x, _ in sections),
        control(TRIPLES, BITMAP, "order=1;"),
        bitmap(last_subject),
        bitmap(last_pair),
        array(py),
        array(o),
    ])
