"""The mapping of graphs to files, and statistics of the files by which patterns are pruned and ordered."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import SparkSession

from .sources import codec
from .sources.datasource import read_bytes

VERSION = 1


class MappingError(ValueError):
    """The mapping file is unusable."""


@dataclass(frozen=True)
class Mapping:
    graphs: dict[str, tuple[str, ...]]
    source: str

    @property
    def urns(self) -> list[str]:
        return list(self.graphs)

    def files_for(self, urn: str) -> list[str]:
        if urn not in self.graphs:
            raise MappingError(f"unknown graph {urn!r}; known: {', '.join(self.graphs)}")
        return list(self.graphs[urn])

    def __contains__(self, urn: str) -> bool:
        return urn in self.graphs

    def __len__(self) -> int:
        return len(self.graphs)

    def __iter__(self) -> Iterator[str]:
        return iter(self.graphs)


def mapping_path(target) -> str:
    target = os.fspath(target)
    return os.path.join(target, "map.json") if os.path.isdir(target) else target


def load_mapping(target) -> Mapping:
    """A folder with map.json, or such a file; all of it or MappingError. Relative paths start at its folder."""
    source = os.path.abspath(mapping_path(target))

    def once(pairs):
        names = [k for k, _ in pairs]
        twice = next((k for k in names if names.count(k) > 1), None)
        if twice is not None:
            raise MappingError(f"graph {twice!r} occurs twice")
        return dict(pairs)

    try:
        with open(source, encoding="utf-8") as f:
            raw = json.load(f, object_pairs_hook=once)
    except OSError as e:
        raise MappingError(f"cannot read {source}: {e}") from e
    except (json.JSONDecodeError, UnicodeDecodeError) as e:
        raise MappingError(f"{source} is not JSON: {e}") from e
    if not isinstance(raw, dict):
        raise MappingError(f"{source} must hold an object")
    graphs = {}
    for urn, files in raw.items():
        if not isinstance(files, list) or not all(isinstance(f, str) for f in files):
            raise MappingError(f"{urn}: the files must be a list of strings")
        if not files:
            raise MappingError(f"{urn}: no files")
        paths = []
        for f in files:
            if not f.endswith(".hdt"):
                raise MappingError(f"{urn}: {f} is not an .hdt file")
            path = os.path.normpath(os.path.join(os.path.dirname(source), f))
            if not os.path.isfile(path):
                raise MappingError(f"{urn}: {f} does not exist")
            paths.append(path)
        graphs[urn] = tuple(dict.fromkeys(paths))
    return Mapping(graphs, source)


@dataclass
class FileStats:
    path: str
    size: int
    mtime: float
    triple_count: int
    subject_count: int
    object_count: int
    predicates: dict[str, int] = field(default_factory=dict)
    #: The least and the greatest subject, by bytes; not part of the saved file's entry.
    span: tuple[str, str] | None = None

    def saved(self, base: str) -> dict:
        """What a catalog file holds of it, its path from that folder."""
        out = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "span"}
        return out | {"path": os.path.relpath(self.path, base)}

    @classmethod
    def restored(cls, entry: dict, base: str, spans: dict) -> FileStats:
        span = spans.get(entry["path"])
        return cls(**entry | {"path": os.path.normpath(os.path.join(base, entry["path"])), "span": tuple(span) if span else None})

    def is_current(self, path: str) -> bool:
        try:
            return file_state(path) == (self.size, self.mtime)
        except OSError:
            return False


def file_state(path: str) -> tuple[int, float]:
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        info = system.get_file_info(inner)
        return info.size or 0, (info.mtime_ns or 0) / 1e9
    now = os.stat(path)
    return now.st_size, now.st_mtime


def file_stats(path: str) -> FileStats:
    size, mtime = file_state(path)
    g = codec.decode(read_bytes(path), verify=False)
    return FileStats(path, size, mtime, len(g), g.subject_count, g.object_count, g.predicate_counts(), g.subject_span())


@dataclass
class UrnStats:
    """Sums over the files of a graph: files that overlap count twice."""

    urn: str
    files: list[FileStats]

    @property
    def triple_count(self) -> int:
        return sum(f.triple_count for f in self.files)

    @property
    def subject_count(self) -> int:
        return sum(f.subject_count for f in self.files)

    @property
    def object_count(self) -> int:
        return sum(f.object_count for f in self.files)

    def predicate_count(self, predicate: str) -> int:
        return sum(f.predicates.get(predicate, 0) for f in self.files)

    def files_with_predicate(self, predicate: str | None) -> list[str] | None:
        return None if predicate is None else [f.path for f in self.files if predicate in f.predicates]


class Catalog:
    """Opening reads a saved catalog next to the mapping where it is current; only save() writes."""

    def __init__(self, mapping: Mapping, stats: dict[str, UrnStats], cache: str, spark: SparkSession | None = None):
        self.mapping, self.stats, self.cache, self.spark = mapping, stats, cache, spark

    @classmethod
    def load(cls, mapping: Mapping, cache: str | None = None, save: bool = False, spark: SparkSession | None = None) -> Catalog:
        cache = cache or os.path.splitext(mapping.source)[0] + ".catalog.json"
        have: dict[str, UrnStats] = {}
        try:
            with open(cache, encoding="utf-8") as f:
                raw = json.load(f)
            if raw["version"] == VERSION:
                base = os.path.dirname(mapping.source)
                for urn, u in raw["urns"].items():
                    have[urn] = UrnStats(urn, [FileStats.restored(x, base, raw.get("spans", {})) for x in u["files"]])
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            have = {}
        out = cls(mapping, {}, cache, spark)
        stale = [u for u in mapping if u not in have or [f.path for f in have[u].files] != mapping.files_for(u) or not all(f.is_current(f.path) for f in have[u].files)]
        out.stats = {u: s for u, s in have.items() if u in mapping and u not in stale}
        out._build(stale)
        if save and stale:
            out.save()
        return out

    def _build(self, urns: list[str]) -> None:
        """Files are read by tasks where a session is given; a row of statistics for each file comes back."""
        paths = list(dict.fromkeys(p for u in urns for p in self.mapping.files_for(u)))
        if self.spark is not None and len(paths) > 1:
            import pandas as pd

            def stats(frames):
                for frame in frames:
                    yield pd.DataFrame({"stats": [json.dumps(asdict(file_stats(p))) for p in frame["path"]]})

            rows = self.spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 4 * self.spark.sparkContext.defaultParallelism)).mapInPandas(stats, "stats string").collect()
            by = {x["path"]: FileStats(**x) for x in (json.loads(r.stats) for r in rows)}
        else:
            by = {p: file_stats(p) for p in paths}
        for u in urns:
            self.stats[u] = UrnStats(u, [by[p] for p in self.mapping.files_for(u)])

    def rebuild(self, urn: str | None = None, save: bool = True) -> None:
        self._build([urn] if urn is not None else self.mapping.urns)
        if save:
            self.save()

    def save(self) -> None:
        base = os.path.dirname(self.mapping.source)
        urns = {u: {"urn": u, "files": [f.saved(base) for f in s.files]} for u, s in self.stats.items()}
        spans = {os.path.relpath(f.path, base): f.span for s in self.stats.values() for f in s.files if f.span}
        aside = f"{self.cache}.{uuid.uuid4().hex}"
        with open(aside, "w", encoding="utf-8") as f:
            json.dump({"version": VERSION, "built_at": time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime()), "mapping": self.mapping.source, "urns": urns, "spans": spans}, f, indent=2)
        os.replace(aside, self.cache)

    def stats_for(self, urn: str) -> UrnStats:
        return self.stats[urn]

    @property
    def urns(self) -> list[str]:
        return [u for u in self.mapping if u in self.stats]

    def triple_count(self, urn: str | None = None) -> int:
        return self.stats[urn].triple_count if urn is not None else sum(s.triple_count for s in self.stats.values())

    def files_with_predicate(self, urn: str, predicate: str | None) -> list[str] | None:
        return self.stats[urn].files_with_predicate(predicate)

    def may_overlap(self, urn: str, files: list[str]) -> bool:
        """Whether two of a graph's files may hold the same triple: not if their subjects lie apart."""
        known = {f.path: f.span for f in self.stats[urn].files} if urn in self.stats else {}
        spans = sorted(tuple(x.encode() for x in known[f]) if known.get(f) else (b"", b"") for f in files)
        return any(b"" in a or a[1] >= b[0] for a, b in zip(spans, spans[1:]))

    def __contains__(self, urn: str) -> bool:
        return urn in self.stats

    def __iter__(self) -> Iterator[UrnStats]:
        return (self.stats[u] for u in self.urns)
