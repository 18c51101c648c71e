"""Conversion of single files. Whole collections go through the data sources: spark.read.format("ttl"), write.format("hdt")."""

from __future__ import annotations

import os
from collections.abc import Iterable
from contextlib import contextmanager

from .sources import codec, turtle
from .sources.datasource import read_bytes, write_bytes

Path = str | os.PathLike


@contextmanager
def _named(what: str):
    """Failures of reading, parsing and writing as ValueError that names the operation."""
    try:
        yield
    except (OSError, ValueError, IndexError, KeyError) as e:
        raise ValueError(f"{what}: {e}") from e


def _triples(path: Path):
    return zip(*codec.decode(read_bytes(os.fspath(path))).search({}))


def ttl2hdt(source: Path, target: Path, *, base_uri: str | None = None) -> None:
    """Turtle to HDT. An empty graph has no HDT form: ValueError."""
    with _named(f"ttl2hdt {source}"):
        write_bytes(os.fspath(target), codec.encode(turtle.parse(read_bytes(os.fspath(source)).decode("utf-8-sig"), base_uri or "")))


def hdt2ttl(source: Path, target: Path) -> None:
    with _named(f"hdt2ttl {source}"):
        write_bytes(os.fspath(target), "".join(turtle.serialize(sorted(_triples(source)))).encode("utf-8"))


def hdtcat(inputs: Iterable[Path], target: Path) -> None:
    """The set of the triples of two files or more; blank nodes of one label are one node."""
    inputs = list(inputs)
    if len(inputs) < 2:
        raise ValueError("hdtcat needs two inputs or more")
    with _named("hdtcat"):
        write_bytes(os.fspath(target), codec.encode(t for path in inputs for t in _triples(path)))
