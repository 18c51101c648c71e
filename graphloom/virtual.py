"""A view of Parquet tables as RDF graphs, without making triples.

Graph ``urn:tab:<table>``; subject ``urn:<table>:<key>``; predicate ``urn:col:<column>``; class
``urn:class:<Table>``. Foreign keys are IRIs of the other table (and literals under
``urn:col:<column>_raw``). Tables without a key have blank nodes made of a digest of the row.
A ``Schema`` names the keys; one can be read from a JSON file with its fields.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .terms import Kind

COL, CLASS, TAB = "urn:col:", "urn:class:", "urn:tab:"
_KINDS = {"bigint": "int", "int": "int", "smallint": "int", "double": "double", "float": "double", "string": "str", "boolean": "bool", "timestamp": "time", "timestamp_ntz": "time", "date": "date"}


@dataclass(frozen=True)
class Schema:
    """keys: by table its key column, or several, joined by a hyphen. foreign: by column the table that it names.
    same: by table and column ("t.c") the table whose keys it shares, without a literal beside. following: by table a
    predicate, the column of a group and that of places in it: each row names the row of the next place."""

    keys: dict[str, str | tuple[str, ...]] = field(default_factory=dict)
    foreign: dict[str, str] = field(default_factory=dict)
    same: dict[str, str] = field(default_factory=dict)
    following: dict[str, tuple[str, str, str]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Schema:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        pairs = {k: {n: tuple(v) if isinstance(v, list) else v for n, v in part.items()} for k, part in raw.items()}
        return cls(**pairs)


@dataclass
class Table:
    name: str
    df: DataFrame
    #: Column names that need more than the table, and the frame with what they need.
    derived: frozenset = frozenset()
    wide: DataFrame | None = None
    columns: dict[str, tuple[Column, Kind]] = field(default_factory=dict)
    subject: tuple[Column, Kind] | None = None


class VirtualGraphs:
    def __init__(self, spark: SparkSession, folder: str, names: list[str], schema: Schema = Schema()):
        self.spark, self.schema = spark, schema
        self.tables = {n: self._table(n, spark.read.parquet(f"{folder}/{n}.parquet")) for n in names}

    @property
    def urns(self) -> list[str]:
        return [TAB + n for n in self.tables]

    def _table(self, name: str, df: DataFrame) -> Table:
        t, schema = Table(name, df), self.schema
        for column, kind in df.dtypes:
            if kind not in _KINDS:
                continue
            c = F.col(column)
            if column in schema.foreign:
                t.columns[column] = (c.cast("bigint"), Kind("iri", f"urn:{schema.foreign[column]}:"))
                t.columns[column + "_raw"] = (c.cast("bigint"), Kind("int"))
            elif f"{name}.{column}" in schema.same:
                t.columns[column] = (c.cast("bigint"), Kind("iri", f"urn:{schema.same[f'{name}.{column}']}:"))
            else:
                k = _KINDS[kind]
                t.columns[column] = ((c.cast("bigint") if k == "int" else c.cast("double") if k == "double" else c.cast("timestamp_ntz") if k == "time" else c), Kind(k))
        key = schema.keys.get(name)
        iri = Kind("iri", f"urn:{name}:")
        if isinstance(key, tuple):
            t.subject = (F.concat_ws("-", *key), iri)
        elif key in df.columns:
            t.subject = (F.col(key).cast("bigint"), iri)
        else:
            t.subject = (F.concat(F.lit(f"_:{name}_"), F.sha2(F.to_json(F.struct(*df.columns)), 256)), Kind("term"))
        if name in schema.following:
            predicate, group, place = schema.following[name]
            t.wide = df.join(df.groupBy(group).agg(F.max(place).alias("_last")), group)
            parts = [F.col(k) + 1 if k == place else F.col(k) for k in key]
            t.columns[predicate] = (F.when(F.col(place) < F.col("_last"), F.concat_ws("-", *parts)), iri)
            t.derived = frozenset({predicate})
        return t
