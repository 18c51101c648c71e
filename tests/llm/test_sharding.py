"""op1 against a plain ranking, with null ids, copies and clashing names."""

import hashlib
import zlib
from collections import Counter

import pytest

from graphloom.llm import sharding


def plain(rows, shards):
    seen, keyed = Counter(), []
    for doc, text, source in rows:
        data = (text or "").encode()
        stratum = "-" if source is None else f"={source}"
        same = f"{'' if doc is None else doc}:{zlib.crc32(data)}:{len(data) + 8}:{stratum}"
        keyed.append((stratum, hashlib.md5(f"graphloom:{same}:{seen[same]}".encode()).hexdigest(), doc, len(data) + 8, zlib.crc32(data)))
        seen[same] += 1
    of, at, ranked = Counter(k[0] for k in keyed), Counter(), []
    for k in sorted(keyed):
        at[k[0]] += 1
        ranked.append(((at[k[0]] - 0.5) / of[k[0]], *k))
    n, out = len(ranked), Counter()
    for pos, (_, stratum, _, doc, size, crc) in enumerate(sorted(ranked)):
        shard = pos * shards // n
        out[doc, stratum, size, crc, shard, pos - -(-shard * n // shards)] += 1
    return out


@pytest.mark.parametrize("each", [40, 20_000])
def test_shards_are_those_of_one_ranking(spark, monkeypatch, each):
    monkeypatch.setattr(sharding, "ROWS_EACH", each)
    rows = [(None, "copy", "hot")] * 400 + [(None, f"t{i}", "hot") for i in range(300)] + [(7, None, None)] * 5 + [(i, "é" * (i % 9), f"s{i % 3}") for i in range(200)] + [(8, "long " * 50_000, "s1")]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, source string, bin int, same string, row long").repartition(6)
    out = Counter(tuple(r) for r in sharding.shard(frame, 7).collect())
    assert out == plain(rows, 7)
