"""Scratch tables: dropped at the end, sized by the corpus, never local on a cluster."""

import os

import pytest

from graphloom.llm import chunkstore, common, jaccard


def listed(spark):
    folder = common.scratch_dir(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_scratch_is_dropped_but_for_what_is_kept(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f {i % 3}") for i in range(9)], "doc_id long, text string")
    files, tables = listed(spark), {t.name for t in spark.catalog.listTables()}
    with common.scratch(spark) as keep:
        out = keep(jaccard.jaccard_classes(docs), "kept")
    assert out.count() == 9
    new = listed(spark) - files
    assert len(new) == 1 and new.pop().startswith("kept-")
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_no_local_folder_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_dir(Cluster)


def test_chunks_and_partitions_grow_by_the_root():
    assert chunkstore.growth(0) == chunkstore.growth(30 << 30) == 1
    for tera in (1, 10, 100):
        total = tera << 40
        g = chunkstore.growth(total)
        store = chunkstore.Store(None, total, 0, g)
        keys = chunkstore.CHUNK_BYTES * g / 6 / store.partitions(total / 40, 1 << 20)
        assert keys > 200 and g < 50


def test_buckets_follow_bytes(spark, monkeypatch):
    docs = spark.range(1000).selectExpr("id as doc_id", "repeat('text ', 100) as text")
    assert common.buckets(docs) == common.shuffle_partitions(spark)
    monkeypatch.setattr(common, "BUCKET_BYTES", 1 << 10)
    assert common.buckets(docs) > 20
