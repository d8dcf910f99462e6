import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sitetide.llm import sharding


def test_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = sharding.op9_virtual_slots(spark, small).collect()
    assert len(got) == len(texts)
    loads, places = {}, {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in places.values()) and set(loads) <= set(range(24))
    assert max(loads.values()) - min(loads.values()) <= max(len((t or "").encode()) + 8 for t in texts.values())


def plain(rows, owner, shards):
    """Shards by simple loops: slots by hash, heavy ones in parts, single moves from the fullest to the emptiest shard."""
    size = {k: len((t or "").encode()) + 8 for k, (_, t) in enumerate(rows)}
    slot = {k: 42 % len(owner) if i is None else np.int64(np.uint64(xxhash.xxh64(str(i).encode(), seed=42).intdigest())) % len(owner) for k, (i, _) in enumerate(rows)}
    sums = [sum(size[k] for k in size if slot[k] == s) for s in range(len(owner))]
    return slot, sums, [s for s in range(len(owner)) if sums[s] * sharding.HEAVY > sum(sums) // shards]


def test_places_equal_a_plain_rebuild(spark, small):
    """Each row lies in the shard that the stored map gives its slot, behind the rows of the shard's earlier slots."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    path = sharding.new_map(spark, 512, 5)
    got = {r["doc_id"]: r for r in sharding.shard_documents(spark.read.parquet(f"{small}/documents.parquet"), path, 5).collect()}
    version, owner = sharding.load_map(spark, path)
    slot, sums, heavy = plain(rows, owner, 5)
    assert version == 2 and sharding.load_map(spark, path, 1)[1] == sharding.first_map(512, 5)
    assert owner == sharding.rebalanced(sharding.first_map(512, 5), [0 if k in heavy else w for k, w in enumerate(sums)], 5) or heavy
    ordered = {s: [] for s in range(5)}
    for k, (i, _) in sorted(enumerate(rows), key=lambda x: (slot[x[0]], x[1][0])):
        assert got[i]["vslot"] == slot[k]
        if slot[k] not in heavy:
            assert got[i]["shard"] == owner[slot[k]]
            ordered[got[i]["shard"]].append(i)
    for s, ids in ordered.items():
        assert [got[i]["slot"] for i in ids] == list(range(len(ids)))  # parts of heavy slots follow


def test_a_stored_map_is_edited(spark):
    """A table that has grown by a little moves few slots, and nearly all slots that move for one more shard go into it."""
    path = sharding.new_map(spark, 256, 4)
    first = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 50 + cast(id % 7 as int)) AS text")
    assert sharding.shard_documents(first, path, 4).count() == 4000
    one = sharding.load_map(spark, path)[1]
    sharding.shard_documents(spark.range(4100).selectExpr("id AS doc_id", "repeat('x', 50 + cast(id % 7 as int)) AS text"), path, 4).count()
    version, two = sharding.load_map(spark, path)
    assert version == 3 and sum(a != b for a, b in zip(one, two, strict=True)) < 20
    loads = {r["shard"]: r["b"] for r in sharding.shard_documents(first, path, 5).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    three = sharding.load_map(spark, path)[1]
    assert sum(a != b and b != 4 for a, b in zip(two, three, strict=True)) < 20 < three.count(4) and max(loads.values()) - min(loads.values()) < 1000
    with pytest.raises(ValueError):
        sharding.shard_documents(first, path, 3)


def test_rows_of_one_id_spread(spark):
    """Four hundred rows of one id, and a hundred without an id and with equal texts, beside a few others."""
    rows = [(7, "y" * 1000)] * 400 + [(None, "z" * 500)] * 100 + [(k, "w" * 100) for k in range(100, 120)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), sharding.new_map(spark, 512, 24)).collect()
    loads = {}
    for r in got:
        loads.setdefault(r["shard"], []).append(r["size"])
    assert len(got) == 520 and len(loads) == 24 and max(map(sum, loads.values())) - min(map(sum, loads.values())) <= 1100
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in sorted(loads) for k in range(len(loads[s]))]


def test_odd_rows(spark, docs, rows, empty):
    got = sharding.shard_documents(docs.withColumn("slot", F.lit(9)).withColumn("part", F.lit(1)), sharding.new_map(spark, 64, 3), 3).collect()
    assert len(got) == len(rows) and {r["size"] for r in got if r["doc_id"] == 2} == {8}
    assert sharding.shard_documents(empty, sharding.new_map(spark)).count() == 0


def test_rebalancing_moves_only_what_it_must():
    owner = sharding.first_map(8, 2)
    after = sharding.rebalanced(owner, [10, 1, 10, 1, 10, 1, 10, 1], 2)
    loads = [sum(w for s, w in zip(after, [10, 1] * 4, strict=True) if s == k) for k in (0, 1)]
    assert loads == [22, 22] and sum(a != b for a, b in zip(owner, after, strict=True)) <= 4
