"""Sharding by fixed virtual slots and a stored, versioned slot-to-shard map (DataFrame functions only)."""

from __future__ import annotations

import bisect
import heapq
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitetide.session import own_folder, table, written

SLOTS = 4096
SHARDS = 24
#: A slot with more than one in HEAVY of a shard's share of bytes is cut into parts of one in FINE of it.
HEAVY = 4
FINE = 32


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot, place``: the slot is a hash of the id (null ids are one), the place any number
    of the row. Written once, so that the places stay.

    A null text counts as empty, so its size is the 8 bytes of the id.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(slots)).cast("int").alias("vslot"),
        F.monotonically_increasing_id().alias("place"),
    )
    return written(rows, "measured")


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1: slots dealt to the shards in turn."""
    return [slot % shards for slot in range(slots)]


def rebalanced(owner: list[int], weight: list[int], shards: int) -> list[int]:
    """Edit a map: move single slots from the fullest shard to the emptiest while that narrows their gap.

    Each edit lowers the sum of squared loads, so it ends; empty slots never move.
    """
    owner, load = list(owner), [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        load[shard] += weight[slot]
        if weight[slot]:
            held[shard].append((weight[slot], slot))
    for pieces in held:
        pieces.sort()
    light = [(x, s) for s, x in enumerate(load)]
    heapq.heapify(light)
    full = set()
    while len(full) < shards:
        heavy = max((s for s in range(shards) if s not in full), key=load.__getitem__)
        while light and light[0][0] != load[light[0][1]]:
            heapq.heappop(light)
        to = light[0][1]
        gap = load[heavy] - load[to]
        at = bisect.bisect_right(held[heavy], (gap // 2, len(owner)))
        near = [held[heavy][k] for k in (at - 1, at) if 0 <= k < len(held[heavy]) and held[heavy][k][0] < gap]
        if not near:
            full.add(heavy)
            continue
        piece = min(near, key=lambda p: abs(2 * p[0] - gap))
        held[heavy].remove(piece)
        bisect.insort(held[to], piece)
        owner[piece[1]] = to
        for shard, change in ((heavy, -piece[0]), (to, piece[0])):
            load[shard] += change
            heapq.heappush(light, (load[shard], shard))
        full.discard(to)
    return owner


def store_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    """Write one version of a map, ``vslot, shard``, beside those before it."""
    rows = spark.range(len(owner)).select(
        F.col("id").cast("int").alias("vslot"), F.from_json(F.lit(json.dumps(owner)), "array<int>")[F.col("id").cast("int")].alias("shard")
    )
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """The number of the latest (or a given) version of a stored map, and the shard of each slot."""
    rows = spark.read.parquet(path)
    version = version or rows.agg(F.max("version")).first()[0]
    return version, [r["shard"] for r in rows.filter(F.col("version") == version).orderBy("vslot").collect()]  # one row for each slot


def new_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS, path: str | None = None) -> str:
    """Store version 1 of a map and say where."""
    path = path or f"{own_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    store_map(spark, path, 1, first_map(slots, shards))
    return path


def shard_documents(docs: DataFrame, map_path: str, shards: int = SHARDS) -> DataFrame:
    """Put every row into a shard so that the shards' bytes are near equal (law ``bytes``).

    Rows are hashed into fixed slots; bytes and rows are summed per slot. The stored map's latest version is loaded,
    edited for these sums by moving single slots until the loads are level, and stored as the next version, by which the
    rows are placed; a later table that uses the same map moves few slots. A slot that is heavy, as all rows of one id
    are, is cut into parts by the rows' places; its parts are dealt like slots but are no part of the map. ``slot``
    numbers the rows of a shard from 0 without gaps: the rows of its earlier slots, plus the row's number within its own,
    so no task sorts a whole shard.

    Columns that are not ``doc_id`` or ``text`` are ignored. Null ids, repeated rows and ties each get a place of their
    own; a long text counts in full and is never cut; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    version, before = load_map(spark, map_path)
    slots = len(before)
    if max(before) >= shards:
        raise ValueError(f"the map deals to more than {shards} shards")
    rows = measured(docs, slots)
    sums = {r["vslot"]: r["bytes"] for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}  # one for each slot
    share = max(1, sum(sums.values()) // shards)
    cut = {slot: -(-size * FINE // share) for slot, size in sums.items() if size * HEAVY > share}  # fewer than HEAVY x shards
    parts = F.coalesce(F.from_json(F.lit(json.dumps(cut)), "map<string,int>")[F.col("vslot").cast("string")], F.lit(1))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("place"), parts).cast("int"))
    weight, count, pieces = [0] * slots, [0] * slots, []
    for r in rows.groupBy("vslot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("vslot", "part").collect():  # slots and parts
        if r["vslot"] in cut:
            pieces.append((r["vslot"], r["part"], r["bytes"], r["n"]))
        else:
            weight[r["vslot"]], count[r["vslot"]] = r["bytes"], r["n"]
    start = before + [k % shards for k in range(len(pieces))]
    after = rebalanced(start, weight + [p[2] for p in pieces], shards)
    store_map(spark, map_path, version + 1, after[:slots])
    skip, filled = [], [0] * shards
    for shard, n in zip(after, count + [p[3] for p in pieces], strict=True):
        skip.append(filled[shard])
        filled[shard] += n
    keys = [(slot, 0) for slot in range(slots) if slot not in cut] + [p[:2] for p in pieces]
    where = [k for k in range(slots) if k not in cut] + list(range(slots, slots + len(pieces)))
    dealt = [[slot, part, after[k], skip[k]] for (slot, part), k in zip(keys, where, strict=True)]
    current = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(dealt)), "array<array<bigint>>")).alias("d"))
    current = current.select(*[F.col("d")[k].cast(kind).alias(c) for k, (c, kind) in enumerate((("vslot", "int"), ("part", "int"), ("shard", "int"), ("skip", "long")))])
    inside = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size", "place")
    return (
        rows.withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(current), ["vslot", "part"])  # one row for each slot and part
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("skip") + F.col("nth") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "vslot",
        )
    )


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), new_map(spark))
