"""Marks and drafts kept from batch to batch: failed and late loads, hits, misses and expiry."""

import pytest

from sitetide.streaming import stateful


@pytest.fixture(scope="module")
def rocks(spark):
    for key, value in stateful.PROVIDER.items():
        spark.conf.set(key, value)
    yield spark
    for key in stateful.PROVIDER:
        spark.conf.unset(key)


def feed(spark, folder, rows, kind, times):
    made = spark.createDataFrame(rows, kind.replace("timestamp", "string"))
    for c in times:
        made = made.withColumn(c, made[c].cast("timestamp"))
    made.coalesce(1).write.mode("append").parquet(folder)


def run(spark, stream, name, tmp_path):
    out = f"{tmp_path}/{name}-out"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.read.parquet(out).collect()


def test_failed_and_late_loads_do_not_move_the_mark(rocks, tmp_path):
    folder, day = f"{tmp_path}/loads", lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    batches = [
        [(1, "a", day(1), day(1), "x", True), (1, "b", day(1), None, "y", True), (1, "c", day(1), day(1), None, False)],
        [(1, "a", day(2), day(5), None, False), (1, "a", day(3), day(3), "x", True), (1, "c", day(2), day(2), "z", True)],
        [(1, "a", day(2, 5), day(9), "old", True), (1, "a", day(4), day(2), "w", True), (1, "b", day(2), day(1), "y", True)],
    ]
    for rows in batches:
        feed(rocks, folder, rows, stateful.LOAD, ("loaded_at", "lastmod"))
        stream = rocks.readStream.schema(stateful.LOAD).option("maxFilesPerTrigger", 1).parquet(folder)
        found = run(rocks, stateful.high_water_marks(stream), "marks", tmp_path)
    got = {(r["url"], str(r["loaded_at"])): (str(r["lastmod"])[:10] if r["lastmod"] else None, r["verdict"]) for r in found}
    assert got == {
        ("a", day(1)): ("2024-01-01", "new"), ("b", day(1)): (None, "new"), ("c", day(1)): (None, "failed"),
        ("a", day(2)): ("2024-01-01", "failed"), ("a", day(3)): ("2024-01-03", "same"), ("c", day(2)): ("2024-01-02", "new"),
        ("a", day(2, 5)): ("2024-01-03", "late"), ("a", day(4)): ("2024-01-03", "changed"), ("b", day(2)): ("2024-01-01", "same"),
    }


def test_drafts_are_hit_and_expire(rocks, tmp_path):
    folder, hour = f"{tmp_path}/pages", lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    batches = [
        [(1, "a", hour(0), "x"), (1, "b", hour(1), "y"), (1, "a", hour(2), "z")],
        [(1, "a", hour(11), "q"), (1, "c", hour(13), "c")],
        [(1, "a", hour(14), "new"), (1, "a", hour(1), "late")],
        [(2, "d", hour(60), "d")],
        [(2, "e", hour(61), "e")],
    ]
    for rows in batches:
        feed(rocks, folder, rows, stateful.DRAFT, ("fetched_at",))
        stream = rocks.readStream.schema(stateful.DRAFT).option("maxFilesPerTrigger", 1).parquet(folder)
        found = run(rocks, stateful.resume_cache(stream), "cache", tmp_path)
    got = sorted((r["url"], str(r["fetched_at"]), r["verdict"], r["content_hash"]) for r in found)
    assert got == sorted([
        ("a", hour(0), "miss", "x"), ("b", hour(1), "miss", "y"), ("a", hour(2), "hit", "x"), ("a", hour(11), "hit", "x"), ("c", hour(13), "miss", "c"),
        ("a", hour(0), "expired", "x"), ("a", hour(14), "miss", "new"), ("b", hour(1), "expired", "y"), ("a", hour(14), "expired", "new"),
        ("c", hour(13), "expired", "c"), ("d", hour(60), "miss", "d"), ("e", hour(61), "miss", "e"),
    ])
