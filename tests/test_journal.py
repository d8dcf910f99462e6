"""Logs take a run once and hide half-written ones; keyed tables rewrite only the buckets they touch."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from sitetide.operators.ordered import numbered, running
from sitetide.sources import journal

LOG = "page_id long, text string"
CARD = "page_id long, topic string, at int"


def files(path):
    return {os.path.relpath(f, path): os.path.getmtime(f) for f in glob.glob(f"{path}/data/*/*/*.parquet")}


def test_a_run_written_twice_stays_single(spark, tmp_path):
    path, rows = f"{tmp_path}/log", spark.createDataFrame([(1, "a"), (2, "b")], LOG)
    assert journal.read_runs(spark, path, LOG).count() == 0
    assert journal.append_run(rows, path, "r1") and not journal.append_run(rows, path, "r1")
    assert journal.append_run(rows.limit(0), path, "r0") and not journal.append_run(rows, path, "r0")
    assert journal.append_run(spark.createDataFrame([(3, None)], LOG), path, "r2")
    assert sorted(map(tuple, journal.read_runs(spark, path, LOG).collect())) == [(1, "a", "r1"), (2, "b", "r1"), (3, None, "r2")]
    assert {r["run"]: r["n_rows"] for r in journal.commits(spark, path).collect()} == {"r0": 0, "r1": 2, "r2": 1}


def test_a_half_written_run_is_invisible_and_replaced(spark, tmp_path, monkeypatch):
    path, rows = f"{tmp_path}/log", spark.createDataFrame([(1, "a"), (2, "b")], LOG)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(journal, "_commit", broken)
        with pytest.raises(OSError, match="lost"):
            journal.append_run(rows.unionByName(spark.createDataFrame([(9, "late")], LOG)), path, "r1")
    assert glob.glob(f"{path}/rows/run=r1/*.parquet") and journal.read_runs(spark, path, LOG).count() == 0
    assert journal.append_run(rows, path, "r1")
    assert sorted(r["page_id"] for r in journal.read_runs(spark, path, LOG).collect()) == [1, 2]


def test_changes_point_to_their_snapshots(spark, tmp_path):
    diffs = spark.createDataFrame([(1, "new", None, "n", None), (2, "removed", "o", None, None), (3, "changed", "o", "n", "-o\n+n")], "page_id long, change_type string, old_text string, new_text string, diff_text string")
    snapshots, changes = journal.change_rows(diffs, "r1")
    texts = {r["snapshot_id"]: (r["page_id"], r["text"]) for r in snapshots.collect()}
    assert len(texts) == 4
    for r in changes.collect():
        ends = [texts.get(r[c]) for c in ("old_snapshot_id", "new_snapshot_id")]
        assert ends == [None if r["change_type"] == "new" else (r["page_id"], "o"), None if r["change_type"] == "removed" else (r["page_id"], "n")]
    assert sorted(map(tuple, journal.change_rows(diffs, "r1")[0].collect())) == sorted(map(tuple, snapshots.collect()))
    assert {r["text"] for r in journal.baseline_rows(diffs, "r1").collect()} == {"n", ""}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/cards"
    first = spark.createDataFrame([(k, f"t{k}", 1) for k in range(200)], CARD)
    assert journal.upsert_run(first, path, "r1", ["page_id"], ["at"], 16)
    before = files(path)
    new = spark.createDataFrame([(5, "newer", 2), (5, "newest", 3), (6, "older", 0), (1000, "fresh", 1)], CARD)
    assert journal.upsert_run(new, path, "r2", ["page_id"], ["at"], 16) and not journal.upsert_run(new, path, "r2", ["page_id"], ["at"], 16)
    want = {k: f"t{k}" for k in range(200)} | {5: "newest", 1000: "fresh"}
    assert {r["page_id"]: r["topic"] for r in journal.read_state(spark, path, CARD).collect()} == want
    after = files(path)
    assert before.items() <= after.items()
    touched = {r["bucket"] for r in new.select(journal._bucket(["page_id"], 16).alias("bucket")).collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in after.keys() - before.keys()} == touched and len(touched) <= 3
    assert journal.vacuum(spark, path) == len(touched) and journal.vacuum(spark, path) == 0
    assert {r["page_id"]: r["topic"] for r in journal.read_state(spark, path, CARD).collect()} == want


def test_update_where(spark, tmp_path):
    path = f"{tmp_path}/cards"
    journal.upsert_run(spark.createDataFrame([(k, None if k == 3 else f"t{k}", k) for k in range(40)], CARD), path, "r1", ["page_id"], ["at"], 8)
    before = files(path)
    assert journal.update_where(spark, path, "r2", CARD, F.col("topic") == "t7", {"topic": F.concat(F.col("topic"), F.lit("!"))})
    got = {r["page_id"]: r["topic"] for r in journal.read_state(spark, path, CARD).collect()}
    assert got == {k: None if k == 3 else "t7!" if k == 7 else f"t{k}" for k in range(40)}
    assert len(files(path).keys() - before.keys()) == 1
    assert not journal.update_where(spark, path, "r2", CARD, F.lit(True), {"topic": F.lit("x")})


def test_a_broken_upsert_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/state"
    kind = "name string, value string, at int"
    journal.upsert_run(spark.createDataFrame([("sheet", "1", 1)], kind), path, "r1", ["name"], ["at"])
    with monkeypatch.context() as m:
        m.setattr(journal, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            journal.upsert_run(spark.createDataFrame([("sheet", "2", 2)], kind), path, "r2", ["name"], ["at"])
    state = journal.read_state(spark, path, kind)
    one = spark.range(1).select(journal.value_of(state, "sheet").alias("a"), journal.value_of(state, "none", "d").alias("b")).first()
    assert tuple(one) == ("1", "d")
    assert journal.upsert_run(spark.createDataFrame([("sheet", "3", 3)], kind), path, "r2", ["name"], ["at"])
    assert journal.read_state(spark, path, kind).first()["value"] == "3"


def test_numbers_and_running_sums(spark, monkeypatch):
    from sitetide.operators import ordered

    monkeypatch.setattr(ordered, "PART", 7)
    rows = spark.createDataFrame([((k * 37) % 101, k % 5) for k in range(101)], "k int, v int").repartition(6)
    want, total = {}, 0
    by = dict(map(tuple, rows.collect()))
    for place, k in enumerate(sorted(by)):
        want[k] = (place, total)
        total += by[k]
    assert {r["k"]: r["n"] for r in numbered(rows, ["k"], "n").collect()} == {k: p for k, (p, _) in want.items()}
    assert {r["k"]: r["s"] for r in running(rows, ["k"], "v", "s").collect()} == {k: s for k, (_, s) in want.items()}
    assert running(rows.limit(0), ["k"], "v", "s").count() == 0


def test_crawls_without_a_page_fail_and_reports_are_written(spark, tmp_path):
    from sitetide.sources import store

    items = f"{tmp_path}/items"
    spark.createDataFrame([("https://a.example", "text"), (None, "lost")], "url string, text string").write.json(items)
    assert [r["url"] for r in store.read_items(spark, items).collect()] == ["https://a.example"]
    spark.createDataFrame([(None, "lost")], "url string, text string").write.json(f"{tmp_path}/none")
    with pytest.raises(ValueError, match="without a page"):
        store.read_items(spark, f"{tmp_path}/none")
    rows = spark.createDataFrame([(2, "b", "x,y"), (1, "a", 'say "z"')], "nth int, line string, cell string")
    store.write_text(rows, f"{tmp_path}/report", ["nth"])
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/report").collect()] == ["a", "b"]
    store.write_csv(rows, f"{tmp_path}/csv")
    assert sorted(map(tuple, spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").collect())) == [("1", "a", 'say "z"'), ("2", "b", "x,y")]
