"""Pairs of a join meet only as long as both rests reach, in small tables or sorted; none is lost and no pack makes a table of
all its pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitetide.functions import text
from sitetide.operators import similarity
from tests.test_prefixes import dense, pack


@pytest.mark.parametrize("floor", [0.3, 0.7, 0.95])
@pytest.mark.parametrize("way", [{"SORTED": 1e9, "MANY": 1e9}, {"SORTED": -1, "MANY": 1e9}, {"SORTED": 1e9, "MANY": 1e9, "NEAR": 20}, {"SORTED": -1, "MANY": 1e9, "TABLE": 90}, {"MANY": -1, "CELLS": 200}, {}])
def test_meetings_lose_no_pair(monkeypatch, floor, way):
    for name, value in way.items():
        monkeypatch.setattr(similarity, name, value)
    rng, found = np.random.default_rng(5), 0
    for _ in range(30):
        batches = [pack(rng, list(range(30)), 40, 12), pack(rng, list(range(30)), 40, 12)]
        a, b = (similarity._Side(x.rename_columns([f"{s}_{c}" for c in x.schema.names]), 0, s, floor) for x, s in zip(batches, "qd", strict=True))
        want = dense(a, 40) @ dense(b, 40).T
        i, j, score = similarity._near(a, b, floor)
        assert np.allclose(score, want[i, j]) and len(set(zip(i, j, strict=True))) == len(i) == (want[i, j] >= floor - 1e-9).sum()
        assert {(x, y) for x, y in zip(*np.nonzero(want >= floor + 1e-9), strict=True)} <= set(zip(i.tolist(), j.tolist(), strict=True))
        found += len(i)
    assert found


def test_few_meetings_make_no_table_of_all_pairs(monkeypatch):
    def none(*_):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(similarity, "product", none)
    ids = list(range(5000))
    at = np.arange(0, 3 * len(ids) + 1, 3)
    codes = np.stack([np.arange(5000), 5000 + np.arange(5000) // 2, np.full(5000, 7500)], 1).ravel()
    idfs = np.concatenate([np.full(5000, 9.0), np.full(2500, 8.0), [1.0]])
    lists = [pa.array(ids), *[pa.array(x.astype(np.int32)) for x in (at, codes, np.ones(len(codes)))], pa.array(np.arange(7501)), pa.array(idfs)]
    batch = similarity._row({}, lists, ["ids", "at", "codes", "tfs", "ranks", "idfs"])
    a, b = (similarity._Side(batch.rename_columns([f"{s}_{c}" for c in batch.schema.names]), 0, s, 0.7) for s in "qd")
    i, j, _ = similarity._near(a, b, 0.7)
    assert i.tolist() == j.tolist() == ids


def test_best_of_a_pack_come_by_slices(monkeypatch):
    monkeypatch.setattr(similarity, "CELLS", 300)
    sizes, whole = [], similarity.product

    def counted(*given):
        sizes.append((made := whole(*given)).size)
        return made

    monkeypatch.setattr(similarity, "product", counted)
    rng = np.random.default_rng(6)
    batches = [pack(rng, list(range(50)), 40, 12), pack(rng, list(range(30)), 40, 12)]
    a, b = (similarity._Side(x.rename_columns([f"{s}_{c}" for c in x.schema.names]), 0, s, 0) for x, s in zip(batches, "qd", strict=True))
    want = dense(a, 40) @ dense(b, 40).T
    got = {(at + x, y): s for at, i, j, score in similarity._all(a, b, None) for x, y, s in zip(i.tolist(), j.tolist(), score, strict=True)}
    assert set(got) == set(zip(*(x.tolist() for x in np.nonzero(want)), strict=True)) and np.allclose([want[k] for k in got], list(got.values()))
    assert max(sizes) <= 300


def test_chunks_have_the_tokens_of_the_text_rules(spark):
    rows = [(1, None, "Ещё Курсы для ЕГЭ и ёлки, ЁЛКА ab abc İstanbul Kelvin 12 123 стоимостями x_y-zzz"), (2, "Школами Школы", None), (3, None, "без и для"), (4, None, "")]
    docs = spark.createDataFrame(rows, "id long, title string, text string").coalesce(1)
    said = docs.select("id", F.explode(text.tokens(F.col("text"))).alias("t")).unionAll(docs.select("id", F.explode(text.tokens(F.col("title"))).alias("t")))
    want = sorted((r[0], r[1], r[2] * (3 if r[0] == 2 else 1)) for r in said.groupBy("id", "t").count().collect())
    got = []
    for r in similarity.term_counts(docs).collect():
        for k, doc in enumerate(r["ids"]):
            got += [(doc, r["words"][r["codes"][x]], r["tfs"][x]) for x in range(r["at"][k], r["at"][k + 1])]
    assert sorted(got) == want and len(want) > 8


def test_packs_hold_documents_that_reach_as_far(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PACK", 64)
    common = " ".join(["common", "words", "everywhere"] * 30)
    rows = [(k, None, f"{common} rare{k % 50}" if k % 2 else f"own{k} word{k} rare{k % 50} common") for k in range(400)]
    packs = similarity.index(spark.createDataFrame(rows, "id long, title string, text string").coalesce(1)).packs
    kinds = [{i % 2 for i in r["ids"]} for r in packs.collect() if len(r["ids"]) >= 32]
    assert kinds and all(len(x) == 1 for x in kinds)


def test_files_of_chunks_are_short(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CHUNK", 10)
    rows = [(k, None, f"some words of page{k}") for k in range(200)]
    counts = similarity.term_counts(spark.createDataFrame(rows, "id long, title string, text string").coalesce(1))
    per = counts.groupBy(F.input_file_name()).count().collect()
    assert counts.count() >= 20 and max(r["count"] for r in per) <= similarity.TOLD
