"""Pairs of a join meet by the rarer parts of their vectors only, and none is lost; words leave a chunk once each."""

import numpy as np
import pyarrow as pa
import pytest

from sitetide.operators import similarity


def pack(rng, ids, width, tokens):
    rows = [np.sort(rng.choice(width, rng.integers(1, tokens), replace=False, p=np.arange(1, width + 1) / (width * (width + 1) / 2))) for _ in ids]
    rows[1] = rows[0][: len(rows[0]) - 1] if len(rows[0]) > 1 else rows[0]
    at, flat = np.concatenate(([0], np.cumsum([len(r) for r in rows]))), np.concatenate(rows)
    ranks, codes = np.unique(flat, return_inverse=True)
    lists = [pa.array(ids), *[pa.array(x.astype(np.int32)) for x in (at, codes, rng.integers(1, 4, len(flat)))], pa.array(ranks), pa.array(np.log(2 * width / (ranks + 1.0)) + 1)]
    return similarity._row({}, lists, ["ids", "at", "codes", "tfs", "ranks", "idfs"])


def dense(side, width):
    made = np.zeros((side.n, width))
    for k in range(side.n):
        own = slice(side.at[k], side.at[k + 1])
        made[k, side.ranks[side.codes[own]]] = side.v[own]
    return made


@pytest.mark.parametrize(("floor", "columns"), [(0.0, 512), (0.3, 7), (0.7, 512), (0.7, 3), (0.95, 512)])
def test_prefixes_lose_no_pair(monkeypatch, floor, columns):
    monkeypatch.setattr(similarity, "COLUMNS", columns)
    monkeypatch.setattr(similarity, "MEETINGS", 50)
    rng, found = np.random.default_rng(int(10 * floor) + columns), 0
    for _ in range(30):
        batches = [pack(rng, list(range(30)), 40, 12), pack(rng, list(range(30)), 40, 12)]
        a, b = (similarity._Side(x.rename_columns([f"{s}_{c}" for c in x.schema.names]), 0, s, floor) for x, s in zip(batches, "qd", strict=True))
        want = dense(a, 40) @ dense(b, 40).T
        sums = similarity._product(a, b)
        if not floor:
            assert np.allclose(sums, want)
            continue
        i, j, score = similarity._reaching(a, b, sums, floor)
        assert np.allclose(score, want[i, j])
        sure = {(x, y) for x, y in zip(*np.nonzero(want >= floor + 1e-9), strict=True)}
        assert sure <= set(zip(i.tolist(), j.tolist(), strict=True)) and len(i) == (want[i, j] >= floor - 1e-9).sum()
        assert len(a.of) < len(a.v)
        found += len(i)
    assert found or not floor


def test_words_leave_a_chunk_once(spark):
    rows = [(k, None, f"common words of every page and own{k}") for k in range(200)]
    counts = similarity.term_counts(spark.createDataFrame(rows, "id long, title string, text string").coalesce(1))
    made = counts.selectExpr("sum(n) as n", "count(*) as chunks", "sum(size(words)) as words", "sum(size(codes)) as postings").first()
    assert made["n"] == 200 and made["words"] <= 200 + 5 * made["chunks"] and made["postings"] >= 800 and made["chunks"] <= 8
