import numpy as np
import pytest

from sitetide.llm import embeddings


def brute(rows, threshold=embeddings.THRESHOLD):
    """Links of all pairs and components by union-find."""
    good = []
    for k, (_, v, label) in enumerate(rows):
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None)
    root, links = list(range(len(rows))), [set() for _ in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if good[i] is not None and good[j] is not None and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]):
                if good[i] @ good[j] >= threshold:
                    links[i].add(j)
                    links[j].add(i)
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return {r[0]: (len(links[i]), least[find(i)]) for i, r in enumerate(rows)}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        base = rng.normal(size=8) if i % 3 else np.ones(8)
        v = (base + rng.normal(size=8) * 0.15).astype(np.float32).tolist() if i % 4 else [1.0] * 8
        rows.append((i, v, int(i % 2)))
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0] * 8, [1.0, None], [nan] * 8, [inf] * 8, [1.0] * 4]
    rows += [(300 + k, v, 0) for k, v in enumerate(odd)] + [(400, [1.0] * 8, None)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block,cell", [(1024, 512), (16, 512), (16, 40)])
def test_matches_brute_force(spark, vectors, block, cell):
    got = embeddings.near_duplicates(spark.createDataFrame(vectors, SCHEMA), block=block, cell=cell).collect()
    want = brute(vectors)
    assert len(got) == len(vectors)
    found = sum(r["n_links"] for r in got) / sum(n for n, _ in want.values())
    assert found == 1 if cell == 512 else found >= 0.9
    for r in got:
        assert r["n_links"] <= want[r["vec_id"]][0] and r["kept"] == (r["vec_id"] == r["component_id"])
        if cell == 512:
            assert (r["n_links"], r["component_id"]) == want[r["vec_id"]]


def test_recall_on_the_driver_table(spark, small):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want, got = brute(rows), embeddings.op10_kmeans_cells(spark, small).collect()
    assert sum(r["n_links"] for r in got) >= 0.9 * sum(n for n, _ in want.values())
    assert len(got) == len(rows)


def test_recall_over_many_cells(spark):
    """Over a hundred cells of one label: every twentieth vector against all by brute force."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(700, 24))
    rows = [(i, (centres[i % 700] + rng.normal(size=24) * 0.22).astype(np.float32).tolist(), 1) for i in range(5600)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert len(embeddings.fit_cells(embeddings.classes(frame), cell=40)[(1, 24)]) >= 100
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(frame, cell=40).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: int((x @ x[i] >= embeddings.THRESHOLD).sum()) - 1 for i in range(0, 5600, 20)}
    assert sum(want.values()) > 500
    # few first cells, all of which are cut into cells of their own
    second = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(frame, cell=40, sample=64, split=2).collect()}
    assert all(second[i] <= n for i, n in want.items()) and sum(second[i] for i in want) >= 0.9 * sum(want.values())
    assert all(got[i] <= n for i, n in want.items()) and sum(got[i] for i in want) >= 0.9 * sum(want.values())


def test_rows_without_ids_repeats_and_further_columns(spark):
    """A linked pair without an id, one of an id and none, a repeated id with equal and with other vectors; clashing columns."""
    one, two, far = [1.0, 0.0, 0.0], [0.99, 0.01, 0.0], [0.0, 0.0, 1.0]
    rows = [(None, one, 1), (5, two, 1), (None, far, 1), (None, far, 1), (7, [0.0, 1.0, 0.0], 1), (7, [0.0, 1.0, 0.0], 1), (7, [0.0, -1.0, 0.0], 1), (None, None, 1), (9, one, None)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS n", "3 AS l", "4 AS component", "5 AS rep", "6 AS least")
    got = sorted(map(repr, map(tuple, embeddings.near_duplicates(frame).collect())))
    want = [(None, 1, 5, False), (5, 1, 5, True), (None, 1, None, False), (None, 1, None, False), (7, 1, 7, True), (7, 1, 7, True), (7, 0, 7, True), (None, 0, None, False), (9, 0, 9, True)]
    assert got == sorted(map(repr, want))


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
