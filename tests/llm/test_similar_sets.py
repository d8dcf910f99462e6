"""No link of near copies is left out: pairs just above the bound, in which bands of least hashes miss some."""

import numpy as np

from sitetide.llm import simhash


def test_pairs_at_the_bound_are_linked(spark):
    """Four hundred pairs that share 81 of 100 shingles: bands find nearly all of them only."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 94)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:85], *[f"v{x}" for x in rng.integers(0, 1 << 40, 9)]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [simhash.shingle_set(t, 5) for _, t in rows]
    assert all(10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2], strict=True))
    kept = simhash.keep_similar(docs, shingle=5)
    assert {r["doc_id"] for r in kept.collect()} == set(range(0, 800, 2))


def test_first_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    for n in [1, 2, 4, 5, 9, 40, 333]:
        for _ in range(50):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            b = np.unique(np.concatenate((rng.choice(a, -(-9 * n // 10), replace=False), rng.integers(0, 1 << 63, n // 11, np.uint64))))
            common = np.sort((rng.choice(a, n // 2, replace=False) >> np.uint64(32)).astype(np.uint32))
            if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
                x, y = (simhash.first_shingles(s, common) for s in (a, b))
                assert len(np.intersect1d(x, y)) >= min(simhash.least_shared(len(s))[1] for s in (a, b))


def close_texts(rng, n, own):
    """Texts of a hundred words with the same first words and ``own`` last ones of their own: a Jaccard index just under 0.8
    for eleven of them, just above for ten; one in six is a near copy of the one before."""
    shared, rows = [f"w{x}" for x in rng.integers(0, 1 << 40, 100)], []
    for k in range(n):
        words = [*shared[: 100 - own], *[f"v{x}" for x in rng.integers(0, 1 << 40, own)]]
        rows.append((k, " ".join([*rows[-1][1].split()[:-2], "x", f"y{k}"] if k % 6 == 5 else words)))
    return rows


def test_frequent_first_shingles_make_no_row_for_each_pair(spark, monkeypatch):
    """All pairs of a group that fall short of the bound by little share first shingles; those above it are still linked."""
    rng, sizes, written = np.random.default_rng(5), {}, simhash.written

    def counted(df, label, *more):
        made = written(df, label, *more)
        sizes[label] = max(sizes.get(label, 0), made.count())
        return made

    monkeypatch.setattr(simhash, "written", counted)
    monkeypatch.setattr(simhash, "BLOCK", 50, raising=False)
    rows = close_texts(rng, 240, 11) + [(1000 + k, t) for k, t in close_texts(rng, 150, 10)]
    sets = {k: simhash.shingle_set(t, 5) for k, t in rows}
    least = {k: k for k in sets}
    shared = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in sets for b in sets if a < b and a // 1000 == b // 1000}
    for _ in range(5):
        for (a, b), n in shared.items():
            if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n):
                least[a] = least[b] = min(least[a], least[b])
    kept = simhash.keep_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle=5)
    assert {r["doc_id"] for r in kept.collect()} == {k for k in sets if least[k] == k}
    assert len({k for k in sets if least[k] == k}) > 150 and sizes["pairs"] < 30 * len(rows)


def test_spanning_links_connect_the_same():
    rng = np.random.default_rng(6)
    for n in [0, 1, 5, 60, 400]:
        a, b = rng.integers(0, 80, (2, n)) << 40
        found = simhash.spanning(a, b)

        def groups(a, b):
            least = {x: x for x in [*a, *b]}
            for _ in range(80):
                for x, y in zip(a, b, strict=True):
                    least[x] = least[y] = min(least[x], least[y])
            return {x: least[x] for x in least if x in {*found[0], *found[1]}}

        assert groups(a.tolist(), b.tolist()) == groups(found[0].tolist(), found[1].tolist()) and len(found[0]) < 80


def test_groups_are_looked_for_among_texts_that_share_shingles_only(spark, monkeypatch):
    """Texts of which too few shingles are in any other text get no row in the search for groups, whichever chunk they are in."""
    rng, sizes, written = np.random.default_rng(7), {}, simhash.written

    def counted(df, label, *more):
        made = written(df, label, *more)
        sizes[label] = made.count()
        return made

    monkeypatch.setattr(simhash, "written", counted)
    monkeypatch.setattr(simhash, "CHUNK", 1000, raising=False)
    shared = [f"s{x}" for x in range(40)]  # a passage in every text, lone ones too
    rows = [(k, " ".join([*[f"w{x}" for x in rng.integers(0, 1 << 40, 100)], *shared])) for k in range(300)]
    rows += [(1000 + k, rows[k][1] + " tail") for k in range(20)] + [(2000 + k, rows[k][1]) for k in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.keep_similar(docs, shingle=5).collect()} == set(range(300))
    assert sizes["sets"] <= 50 and sizes["met"] < 50


def test_no_row_with_a_similar_one_is_told_to_be_alone(spark, monkeypatch):
    rng, rows = np.random.default_rng(8), [(None, None), (0, "  ")]
    monkeypatch.setattr(simhash, "CHUNK", 200)
    for n in [1, 3, 5, 6, 8, 9, 10, 13, 14, 20, 29, 60, 150, 400]:
        for _ in range(6):
            words = [f"w{x}" for x in rng.integers(0, 1 << 40, n + 4)]
            cut = max(5, len(words) - int(rng.integers(0, n // 4 + 1)))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:cut]))]
            rows.append((len(rows), " ".join([*words[:cut], *[f"v{x}" for x in rng.integers(0, 1 << 40, int(rng.integers(0, n // 4 + 1)))]])))
    rows += [(len(rows) + k, f"l{k} m{k} n{k} o{k} p{k} q{k}") for k in range(50)]
    sets = [simhash.shingle_set(t, 5) for _, t in rows]
    wanted = {}
    for k, (i, _) in enumerate(rows):
        shared = [len(np.intersect1d(sets[k], s)) for s in sets]
        wanted[i] = all(j == k or 10 * shared[j] < 8 * (len(sets[k]) + len(s) - shared[j]) for j, s in enumerate(sets))
    told = simhash.told_apart(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5).collect()
    assert len(told) == len(rows) and {r["doc_id"] for r in told} == set(wanted)
    assert not [r["doc_id"] for r in told if r["alone"] and not wanted[r["doc_id"]]]
    assert sum(r["alone"] for r in told) >= 50
