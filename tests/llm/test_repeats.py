import hashlib
import random

import numpy as np
import pytest

from sitetide.llm import fm_index, repeats, suffix_levels

NO_ID = 1 << 62


def brute_words(rows, window):
    first, out = {}, {}
    words = [(NO_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.setdefault(i, []).append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return {i: sorted(x) for i, x in out.items()}


def brute_bytes(rows, window):
    first, out = {}, {}
    data = [(NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - window + 1):
            key = b[k : k + window]
            first[key] = min(first.get(key, (i, k)), (i, k))
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < (i, k):
                gone[k : k + window] = True
        spans = int(np.diff(gone.astype(int), prepend=0).clip(0).sum())
        out.setdefault(i, []).append((len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return {i: sorted(x) for i, x in out.items()}


@pytest.fixture(scope="module")
def repetitive(rows):
    rng = random.Random(5)
    words = ["a", "bé", "the", "of", "x1", "ship", "sea", "Ω"]
    passages = [" ".join(rng.choices(words, k=rng.randint(10, 40))) for _ in range(8)]
    made = [(100 + k, " \n".join(rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(rng.randint(1, 6)))) for k in range(60)]
    made += [(200 + k, made[0][1] + f" tail{k}") for k in range(20)] + [(300, "ab\x00" * 100), (301, "x " * 400), (302, "x " * 401)]
    return [(i, t) for i, t, *_ in rows] + made


@pytest.fixture(params=[(repeats.HOT, repeats.BLOCK_BYTES), (3, 2000)], autouse=True)
def bounds(request, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", request.param[0])
    monkeypatch.setattr(repeats, "BLOCK_BYTES", request.param[1])
    monkeypatch.setattr(repeats.blocks, "__defaults__", (request.param[1],))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_words_match_brute_force(spark, repetitive):
    got = {}
    for r in fm_index.remove_repeated_windows(frame(spark, repetitive)).collect():
        got.setdefault(NO_ID if r["doc_id"] is None else r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept_text"]))
    assert {i: sorted(x) for i, x in got.items()} == brute_words(repetitive, fm_index.WINDOW)


def test_bytes_match_brute_force(spark, repetitive):
    got = {}
    for r in suffix_levels.remove_repeated_bytes(frame(spark, repetitive)).collect():
        got.setdefault(NO_ID if r["doc_id"] is None else r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])))
    assert {i: sorted(x) for i, x in got.items()} == brute_bytes(repetitive, suffix_levels.WINDOW)


def test_empty_table(empty):
    assert fm_index.remove_repeated_windows(empty).count() == 0 and suffix_levels.remove_repeated_bytes(empty).count() == 0


def test_matching_statistics_equal_brute_force():
    """Lengths of the longest stretches that stand in a text of an earlier owner; they vary from none to a whole text."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 5, rng.integers(1, 60)).tolist() for _ in range(60)] + [[1, 2, 3, 4] * 9] * 2
    owners = rng.permutation(len(texts))
    text = np.array([x for t in texts for x in (*t, 0)])
    sizes = np.array([len(t) + 1 for t in texts])
    first, owner = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(owners, sizes)
    got = fm_index.FMIndex(text, owner, 60).matching_statistics(text, np.where(text == 0, len(text), first), owner)
    for k, t in enumerate(texts):
        earlier = [repr(x)[1:-1] for x, o in zip(texts, owners, strict=True) if o < owners[k]]
        for e in range(len(t)):
            best = max(n for n in range(e + 2) if n == 0 or any(f" {repr(t[e + 1 - n : e + 1])[1:-1]}," in f" {x}," for x in earlier))
            assert got[first[np.flatnonzero(owner == owners[k])[0]] + e] == best
    assert len(set(got.tolist())) > 5


def test_levels_are_suffix_arrays_of_growing_size():
    """Every level is in order and without repeats, sizes at least double, and scans tell places and matches."""
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 6000).astype(np.uint8)
    family, seen = suffix_levels.Family(text, 12), set()
    for at in range(0, 5900, 130):
        new, again = family.suffix_array(np.arange(at, min(at + 130, 5900)))
        scans = [family.scan(level, new) for level in family.levels]
        for level, (held, before) in zip(family.levels, scans, strict=True):
            known = family.bytes_of(level).tolist()
            assert [k in set(known) for k in family.bytes_of(new).tolist()] == held.tolist()
            assert [sum(x < k for x in known) for k in family.bytes_of(new).tolist()] == before.tolist()
        old = np.logical_or.reduce([again, *[h for h, _ in scans]])
        assert old.tolist() == [bool(a) or k in seen for a, k in zip(again, family.bytes_of(new).tolist(), strict=True)]
        family.add(new[~old], [b[~old] for _, b in scans])
        seen |= set(family.bytes_of(new).tolist())
        for level in family.levels:
            keys = family.bytes_of(level)
            assert (keys[1:] > keys[:-1]).all()
        assert all(len(a) > 2 * len(b) for a, b in zip(family.levels, family.levels[1:], strict=False))


def test_repeated_ids_and_further_columns(spark):
    """Rows of one id never remove each other's words, wherever they lie; clashing columns change nothing."""
    long = " ".join(f"w{k}" for k in range(20))
    rows = [(1, long), (1, long), (2, long), (None, long), (None, long)]
    wide = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS shard", "'x' AS data", "3 AS n_words", "4 AS payload")
    for parts in (1, 5):
        got = sorted((r["doc_id"] or 9, r["n_removed"]) for r in fm_index.remove_repeated_windows(wide.repartition(parts)).collect())
        assert got == [(1, 0), (1, 0), (2, 20), (9, 20), (9, 20)]
        assert sorted((r["doc_id"] or 9, r["n_removed"] > 0) for r in suffix_levels.remove_repeated_bytes(wide.repartition(parts), 50, 20).collect()) == [(1, False), (1, False), (2, True), (9, True), (9, True)]


def test_queries_on_driver_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute_words(rows, 13)
    for r in fm_index.op1_fm_index(spark, small).collect():
        n, gone, kept = want[r["doc_id"]][0]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    want = brute_bytes(rows, 100)
    for r in suffix_levels.op4_suffix_levels(spark, small).collect():
        n, gone, spans, kept = want[r["doc_id"]][0]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, gone, spans, hashlib.sha256(kept).hexdigest())
