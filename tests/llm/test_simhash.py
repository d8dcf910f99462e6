import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sitetide.llm import simhash


def shingles(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\\x20\\x09-\\x0D]+", lower)
    return [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []


def fingerprint(text, n):
    """Bit by bit: set where more than half the hashes have it."""
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles(text, n)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def links(rows, shingle, distance):
    """Smallest id of each row's group by comparing all pairs; rows without an id never name one."""
    fps = [fingerprint(t, shingle) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return fps, [find(i) for i in range(len(rows))], [least.get(find(i)) for i in range(len(rows))]


def test_components_equal_brute_force(docs, rows):
    rows = [(i, t) for i, t, *_ in rows]
    fps, _, want = links(rows, 4, 4)
    got = simhash.near_duplicates(docs).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    made = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=key)
    assert made == sorted(((i, f, c) for (i, _), f, c in zip(rows, fps, want, strict=True)), key=key)


def test_query_equals_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    fps, _, want = links(rows, 4, 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op7_simhash_variants(spark, small).collect()}
    assert got == {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want, strict=True)}


def test_one_row_of_each_group_stays(docs, rows, empty):
    plain = [(i, t) for i, t, *_ in rows]
    _, group, least = links(plain, 5, 5)
    wide = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("fp", "_fp", "kept_id", "_kept_id", "_nth", "least", "of", "first", "key", "component"))])
    for one in (simhash.keep_one(wide, 5, 5), simhash.keep_similar(wide, shingle=5)):
        assert one.columns == wide.columns and {tuple(r)[5:] for r in one.collect()} == {tuple(range(10))}
    got = simhash.keep_one(docs, 5, 5).collect()
    assert len(got) == len(set(group)) and {r["doc_id"] for r in got} == set(least)
    assert simhash.keep_one(empty, 5, 5).count() == 0 and simhash.near_duplicates(empty).count() == 0


def jaccard_groups(rows, shingle=5):
    """Smallest id of each row's group, linking all pairs that share 0.8 of their distinct shingles."""
    sets = [set(shingles(t, shingle)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(rows))]


def test_every_pair_within_the_distance_meets():
    rng = np.random.default_rng(1)
    for distance in (4, 5, 9, 13, 15):
        x = rng.integers(0, 1 << 63, 500, np.uint64)
        flips = [rng.choice(64, distance, replace=False) for _ in x]
        diff = np.array([sum(1 << int(b) for b in f) for f in flips], np.uint64)
        assert (simhash.first_bucket(diff, distance) >= 0).all()


def test_edited_copies_go_and_only_those(spark, docs, rows, empty):
    """Copies with a few words changed (Jaccard 0.8 to 0.9) go; those just under 0.8 stay."""
    rng = np.random.default_rng(3)
    made = []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        made.append((10 * k, " ".join(words)))
        for n, edits in enumerate((3, 5, 6, 8, 12)):
            copy = list(words)
            for at in rng.choice(60, edits, replace=False) * 5:
                copy[at] = f"new{rng.integers(0, 1 << 30)}"
            made.append((10 * k + n + 1, " ".join(copy)))
    least = jaccard_groups(made)
    frame = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.keep_similar(frame, shingle=5).collect()}
    want, whole = set(least), {i for i, _ in made}
    assert want <= got and len(got - want) <= 0.03 * len(whole - want)  # of the copies that should go
    plain = [(i, t) for i, t, *_ in rows]
    assert sorted(r["doc_id"] for r in simhash.keep_similar(docs, shingle=5).select("doc_id").collect()) == sorted(set(jaccard_groups(plain)))
    assert simhash.keep_similar(docs, shingle=5).columns == docs.columns and simhash.keep_similar(empty, shingle=5).count() == 0
