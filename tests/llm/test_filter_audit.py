"""Filter orders against a plain replay of every order on every document."""

import re
from itertools import permutations

from sitetide.llm import filter_audit as f

MARK = set("#$%&*|")


def plain(docs, labels):
    texts = {}
    for i, t, _ in docs:
        texts.setdefault(t or "", []).append(i)
    seen = []
    for i, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = set()
        failed |= {"A"} if len(w) < 50 else set()
        failed |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        failed |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        failed |= {"D"} if MARK & set(t) else set()
        failed |= {"E"} if i is not None and any(j is not None and j < i for j in texts[t]) else set()
        of = [(q, x) for k, q, x in labels if k == i and i is not None]
        seen.append((source or "", failed, any(q == 1 for q, _ in of), any(x == 1 for _, x in of)))
    out = {}
    for part in {s[0] for s in seen}:
        own = [s for s in seen if s[0] == part]
        share = dict.fromkeys(f.FILTERS, 0)
        for order in permutations(f.FILTERS):
            left = own
            for step, name in enumerate(order, 1):
                hit = [s for s in left if name in s[1]]
                left = [s for s in left if name not in s[1]]
                share[name] += len(hit)
                fails = sum(name in s[1] for s in own)
                out[part, "".join(order), step] = [len(left), len(hit), fails - len(hit), sum(s[1] == {name} for s in own), sum(s[2] for s in hit), sum(s[3] for s in hit), name]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = share[row[-1]] if isinstance(row[-1], str) else row[-1]
    return {k: tuple(v) for k, v in out.items()}


def rows_of(df):
    found = [((r["part"], r["filter_order"], r["step"]), tuple(r[c] for c in f.COUNTS)) for r in df.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


def test_equals_a_plain_replay(spark):
    words = " ".join(f"w{i}" for i in range(60))
    texts = [words, words, words.upper(), words + " 50%", "same " * 70, "same " * 70, "", None, None, "A|B", "x y", words + " #", words.upper() + " #", "\x0b\t " * 40, "é " * 60, words]
    docs = [(i, t, ("s", "t", None)[i % 3]) for i, t in enumerate(texts)] + [(None, words, "t"), (4, "same " * 70, "s"), (0, words, "u"), (0, words, "s")]
    labels = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0), (3, 0, 1), (5, None, 1), (9, 0, 0), (None, 1, 1), (77, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, source string, n int, mask string").repartition(3)
    got = rows_of(f.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == plain(docs, labels)


def test_equals_a_plain_replay_of_the_table(spark, small):
    read = lambda n: [tuple(r) for r in spark.read.parquet(f"{small}/{n[0]}.parquet").select(*n[1:]).collect()]
    assert rows_of(f.op13_filter_audit(spark, small)) == plain(read(("documents", "doc_id", "text", "source")), read(("labels", "doc_id", "quality", "toxic")))


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        path = list(f.swaps(n))
        for k in path:
            order[k : k + 2] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == len(path) + 1 == len(list(permutations(range(n))))


def test_a_swap_counts_only_two_steps(monkeypatch):
    walk = f.Walk({m: (m + 1, 1, 0) for m in range(32)})
    asked = []
    plain_removed = walk.removed
    monkeypatch.setattr(walk, "removed", lambda *a: asked.append(a) or plain_removed(*a))
    walk.swap(2)
    assert len(asked) == 2 and [r[3] for r in walk.rows()] == [r[3] for r in fresh(walk)]


def fresh(walk):
    other = f.Walk(walk.found)
    other.order = list(walk.order)
    other.steps = [other.removed(x, sum(1 << y for y in walk.order[:k])) for k, x in enumerate(walk.order)]
    return other.rows()


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert f.audit(empty, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert len(rows_of(f.audit(one, labels))) == 600


def test_copies_of_a_hot_text(spark):
    rows = [(i, "copy " * 3, "s") for i in range(3000)] + [(10_000 + i, f"own {i}", "s") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    got = rows_of(f.audit(df, spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")))
    assert got["s", "EABCD", 1][1] == 2999 and got["s", "EABCD", 1][4] == 1
