"""What is read from opcodes by column expressions, against the standard library and a plain walk."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from sitetide.functions import diffs, noise


def plain_runs(old, new):
    a, b = (noise.normalize(old) or "").splitlines(), (noise.normalize(new) or "").splitlines()
    codes = difflib.SequenceMatcher(None, a, b).get_opcodes()
    return [["-" + x for x in a[i:j]] + ["+" + x for x in b[k:m]] for tag, i, j, k, m in codes if tag != "equal"]


def plain_rows(old, new):
    a, b = ([x for x in (t or "").splitlines() if x.strip()] for t in (old, new))
    codes, rows = difflib.SequenceMatcher(None, a, b).get_opcodes(), []
    for n, (tag, i, j, k, m) in enumerate(codes):
        if tag != "equal":
            for x in range(max(j - i, m - k)):
                left, right = a[i + x] if i + x < j else None, b[k + x] if k + x < m else None
                rows.append((left, right, "added" if left is None else "removed" if right is None else "changed", 0))
            continue
        head, tail = 3 * (n > 0), 3 * (n < len(codes) - 1)
        same = [(x, x, "equal", 0) for x in a[i:j]]
        hidden = len(same) - head - tail
        rows += same if hidden <= 0 else [*same[:head], (None, None, "skip", hidden), *same[len(same) - tail :]]
    return rows[:400]


@pytest.fixture(scope="module")
def texts():
    rng, out = random.Random(9), [(None, None), ("", "a"), ("a", None), ("a\nb", "a\nb"), ("x\n\ny", "y\n \nx"), ("a\nb\nc\nd\ne\nf\n\ng", "a\nb\nc\nd\ne\nf\nh\ni")]
    for _ in range(120):
        old = [f"line {rng.randrange(30)}" for _ in range(rng.randrange(40))]
        new = list(old)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(new) + 1)
            new[at : at + rng.randrange(3)] = [f"new {rng.randrange(9)}" for _ in range(rng.randrange(3))]
        out.append(("\n".join(old), "\n".join(new)))
    return [*out, ("\n".join(f"l{k}" for k in range(1500)), "\n".join(f"l{k}" if k % 9 else f"m{k}" for k in range(1500)))]


def read(spark, texts, kind):
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "k int, old string, new string").repartition(3)
    return rows.select("k", diffs.opcodes(kind)("old", "new").alias("d"))


def test_unified(spark, texts):
    made = diffs.with_hunks(read(spark, texts, "stripped"), "d").select("k", diffs.unified(F.col("hunks")).alias("t"))
    lines = lambda x: noise.strip_rotating(x or "").splitlines()
    want = {k: "\n".join(difflib.unified_diff(lines(a), lines(b), "было", "стало", lineterm="", n=2)) for k, (a, b) in enumerate(texts)}
    assert {r["k"]: r["t"] for r in made.collect()} == want and sum("@@" in t for t in want.values()) > 80
    assert max(t.count("@@ -") for t in want.values()) > 100


def test_side_by_side(spark, texts):
    got = read(spark, texts, "worded").select("k", diffs.side_by_side(F.col("d")).alias("r")).collect()
    assert {r["k"]: [tuple(x) for x in r["r"]] for r in got} == {k: plain_rows(*t) for k, t in enumerate(texts)}
    assert max(len(r["r"]) for r in got) == diffs.MAX_ROWS


def test_change_runs(spark, texts):
    got = read(spark, texts, "normal").select("k", diffs.change_runs(F.col("d")).alias("r")).collect()
    assert {r["k"]: r["r"] for r in got} == {k: plain_runs(*t) for k, t in enumerate(texts)}
