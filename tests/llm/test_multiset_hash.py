"""Fingerprints: brute force of the contract, order of paragraphs, insertion and deletion, nulls, repeated rows."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitetide.llm import multiset_hash as m


def pairs(text):
    out = Counter()
    for line in text.split("\n"):
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in line).split(" ") if x]
        out.update(zip(w, w[1:], strict=False) if len(w) > 1 else w)
    return out


def cosine(a, b):
    x, y = pairs(a), pairs(b)
    size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return 1.0 if a == b else sum(v * y[k] for k, v in x.items()) / size if size else 0.0


def edits(docs):
    """What each (id, text), null texts as empty, must give: its edited text and the next one's text."""
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0))
    out = {}
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        q = len(text) // 4
        out[i, text] = (text[: len(text) - q] + after[:q], after)
    return out


def fp_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return {r["k"]: r["fp"] for r in m.fingerprints(rows, ["k"]).collect()}


def test_equals_brute_force(spark, docs, rows):
    texts = {r[0]: r[1] or "" for r in rows if r[1] != "again three"}
    want = edits(list(texts.items()))
    got = {r["doc_id"]: r for r in m.compared(docs.filter("text is null or text <> 'again three'")).collect()}
    assert sorted(map(str, got)) == sorted(map(str, texts))
    for i, text in texts.items():
        r, (edited, after) = got[i], want[i, text]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - cosine(text, edited)) < 0.35 and abs(r["near_next"] - cosine(text, after)) < 0.35
    assert len({got[i]["fingerprint"] for i in (0, 1, 15, None)}) == 1


def test_repeated_rows_and_ids(spark, docs, rows):
    got = m.compared(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    again = [r for r in got if r["doc_id"] == 3]
    assert len(again) == 3 and len(set(again)) == 2 and sorted(r["n_chars"] for r in again) == [0, 11, 11]


def test_edited_fingerprints_are_those_of_the_edited_texts(spark, small):
    got = m.op11_multiset_hash(spark, small).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = edits(list(texts.items()))
    fresh = spark.createDataFrame([(i, want[i, t][0]) for i, t in texts.items()], "k long, text string")
    expect = {r["k"]: r["f"] for r in m.fingerprints(fresh, ["k"]).select("k", m.text_of(F.col("fp")).alias("f")).collect()}
    assert {r["doc_id"]: r["edited_fingerprint"] for r in got} == expect
    assert len({r["fingerprint"] for r in got}) == len(set(texts.values()))
    assert sum(r["near_edited"] > r["near_next"] for r in got) >= 0.98 * len(got)
    wrong = [abs(r["near_edited"] - cosine(texts[r["doc_id"]], want[r["doc_id"], texts[r["doc_id"]]][0])) for r in got]
    assert sum(wrong) / len(wrong) < 0.06


def test_order_does_not_matter_and_number_does(spark):
    fp = fp_of(spark, ["a b c\n\nd e\nf", "f\nd e\n\na b c", "a b c\nd e\nf", "a b c\n\nd e\nf\nf", "b a c\n\nd e\nf", "", None])
    assert fp[0] == fp[1] and fp[5] == fp[6]
    assert len({tuple(v) for v in fp.values()}) == 5


def test_insertion_and_deletion(spark):
    fp = fp_of(spark, ["one two\nthree\nfour five six", "one two\nfour five six", "three", "three\nthree\none two\nfour five six"])
    row = spark.createDataFrame([(fp[0], fp[2])], "a array<bigint>, b array<bigint>")
    made = row.select(m.minus(F.col("a"), F.col("b")).alias("less"), m.plus(F.col("a"), F.col("b")).alias("more")).first()
    assert made["less"] == fp[1] and made["more"] == fp[3]


def test_lanes_wrap_at_two_to_the_32(spark):
    top = (1 << 32) - 1
    row = spark.createDataFrame([([(5 << 32) | top, -1], [(7 << 32) | 1, 1])], "a array<bigint>, b array<bigint>")
    made = row.select(m.plus(F.col("a"), F.col("b")).alias("s")).select("s", m.minus(F.col("s"), F.lit(row.first()["b"])).alias("d")).first()
    assert made["s"] == [12 << 32, -(1 << 32)] and made["d"] == row.first()["a"]


def test_groups_of_documents_add_up(spark):
    rows = spark.createDataFrame([("x", "a b\nc"), ("x", "d"), ("y", "d\na b\nc")], "k string, text string")
    found = {r["k"]: r["fp"] for r in m.fingerprints(rows, ["k"]).collect()}
    assert found["x"] == found["y"]


def test_empty_table_single_row_and_clashing_columns(spark, empty):
    assert m.compared(empty).count() == 0
    one = spark.createDataFrame([(4, "w x y z\nq", "a", 1, 2)], "doc_id long, text string, fp string, k int, next_k int")
    got = m.compared(one).collect()
    assert len(got) == 1 and got[0]["near_next"] == 1.0 and got[0]["n_chars"] == 9
    words = spark.createDataFrame([("b", "x y"), ("a", "x y z")], "doc_id string, text string")
    assert sorted(r["doc_id"] for r in m.compared(words).collect()) == ["a", "b"]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_long_texts_are_whole(spark, n):
    text = "\n".join(f"w{i} v{i} u{i}" for i in range(40_000)) + "\nend" * n
    got = {r["doc_id"]: r for r in m.compared(spark.createDataFrame([(1, text), (2, text + "!")], "doc_id long, text string")).collect()}
    assert got[1]["n_chars"] == len(text) and got[1]["fingerprint"] != got[2]["fingerprint"] and got[1]["near_next"] > 0.99
