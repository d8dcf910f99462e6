"""Bounds lose no pair: search and join against all pairs; topics of a run in groups and in rounds against a plain loop."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from sitetide.functions import text
from sitetide.operators import similarity, topics

KIND = "id long, site_id long, title string, text string, settled boolean"


def vectors_of(docs, known=None):
    stop, terms = set(text.STOPWORDS.split()), {}
    for k, _, title, body, _ in docs:
        c = Counter()
        for part, weight in ((body, 1), (title, text.TITLE_WEIGHT)):
            for w in re.findall("[а-яёa-z0-9]+", (part or "").lower().replace("ё", "е")):
                if len(w) > 2 and w not in stop:
                    c[re.sub(text.STEM, r"\1", w)] += weight
        terms[k] = c
    df, total = known or (Counter(t for c in terms.values() for t in c), len(terms))
    out = {}
    for k, c in terms.items():
        v = {t: n * (math.log((total + 1) / (df[t] + 1)) + 1) for t, n in c.items() if t in df}
        size = math.sqrt(sum(x * x for x in v.values()))
        if size:
            out[k] = {t: x / size for t, x in v.items()}
    return out, (df, total)


def cosine(a, b):
    return sum(x * b[t] for t, x in a.items() if t in b)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghik") for _ in range(rng.randint(3, 6))) for _ in range(120)] + ["стоимость", "стоимости", "школа", "школы"]
    base = [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(2, 40))) for _ in range(60)]
    rows = []
    for k in range(400):
        body = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 3))):
            body[rng.randrange(len(body))] = rng.choice(words)
        title = rng.choice((None, "", rng.choice(words), "Школы " + rng.choice(words)))
        rows.append((k, rng.randrange(4), title, rng.choice((" ".join(body), " ".join(body), base[0])), rng.random() < 0.1))
    return [*rows, (900, 1, None, None, False), (901, 2, "", "the", False), (902, None, None, base[0], False)]


@pytest.mark.parametrize(("k", "floor"), [(1, 0.0), (3, 0.0), (5, 0.7), (None, 0.6), (None, 0.0)])
def test_search_equals_all_pairs(spark, cases, k, floor):
    docs, asked = cases[:300], cases[250:]
    have, known = vectors_of(docs)
    want = {}
    for q, v in vectors_of(asked, known)[0].items():
        found = sorted((-round(s, 6), d) for d, w in have.items() if (s := cosine(v, w)) > 0 and s >= floor)
        want[q] = found if k is None else found[:k]
    got = defaultdict(list)
    for r in similarity.search(spark.createDataFrame(asked, KIND), spark.createDataFrame(docs, KIND).repartition(5), k, floor).collect():
        got[r["query_id"]].append((-r["score"], r["id"]))
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.95])
def test_join_equals_all_pairs(spark, cases, threshold):
    have, _ = vectors_of(cases)
    member, pairs = similarity.similarity_join(spark.createDataFrame(cases, KIND), threshold)
    of = {r["id"]: r["class"] for r in member.collect()}
    assert of == {k: min(j for j, w in have.items() if w == v) for k, v in have.items()}
    heads = sorted(set(of.values()))
    want = {(a, b) for a in heads for b in heads if b < a and cosine(have[a], have[b]) >= threshold}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want


def test_equal_texts_make_no_pairs(spark):
    rows = [(k, k % 4, None, "seven small ships sail slowly", False) for k in range(200)]
    member, pairs = similarity.similarity_join(spark.createDataFrame(rows, KIND), 0.7)
    assert pairs.count() == 0 and {r["class"] for r in member.collect()} == {0}
    same = {r["id"]: r["same_as"] for r in topics.same_run_topics(spark.createDataFrame(rows, KIND)).collect()}
    assert len(same) == 200 and same == {k: 0 if k % 4 else None for k in range(200)}


def plain_topics(cases):
    have, _ = vectors_of(cases)
    joined = {}
    for k, site, _, _, settled in sorted(cases, key=lambda c: c[0]):
        site = -1 if site is None else site
        near = [(round(s, 6), -e) for e, (other, j) in joined.items() if j is None and other != site and e in have and k in have and (s := cosine(have[k], have[e])) >= topics.MERGE]
        joined[k] = (site, -max(near)[1] if near and not settled else None)
    return {k: j for k, (_, j) in joined.items()}


@pytest.mark.parametrize("group", [10_000, 3, 0])
def test_topics_of_a_run(spark, cases, group):
    want = plain_topics(cases)
    got = topics.same_run_topics(spark.createDataFrame(cases, KIND).repartition(4), group=group).collect()
    assert len(got) == len(cases) and {r["id"]: r["same_as"] for r in got} == want
    assert sum(v is not None for v in want.values()) > 50


def test_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    some = spark.createDataFrame([(1, 1, None, "word of mouth", False)], KIND)
    assert similarity.search(none, some, 3).count() == 0 and similarity.search(some, none, 3).count() == 0
    member, pairs = similarity.similarity_join(none, 0.7)
    assert member.count() == 0 and pairs.count() == 0 and topics.same_run_topics(none).count() == 0
