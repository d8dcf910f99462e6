import numpy as np
import pytest

from sitetide.llm import toxicity

INSULTS = ["idiot", "loser", "moron"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("aeiourstlnmp"), rng.integers(3, 9))) for _ in range(400)]
    rows, marks = [], []
    for k in range(600):
        words = list(rng.choice(vocabulary, 30))
        if k % 2:
            word = INSULTS[k % 3]
            words[k % 30] = word if k % 7 else word[:2] + "x" + word[2:]
        rows.append((k, " ".join(words)))
        marks.append((k, k % 2))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


@pytest.mark.parametrize("size", [toxicity.SAMPLE_TEXTS, 150])
def test_finds_insults_whatever_the_balance_of_the_sample(corpus, size, monkeypatch):
    monkeypatch.setattr(toxicity.training_rows, "__defaults__", (size,))
    docs, labels = corpus
    rows = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.95 * len(rows)
    odd = docs.sparkSession.createDataFrame([(1, None), (2, ""), (3, "i d i o t"), (None, "the id-iot sleeps")], "doc_id long, text string")
    found = {r["text"]: r["score"] for r in toxicity.score(odd, toxicity.train(docs, labels)).collect()}
    assert found[None] == found[""] < 0.5 and all(0 <= x <= 1 for x in found.values())


def test_without_labels_or_rows(corpus, docs, empty):
    frame, labels = corpus
    assert toxicity.train(frame, labels.limit(0)) is None and toxicity.train(empty, labels) is None
    assert toxicity.score(docs.withColumnRenamed("lang", "score"), None).filter("score <> 0").count() == 0
    assert toxicity.score(empty, None).count() == 0


def test_kernel_counts_gapped_subsequences():
    def brute(s, t, n, lam):
        from itertools import combinations

        out = 0.0
        for a in combinations(range(len(s)), n):
            for b in combinations(range(len(t)), n):
                if all(s[x] == t[y] for x, y in zip(a, b, strict=True)):
                    out += lam ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return out

    pairs = [("idiot", "idxiot"), ("abc", "abd"), ("moron", "mormon")]
    got = toxicity.subsequence_kernel(toxicity.codes([a for a, _ in pairs], 0), toxicity.codes([b for _, b in pairs], -1))
    assert np.allclose(got, [brute(a, b, toxicity.ORDER, toxicity.DECAY) for a, b in pairs], rtol=1e-5)


def test_every_marked_word_is_near_a_landmark_and_parts_of_long_words_are_seen():
    """Marked words far down the list, drawn-out ones, and short ones inside long runs."""
    rng = np.random.default_rng(5)
    bad = list(dict.fromkeys("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(400)))
    marks = toxicity.covering(bad, toxicity.LANDMARKS * 3 // 4)
    assert (toxicity.Landmarks(marks).matrix(bad).max(axis=1) >= toxicity.COVERED).all()
    model = toxicity.Model(["idiot", "loser"], np.array([2.0, 2.0]), -1.0)
    plain, *odd = toxicity.Scorer(model).margins(["table", "idiiiiiiiiiot", "qqwwzzxxvvidiotkkjjhhgg", "abcdidiotwxyz", "looooooooooooooooooooooser"])
    assert plain == -1.0 and min(odd) > 0


def test_a_handful_of_labelled_texts_fits_something(spark, small):
    """Ten toxic texts: no word is beyond chance, yet toxic texts score higher, held-out ones too."""
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = [(r["score"], toxic[r["doc_id"]], r["held_out"]) for r in toxicity.op8_string_kernel(spark, small).collect() if toxic.get(r["doc_id"]) is not None]
    assert len({s for s, _, _ in got}) > 1
    for held in (True, False):
        bad, good = ([s for s, t, h in got if t == k and h == held] for k in (1, 0))
        if bad and good:
            assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good)) > 0.5
    assert sum(s >= 0.5 for s, t, _ in got if not t) <= 0.1 * len(got)


def test_a_class_without_words_gives_no_model(spark):
    docs = spark.createDataFrame([(i, "..." if i % 2 else "some clean words here", "x") for i in range(20)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="no words"):
        assert toxicity.train(docs, labels) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_long_texts_repeats_and_ties(spark, corpus):
    """Words are judged wherever they stand in a long text; equal texts and repeated rows score alike."""
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    bad = docs.join(labels.filter("toxic = 1"), "doc_id").filter("text is not null").first()["text"]
    filler = "table window garden " * 60_000
    rows = [(1, filler), (2, filler + bad), (3, bad), (3, bad), (None, bad), (4, filler)]
    got = {}
    for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect():
        assert got.setdefault(r["text"], r["score"]) == r["score"]
    assert got[filler + bad] >= got[bad] - 1e-9 > got[filler] - 1e-9
