"""Toxicity: a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

A text is a bag of sentences, a sentence a bag of short segments of letters. The machine is trained on labelled
sentences: each is seen through the segment with the largest margin, and of a toxic text only sentences that the
machine so far finds toxic count as such, as the others may be clean. A machine over landmarks
is one weight for each subsequence of letters, so a segment's margin needs no kernel values.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetide.llm.bpe import pieces, split_words
from sitetide.session import ship, table, trim, written

#: Bounds of what is fitted: labelled texts of each class, marked words that are landmarks at first and at most (with a
#: third as many clean ones), words of each class that the machine starts from.
SAMPLE_TEXTS = 6000
LANDMARKS = 160
MOST = 480
SAMPLE_WORDS = 3000
#: Rounds of training on labelled sentences, and sentences of a text that are looked at.
ROUNDS = 3
SENTENCES = 3
#: One in so many labelled texts only serves to turn margins into probabilities.
CALIBRATE = 5
#: Subsequences of ORDER letters; a gap costs DECAY for each letter it spans.
ORDER = 3
DECAY = 0.6
#: Segments have at most so many letters, with marks of a word's begin and end; longer words are seen as overlapping
#: stretches of SHORT letters.
LETTERS = 10
SHORT = 8
#: Letters are told apart by so many codes: a to z have one each, all others share the rest.
CODES = 64
#: A marked word is covered by a landmark with this kernel value.
COVERED = 0.7
#: So many counted pieces are kept before they are handed on, and so many rows are worked on at a time.
HELD = 200_000
ROWS = 8192
#: Lengths of the stretches of letters that are counted to find words that mark toxic texts.
GRAMS = (4, 5, 6)
#: A piece marks toxic texts if it stands in them this many times as often as in clean ones; a sure one even more.
RATIO = 7.0
SURE = 14.0
#: Words whose margin a task remembers, and bytes of text that it takes at a time.
CACHE_WORDS = 1 << 16
PIECE_BYTES = 1 << 20
_NOT_LETTER = re.compile(r"[\W\d_]+")
_DRAWN = re.compile(r"(.)\1{2,}")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][^\w\s]?[ ]){3,}[^\W\d_](?![^\W\d_])")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|[\r\n]+")


def letters(chunk: str) -> str:
    """The letters of a word in lower case, without characters put between them."""
    return chunk.lower() if chunk.isalpha() and chunk.isascii() else _NOT_LETTER.sub("", chunk.lower())


def spaced_words(text: str) -> list[str]:
    """Words written as single letters with blanks between them."""
    return [letters(m[0]) for m in _SPACED.finditer(text)]


def stretches(word: str) -> list[str]:
    if len(word) <= LETTERS:
        return [word]
    return [word[s : s + LETTERS] for s in range(0, len(word) - LETTERS // 2, LETTERS // 2)]


def views(word: str) -> list[str]:
    """The segments of a word between marks of its begin and end: whole, or its stretches; also with drawn-out letters
    cut to one or two."""
    drawn = _DRAWN.search(word)
    if not drawn and len(word) <= LETTERS - 2:
        return [f"<{word}>"]
    forms = (word, _DRAWN.sub(r"\1", word), _DRAWN.sub(r"\1\1", word)) if drawn else (word,)
    out = []
    for w in dict.fromkeys(forms):
        w = f"<{w}>"
        if len(w) <= LETTERS:
            out.append(w)
        else:
            out += [w[s : s + SHORT] for s in range(0, len(w) - SHORT + 2, 2)]
    return out if len(out) == 1 else list(dict.fromkeys(out))


def head(word: str) -> str:
    """The begin of a word as a landmark."""
    return f"<{word}>"[:LETTERS]


def words_of(sentence: str) -> list[str]:
    """The distinct words of a sentence in letters, spaced ones included."""
    words = dict.fromkeys(letters(w) for w in sentence.split())
    words.update(dict.fromkeys(spaced_words(sentence)))
    return list(words)


def codes(words: list[str], fill: int) -> np.ndarray:
    """Letters as codes from 1, one row for each word; ``fill`` stands beyond its end."""
    most = max(map(len, words), default=0)
    o = np.frombuffer("".join(w.ljust(most, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), most).astype(np.int32)
    plain = (o >= 97) & (o <= 122)
    other = np.where(o == 60, CODES - 2, np.where(o == 62, CODES - 1, 27 + o % (CODES - 29)))  # the marks have codes of their own
    return np.where(o == 0, fill, np.where(plain, o - 96, other))


def subsequence_kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The kernel of each pair of rows: common subsequences of ``order`` letters, weighted by the letters they span."""
    out = np.zeros(len(s))
    for at in range(0, len(s), 16384):
        a, b = s[at : at + 16384].T, t[at : at + 16384].T
        la = int((a > 0).any(axis=1).sum())
        lb = int((b > 0).any(axis=1).sum())
        before = np.ones((la + 1, lb + 1, a.shape[1]), np.float32)
        hits = [[(a[i] == b[j]) for j in range(lb)] for i in range(la)]
        for _ in range(order - 1):
            now = np.zeros_like(before)
            for i in range(la):
                run = np.zeros(a.shape[1], np.float32)
                for j in range(lb):
                    run = decay * run + hits[i][j] * (decay * decay * before[i, j])
                    now[i + 1, j + 1] = decay * now[i, j + 1] + run
            before = now
        total = np.zeros(a.shape[1])
        for i in range(la):
            for j in range(lb):
                total += hits[i][j] * (decay * decay * before[i, j])
        out[at : at + 16384] = total
    return out


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of words of one length and their codes, a column each; words without a subsequence are left out."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in range(ORDER, LETTERS + 1):
        at = np.flatnonzero(sizes == n)
        for s in range(0, len(at), ROWS):
            part = at[s : s + ROWS]
            yield part, np.ascontiguousarray(codes([words[k] for k in part.tolist()], 0).T)


def subsequences(columns: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """For each choice of three places: its weight, and the number of the subsequence of each word."""
    n = len(columns)
    for i in range(n - 2):
        first = columns[i] << 12
        for j in range(i + 1, n - 1):
            two = first | (columns[j] << 6)
            for k in range(j + 1, n):
                yield DECAY ** (k - i + 1), two | columns[k]


def lengths(columns: np.ndarray) -> np.ndarray:
    """The root of each word's kernel with itself."""
    return np.sqrt(subsequence_kernel(columns.T, columns.T))


def weighted(words: list[str], weights: np.ndarray) -> np.ndarray:
    """The sum over each word's subsequences of their weights, for a word of length 1; shorter words have none."""
    out = np.zeros(len(words))
    for at, columns in by_length(words):
        total = np.zeros(len(at), np.float32)
        for decay, number in subsequences(columns):
            total += np.float32(decay) * weights[number]
        out[at] = total / lengths(columns)
    return out


class Landmarks:
    """Normalised kernel values of words against fixed landmark words."""

    def __init__(self, words: list[str]):
        self.words, parts = words, []
        for at, columns in by_length(words):
            own = lengths(columns)
            parts += [(number, at, decay / own) for decay, number in subsequences(columns)]
        number, at, value = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, int),) * 3
        self.row = np.zeros(CODES**ORDER, np.int32)
        used = np.unique(number)
        self.row[used] = np.arange(1, len(used) + 1)
        self.table = np.zeros((len(used) + 1, len(words)), np.float32)  # row 0: subsequences that no landmark has
        np.add.at(self.table, (self.row[number], at), value)

    def matrix(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        for at, columns in by_length(words):
            for s in range(0, len(at), 512):
                part = np.zeros((len(columns[0][s : s + 512]), len(self.words)), np.float32)
                for decay, number in subsequences(columns[:, s : s + 512]):
                    part += np.float32(decay) * self.table[self.row[number]]
                out[at[s : s + 512]] = part / lengths(columns[:, s : s + 512])[:, None]
        return out

    def collapsed(self, alpha: np.ndarray) -> np.ndarray:
        """One weight for each subsequence, equal to the landmarks weighted by ``alpha``."""
        return (self.table @ alpha.astype(np.float32))[self.row]


def fit_svm(x: np.ndarray, y: np.ndarray, strength: np.ndarray, c: float = 20000.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss and balanced classes, by Newton steps over the rows inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, strength / max(1e-9, strength[y > 0].sum()), strength / max(1e-9, strength[y < 0].sum()))
    penalty = np.diag(np.append(np.full(x.shape[1], 1 / (2 * c)), 1e-6))
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        inside = y * (x1 @ w) < 1
        z = x1[inside] * weight[inside, None]
        step = np.linalg.solve(x1[inside].T @ z + penalty, z.T @ y[inside]) - w
        w = w + step * (1.0 if _ < 20 else 0.5)
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method; the last weight is the constant."""
    x1, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - y) + ridge * w
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    """Landmark words, their weights and the constant for a segment's margin; slope and constant of the probability."""

    words: list[str]
    alpha: np.ndarray
    bias: float
    scale: np.ndarray | None = None


class Scorer:
    """Margins of words (their best segment's), remembered within a bound."""

    def __init__(self, model: Model):
        self.bias, self.met = model.bias, {}
        self.weights = Landmarks(model.words).collapsed(model.alpha)

    def of_segments(self, found: list[str]) -> np.ndarray:
        return weighted(found, self.weights) + self.bias

    def best(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """The largest margin of each word's segments, and that segment."""
        parts = [views(w) for w in words]
        flat = [v for p in parts for v in p]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        each, ends = self.of_segments(flat), np.cumsum(sizes)
        top = np.maximum.reduceat(each, ends - sizes) if len(words) else each
        at = np.flatnonzero(each == np.repeat(top, sizes))
        first = at[np.searchsorted(at, ends - sizes)] if len(words) else at
        return top, [flat[k] for k in first.tolist()]

    def margins(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.met})
        if len(self.met) + len(new) > CACHE_WORDS:
            self.met = {}
            new = list(set(words))
        self.met.update(zip(new, self.best(new)[0].tolist(), strict=True))
        return np.array([self.met[w] for w in words])

    def texts(self, texts: pa.Array) -> np.ndarray:
        """The largest margin of each text; that of no letters where it has none."""
        chunks, bounds = split_words(texts)
        coded = chunks.dictionary_encode()
        top = np.full(len(texts), self.bias)
        if len(chunks):
            each = self.margins([letters(w) for w in coded.dictionary.to_pylist()])[coded.indices.to_numpy(zero_copy_only=False)]
            some = np.flatnonzero(np.diff(bounds))
            top[some] = np.maximum.reduceat(each, bounds[:-1][some])
        for k, text in enumerate(texts.to_pylist()):
            apart = spaced_words(text) if text else []
            if apart:
                top[k] = max(top[k], self.margins(apart).max())
        return top


def training_rows(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_TEXTS) -> DataFrame:
    """``text, toxic, apart``: distinct labelled texts, from at most ``size`` ids of each class taken by a hash, held-out
    ids left out. A repeated id gives one text, a text of both classes counts as toxic; ``apart`` marks those kept for
    the probabilities.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    open_ = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    known = known.filter(open_).withColumn("h", F.xxhash64("doc_id"))
    picked = known.filter("toxic = 1").orderBy("h", "doc_id").limit(size).unionByName(known.filter("toxic = 0").orderBy("h", "doc_id").limit(size))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id")
    once = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).groupBy("text").agg(F.max("toxic").alias("toxic"))
    return once.withColumn("apart", F.pmod(F.xxhash64("text"), F.lit(CALIBRATE)) == 0)


def grams(word: str) -> set[str]:
    """Stretches of four to six letters."""
    return {word[s : s + n] for n in GRAMS for s in range(len(word) - n + 1)}


def _counts(rows: DataFrame) -> DataFrame:
    """``piece, whole, t, c``: toxic and clean texts that hold a word (``whole``) or a stretch of letters."""

    def handed(counts: dict[tuple[str, bool], list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in counts], pa.string()),
                pa.array([k[1] for k in counts], pa.bool_()),
                pa.array([v[0] for v in counts.values()], pa.int64()),
                pa.array([v[1] for v in counts.values()], pa.int64()),
            ],
            ["piece", "whole", "t", "c"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, bool], list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(counts) > HELD:
                    yield handed(counts)
                    counts = {}
                chunks = {letters(w) for w in (text or "").split()} | set(spaced_words(text or ""))
                words = {s for w in chunks if len(w) > 2 for s in stretches(w)}
                keys = [(w, True) for w in words] + [(g, False) for g in set().union(*map(grams, words))]
                for key in keys:
                    counts.setdefault(key, [0, 0])[0 if toxic else 1] += 1
            yield handed(counts)
        trim()

    made = rows.mapInArrow(run, "piece string, whole boolean, t long, c long")
    return made.groupBy("piece", "whole").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _contexts(rows: DataFrame, tried: set[str]) -> DataFrame:
    """``piece, t, c`` of the given pieces, counting distinct neighbourhoods, so that copies of a text count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[str]] = {}
        for batch in batches:
            seen = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [letters(w) for w in (text or "").split()] + spaced_words(text or "")
                for k, word in enumerate(words):
                    if word not in known:
                        known[word] = {p for s in stretches(word) for p in (grams(s) | {s}) & tried}
                    for piece in known[word]:
                        seen.add((piece, " ".join(words[max(0, k - 1) : k + 2]), bool(toxic)))
            cols = list(zip(*seen, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, kinds, strict=True)], ["piece", "around", "toxic"])

    made = rows.mapInArrow(run, "piece string, around string, toxic boolean").distinct()
    return made.groupBy("piece").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c"))


def covering(bad: list[str], first: int, most: int = MOST) -> list[str]:
    """The ``first`` marked words, and of the rest those that none taken before comes near, up to ``most``."""
    open_, taken = np.ones(len(bad), bool), []
    for k in range(len(bad)):
        if (k < first or open_[k]) and len(taken) < most:
            taken.append(k)
            one = Landmarks([bad[k]])
            open_ &= weighted(bad, one.collapsed(np.ones(1))) < COVERED
    return [bad[k] for k in taken]


def witnesses(rows: DataFrame, model: Model) -> list:
    """``toxic, apart, first, segment, margin`` of the ``SENTENCES`` best sentences of each text (bounded by the sample).

    A sentence is seen through its segment with the largest margin; ``first`` marks the best sentence of a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = [[p for p in (words_of(x) for x in _SENTENCE.split(text or "")) if p] or [[""]] for text in batch.column(0).to_pylist()]
            words = list({w for parts in texts for p in parts for w in p})  # each word of the batch is measured once
            top, segment = scorer.best(words)
            number, out = {w: k for k, w in enumerate(words)}, []
            for parts, toxic, apart in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                each = np.fromiter((number[w] for p in parts for w in p), np.int64, int(sizes.sum()))
                starts = np.cumsum(sizes) - sizes
                best = np.maximum.reduceat(top[each], starts)
                for nth, k in enumerate(np.argsort(-best, kind="stable")[:SENTENCES].tolist()):
                    at = each[starts[k] + int(np.argmax(top[each[starts[k] : starts[k] + sizes[k]]]))]
                    out.append((int(toxic), bool(apart), nth == 0, segment[at], float(best[k])))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["toxic", "apart", "first", "segment", "margin"])
        del scorer
        trim()

    return rows.select("text", "toxic", "apart").mapInArrow(run, "toxic int, apart boolean, first boolean, segment string, margin double").collect()


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the bounded sample; None where it lacks one of the classes.

    Landmarks and the first machine come from words: those with a stretch of letters that toxic texts hold far more
    often than chance allows (a likelihood ratio beyond what the number of pieces tried would give), and words of clean
    texts. Then the machine is trained on the labelled sentences, as the module says. Where no word is beyond chance, the
    likeliest words of toxic texts are the landmarks, so a handful of labelled texts is enough to fit something; without a
    word in either class it warns and gives None.
    """
    ship(docs.sparkSession)
    rows = written(training_rows(docs, labels), "training")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return None
    share = size[1] / (size[1] + size[0])
    counts = written(_counts(rows), "piece-counts")
    n, t, c = F.col("t") + F.col("c"), F.col("t"), F.col("c")
    gain = t * F.log(t / (n * share)) + F.when(c > 0, c * F.log(c / (n * (1 - share)))).otherwise(0.0)
    often_toxic = t * float(size[0]) > c * (RATIO * size[1])  # shares of the classes, so that their balance does not matter
    surprise = F.when(often_toxic, gain).otherwise(0.0)
    counts = counts.withColumn("g", F.when(t > 0, surprise).otherwise(0.0))
    level = float(np.log(counts.count() + 2)) + 2
    tried = [r["piece"] for r in counts.filter(F.col("g") > level).orderBy(F.desc("g"), "piece").limit(SAMPLE_WORDS).collect()]
    again = _contexts(rows, set(tried)).withColumn("g", F.when(often_toxic, gain).otherwise(0.0))
    strong = {r["piece"]: r["t"] * size[0] > SURE * r["c"] * size[1] for r in again.filter(F.col("g") > level).collect()}  # at most those tried
    sure = {p for p, alone in strong.items() if alone}
    likely = counts.filter("whole and t > 0").filter(often_toxic).orderBy(F.desc("g"), "piece").limit(10 * SAMPLE_WORDS).collect()
    marked = [(r["piece"], r["t"]) for r in likely if r["piece"] in strong or (not r["c"] and grams(r["piece"]) & sure)][:SAMPLE_WORDS]
    clean = counts.filter("whole and c >= 1").filter(~often_toxic)
    often = clean.orderBy(F.desc("c"), "piece").limit(SAMPLE_WORDS // 2)
    any_ = clean.orderBy(F.xxhash64("piece"), "piece").limit(10 * SAMPLE_WORDS)
    marked = marked or [(r["piece"], r["t"]) for r in likely[:LANDMARKS]]  # none is beyond chance: the likeliest are segments to learn from
    bad = [head(w) for w, _ in marked]
    good = [head(r["piece"]) for r in often.unionByName(any_).collect()]
    good = list(dict.fromkeys(good))
    if not bad or not good:
        warnings.warn(f"labels of both classes ({size[1]} toxic, {size[0]} clean texts), but no words in one of them", stacklevel=2)
        return None
    marks = covering(bad, LANDMARKS * 3 // 4)
    near = Landmarks(marks).matrix(good).max(axis=1)
    close = np.argsort(-near, kind="stable")  # clean words most like the marked ones teach the difference
    words = marks + [good[k] for k in close[: max(LANDMARKS // 4, len(marks) // 3)]]
    good = [good[k] for k in close[:SAMPLE_WORDS]] + good[: SAMPLE_WORDS // 2]
    landmarks = Landmarks(words)
    square = landmarks.matrix(words).astype(np.float64)
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.02))) @ vectors.T

    def machine(found: list[str], y: np.ndarray, strength: np.ndarray) -> Model:
        w, bias = fit_svm(landmarks.matrix(found) @ root, y, strength)
        return Model(words, root @ w, bias)

    start = [n for _, n in marked] + [1] * len(good)
    model = machine([*bad, *good], np.array([1.0] * len(bad) + [-1.0] * len(good)), np.sqrt(np.array(start, float)))
    for _ in range(ROUNDS):
        seen = witnesses(rows.filter(~F.col("apart")), model)
        some = any(r["toxic"] and r["margin"] > 0 for r in seen)
        counts_of: dict[tuple[str, float], int] = {}
        for r in seen:
            if not r["toxic"] or r["margin"] > 0 or (r["first"] and not some):
                key = (r["segment"], 1.0 if r["toxic"] else -1.0)
                counts_of[key] = counts_of.get(key, 0) + 1
        model = machine([k[0] for k in counts_of], np.array([k[1] for k in counts_of]), np.array(list(counts_of.values()), float))
    best = [(r["margin"], r["toxic"], r["apart"]) for r in witnesses(rows, model) if r["first"]]
    told = [b for b in best if b[2]]
    told = told if len({t for _, t, _ in told}) == 2 else best
    model.scale = fit_logistic(np.array([[m] for m, _, _ in told]), np.array([t for _, t, _ in told], float))
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` from the text alone; without a model all scores are 0.

    Null, empty and wordless texts get the score of no letters; long texts are taken word by word. Equal texts, repeated
    rows and ties get equal scores; an empty table gives none. Columns of these names are replaced; others pass through.
    """
    return scored(docs.drop("score", "predicted"), model, "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def scored(docs: DataFrame, model: Model | None, name: str) -> DataFrame:
    """``docs`` with the probability of being toxic in a column ``name`` that it does not have."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for texts in batches:
            rows = pa.RecordBatch.from_arrays([pa.nulls(len(texts)), texts], ["at", "text"])
            z = [scorer.texts(p.column(1)) * model.scale[0] + model.scale[1] for p in pieces(rows, PIECE_BYTES)]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate([*z, np.empty(0)]), -30, 30))))
        del scorer
        trim()

    return docs.withColumn(name, probability(F.col("text")))


def op8_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
