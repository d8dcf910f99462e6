"""TF-IDF similarity by products of packs of documents, each an inverted index: pairs that fall short never leave a task."""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitetide.functions.text import STEM, STOPWORDS, TITLE_WEIGHT
from sitetide.operators.ordered import numbered
from sitetide.session import ship, spread, trim, written

#: Documents and words of a chunk, and chunks of a file or of a task that tells their words.
CHUNK, WORDS, TOLD = 2048, 1_000_000, 4
#: Documents and tokens of a pack, less where all pairs are scored, and postings that meet at once.
PACK, TERMS = 8192, 1_000_000
SCORED = 2048, 500_000
MEETINGS = 500_000
#: Pairs of documents whose scores are held at once.
CELLS = 1 << 21
#: Tokens multiplied as columns of a matrix at once, and how many pairs of documents make such a column worth one meeting.
COLUMNS, WORTH = 512, 300
#: Ranks from which the rest of a document's vector is known, and tokens of the packs that a task keeps.
BANDS, KEPT = 32, 2 * TERMS
#: Part of the floor that may be left when two vectors stop to meet: what met before must make up for the rest of it.
DEEPER = 0.86
#: Meetings of each pair of documents up to which they are sorted, and from which all tokens are multiplied instead; and pairs
#: for each one left over from which those left are scored one by one.
SORTED, MANY, FEW = 0.3, 8, 100
#: Cells of a table of pairs, and meetings, that a core can hold close at hand.
TABLE, NEAR = 1 << 18, 1 << 18
#: Documents are packed with those that reach as deep: bounds of the idf of the token after which less than this is left.
LEVELS, LEFT = (4.0, 5.5, 7.0), 0.7
#: What a rounded score may be off, and more; what a sum of products may be off.
ROUNDING, SLACK = 1e-6, 1e-9


@dataclass
class Index:
    """``packs`` of the vectors of classes, ``members`` of the classes, and ``dictionary``: ``token, rank, df, idf``."""

    packs: DataFrame
    members: DataFrame
    dictionary: DataFrame


_WORD = re.compile("[а-яa-z0-9]{3,}")
_STOP, _ENDING = frozenset(STOPWORDS.split()), re.compile(STEM)


def _said(texts: pa.Array) -> pa.ListArray:
    """Lower-case words of more than two letters of each text."""
    found = [_WORD.findall(t.lower().replace("ё", "е")) if t else [] for t in texts.to_pylist()]
    flat = pa.array([w for words in found for w in words], pa.string())
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), flat)


def _stems(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The stems of distinct words, and the place of each word's stem; -1 for stop words."""
    stem = [None if w in _STOP else _ENDING.sub(r"\1", w) if w[-1] > "z" else w for w in words.to_pylist()]  # endings are Cyrillic
    said = pa.array(stem, pa.string()).dictionary_encode()
    return said.dictionary, said.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def term_counts(docs: DataFrame, title_weight: int = TITLE_WEIGHT) -> DataFrame:
    """Chunks of ``docs (id, title, text)``, coded by their own words: a word of the title counts three times. Nothing is
    shuffled. Tokens are those of ``functions.text.tokens``; a chunk stems each of its words once.

    ``chunk, n`` documents, of which those with a token have ``ids``, bounds ``at`` in ``codes`` and ``tfs``, and two sums
    ``k1, k2`` that are equal for equal vectors; ``words`` of the codes, and in how many documents each is, ``dfs``.
    """
    ship(docs.sparkSession)
    kind = docs.schema["id"].dataType.simpleString()

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        parts = [(whole.column(1).chunk(0), 1), (whole.column(2).chunk(0), title_weight)]
        coded = pa.concat_arrays([c.flatten() for c, _ in parts]).dictionary_encode()
        stems, of = _stems(coded.dictionary)
        code = of[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = [np.diff(c.offsets.to_numpy()) for c, _ in parts]
        row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
        weight = np.concatenate([np.full(int(n.sum()), w) for n, (_, w) in zip(sizes, parts, strict=True)])
        row, weight, code = row[code >= 0], weight[code >= 0], code[code >= 0]
        width = max(1, len(stems))
        keys, inverse = np.unique(row * width + code, return_inverse=True)
        tf = np.bincount(inverse, weight, len(keys)).astype(np.int64)
        bounds = np.searchsorted(keys, np.arange(whole.num_rows + 1) * width)
        some = np.flatnonzero(np.diff(bounds))
        at, codes = np.append(bounds[some], len(keys)), keys % width
        ids = whole.column(0).chunk(0).take(pa.array(some))
        named = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, stems.to_pylist())), np.uint64).reshape(-1, 2)
        least = tf // np.repeat(np.gcd.reduceat(tf, at[:-1]), np.diff(at)) if len(some) else tf  # of equal vectors the counts are multiples of the same ones
        sums = [np.add.reduceat(named[codes, k] * least.astype(np.uint64), at[:-1]).view(np.int64) if len(some) else tf for k in (0, 1)]
        lists = [ids, pa.array(at.astype(np.int32)), pa.array(codes.astype(np.int32)), pa.array(tf.astype(np.int32)), *map(pa.array, sums)]
        lists += [stems, pa.array(np.bincount(codes, minlength=len(stems)).astype(np.int64))]
        return _row({"n": pa.array([whole.num_rows])}, lists, ["ids", "at", "codes", "tfs", "k1", "k2", "words", "dfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, words = [], 0, 0
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(0), _said(batch.column(1)), _said(batch.column(2))], ["id", "a", "b"])
            sizes = sum(np.diff(batch.column(c).offsets.to_numpy()) for c in (1, 2)) if batch.num_rows else []
            at = 0
            for k, n in enumerate(sizes):
                if rows and (rows >= CHUNK or words + n > WORDS):
                    yield chunk([*held, batch.slice(at, k - at)])
                    held, rows, words, at = [], 0, 0, k
                rows, words = rows + 1, words + int(n)
            held.append(batch.slice(at))
        if rows:
            yield chunk(held)
        trim()

    made = spread(docs.select("id", "text", "title")).mapInArrow(run, f"n bigint, ids array<{kind}>, at array<int>, codes array<int>, tfs array<int>, k1 array<bigint>, k2 array<bigint>, words array<string>, dfs array<bigint>")
    return written(made.withColumn("chunk", F.monotonically_increasing_id()), "terms", TOLD)  # a batch of rows is read whole


def _row(plain: dict, lists: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """A row of lists."""
    made = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    return pa.RecordBatch.from_arrays([*plain.values(), *made], [*plain, *names])


def _squeezed(x: np.ndarray) -> bytes:
    """A list as compressed bytes after their number: a pack meets many others, and bytes are handed on as they are."""
    return np.int64(x.nbytes).tobytes() + pa.compress(x.tobytes(), "zstd", asbytes=True)


def _list(column: pa.Array, k: int, kind: type) -> np.ndarray:
    """The list in a row, squeezed or not."""
    if not pa.types.is_binary(column.type):
        return column[k].values.to_numpy(zero_copy_only=False)
    whole = column[k].as_buffer()
    return np.frombuffer(pa.decompress(whole.slice(8), int(np.frombuffer(whole, np.int64, 1)[0]), "zstd"), kind)


def dictionary(counts: DataFrame) -> DataFrame:
    """``token, rank, df, idf`` of all tokens; rank 0 is the rarest (then the first by name)."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    each = counts.select(F.inline(F.arrays_zip("words", "dfs")))
    df = each.groupBy(F.col("words").alias("token")).agg(F.sum("dfs").alias("df"))
    return numbered(df.withColumn("idf", F.log(F.lit(total + 1.0) / (F.col("df") + 1)) + 1), ["df", "token"], "rank")


def classes(counts: DataFrame) -> DataFrame:
    """``id, class``: documents with equal vectors are one class, named by its smallest id, which is its ``head``; and where
    the document is, ``chunk, row``."""
    keyed = counts.select("chunk", F.posexplode(F.arrays_zip("ids", "k1", "k2")).alias("row", "d")).select("d.ids", "d.k1", "d.k2", "chunk", "row").withColumnRenamed("ids", "id")
    named = keyed.groupBy("k1", "k2").agg(F.min(F.struct("id", "chunk", "row")).alias("h"))
    head = (F.col("chunk") == F.col("h.chunk")) & (F.col("row") == F.col("h.row"))
    return written(keyed.join(named, ["k1", "k2"]).select("id", F.col("h.id").alias("class"), "chunk", "row", head.alias("head")), "classes")


def _packed(counts: DataFrame, members: DataFrame, known: DataFrame, most: tuple[int, int] | None = None) -> DataFrame:
    """``pack, ids, at, codes, tfs, ranks, idfs``: the heads of classes over the tokens of a dictionary, in rows of at most
    ``PACK`` documents and about ``TERMS`` tokens, or of ``most``. Documents lie with those whose weight reaches as far into common tokens:
    packs of the others have few meetings. A code is the place of a token among the pack's own, which rise from rare
    to common, as do those of a document; a document without such tokens is left out. All lists but the ids are squeezed.

    A chunk's words go to the dictionary once each, not once for each document, and come back as one row. Each pack is a
    file of its own, so that they are dealt to all tasks.
    """
    kind = counts.schema["ids"].dataType.elementType.simpleString()
    pack, tokens = most or (PACK, TERMS)
    each = counts.select("chunk", F.posexplode("words").alias("pos", "token")).join(known.select("token", "rank", "idf"), "token")
    told = each.repartition(counts.count() // TOLD + 1, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("pos", "rank", "idf")).alias("t"))
    told = told.select("chunk", *[F.col(f"t.{c}").alias(c) for c in ("pos", "rank", "idf")])
    heads = members.filter("head").groupBy("chunk").agg(F.collect_list("row").alias("rows"))
    both = counts.select("chunk", "ids", "at", "codes", "tfs").join(told, "chunk").join(heads, "chunk").select("ids", "at", "codes", "tfs", "pos", "rank", "idf", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = [([], [0, 0]) for _ in range(len(LEVELS) + 1)]  # documents of each level, and how many they and their tokens are

        def row(held: list[tuple]) -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in held])
            n, rank, idf, tf = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3, 4))
            ranks, first, codes = np.unique(rank, return_index=True, return_inverse=True)
            at = np.concatenate(([0], np.cumsum(n)))
            lists = [*[x.astype(np.int32) for x in (at, codes, tf)], ranks.astype(np.int64), idf[first].astype(np.float64)]
            named = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([named, *[pa.array([_squeezed(x)], pa.binary()) for x in lists]], ["ids", "at", "codes", "tfs", "ranks", "idfs"])

        for batch in batches:
            for k in range(batch.num_rows):
                ids, at, codes, tf, pos, rank, idf, rows = (batch.column(c)[k].values for c in range(8))
                at, codes, tf, pos, rank, idf, rows = (x.to_numpy(zero_copy_only=False) for x in (at, codes, tf, pos, rank, idf, rows))
                size = int(max(codes.max(initial=-1), pos.max(initial=-1))) + 1
                ranks, idfs = np.full(size, -1, np.int64), np.zeros(size)
                ranks[pos], idfs[pos] = rank, idf
                of = np.repeat(np.arange(len(ids)), np.diff(at))
                asked = np.zeros(len(ids), bool)
                asked[rows] = True
                use = asked[of] & (ranks[codes] >= 0)
                of, codes, tf = of[use], codes[use], tf[use]
                order = np.lexsort((ranks[codes], of))
                of, codes, tf = of[order], codes[order], tf[order]
                n = np.bincount(of, minlength=len(ids))
                some = np.flatnonzero(n)
                ids, n = ids.take(pa.array(some)), n[some]
                ends = np.cumsum(n)
                square = (tf * idfs[codes]) ** 2
                upto = np.concatenate(([0.0], np.cumsum(square)))
                left = np.repeat(upto[ends], n) - upto[:-1] >= LEFT * np.repeat(upto[ends] - upto[ends - n], n)
                last = ends - n + np.maximum(np.add.reduceat(left.astype(np.int64), ends - n), 1) - 1 if len(n) else ends
                level = np.searchsorted(LEVELS, idfs[codes[last]])
                for which, (held, size) in enumerate(levels):
                    mine = np.flatnonzero(level == which)
                    take = _taken(ends[mine] - n[mine], n[mine])
                    own, sizes, lists = ids.take(pa.array(mine)), n[mine], (ranks[codes[take]], idfs[codes[take]], tf[take])
                    at = 0
                    for j in range(len(mine)):
                        if size[0] and (size[0] >= pack or size[1] + sizes[j] > tokens):
                            if j > at:
                                held.append(_cut(own, sizes, *lists, at, j))
                            yield row(held)
                            held.clear()
                            size[:], at = [0, 0], j
                        size[0], size[1] = size[0] + 1, size[1] + int(sizes[j])
                    if len(mine) > at:
                        held.append(_cut(own, sizes, *lists, at, len(mine)))
        rest: tuple = [], [0, 0]
        for held, size in levels:  # what is left of several levels may fill one pack
            if rest[0] and (rest[1][0] + size[0] > pack // 4 or rest[1][1] + size[1] > tokens // 4):
                yield row(rest[0])
                rest = [], [0, 0]
            rest[0].extend(held)
            rest[1][:] = [x + y for x, y in zip(rest[1], size)]
        if rest[0]:
            yield row(rest[0])
        trim()

    few = both.coalesce(counts.sparkSession.sparkContext.defaultParallelism)
    made = few.mapInArrow(run, f"ids array<{kind}>, at binary, codes binary, tfs binary, ranks binary, idfs binary")
    return written(made.withColumn("pack", F.monotonically_increasing_id()), "packs", 1)


def _cut(ids: pa.Array, n: np.ndarray, ranks: np.ndarray, idfs: np.ndarray, tf: np.ndarray, first: int, to: int) -> tuple:
    """Documents ``first`` to ``to`` of a chunk, each with ``n`` tokens."""
    s, e = int(n[:first].sum()), int(n[:to].sum())
    return ids.slice(first, to - first), n[first:to], ranks[s:e], idfs[s:e], tf[s:e]


def index(docs: DataFrame, most: tuple[int, int] | None = None) -> Index:
    """The index of ``docs (id, title, text)``; terms are counted once."""
    counts = term_counts(docs)
    known, members = dictionary(counts), classes(counts)
    return Index(_packed(counts, members, known, most), members, known)


class _Side:
    """The unit vectors of a pack, and of each the part that a pair of ``floor`` at least must meet in.

    A document's tokens rise from rare to common. Its prefix ends where the rest is shorter than ``DEEPER`` of the floor: two
    vectors whose first common token is not in both prefixes have a lower cosine, as the rest of one times the whole other is
    less. ``order, starts`` are the postings of the prefixes by token, those with the longest ``left``, the rest from the
    token on, first; ``cut`` the last rank of a prefix, ``rest`` the length of what follows; ``rests`` the length of each
    document's tokens after each of the ranks ``bands``.
    """

    def __init__(self, batch: pa.RecordBatch, k: int, side: str, floor: float):
        self.ids = batch.column(f"{side}_ids")[k].values
        kinds = {"at": np.int32, "codes": np.int32, "tfs": np.int32, "ranks": np.int64, "idfs": np.float64}
        self.at, self.codes, tfs, self.ranks, idfs = (_list(batch.column(f"{side}_{c}"), k, kind) for c, kind in kinds.items())
        self.n, sizes = len(self.ids), np.diff(self.at)
        v = tfs * idfs[self.codes]
        self.v = v / np.repeat(np.sqrt(np.add.reduceat(v * v, self.at[:-1])), sizes)
        square = self.v * self.v
        upto = np.concatenate(([0.0], np.cumsum(square)))
        rest = np.sqrt(np.maximum(0, np.repeat(upto[self.at[1:]], sizes) - upto[:-1]))  # from the token on
        of = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        some = np.flatnonzero(rest >= DEEPER * floor - SLACK) if floor > 0 else np.arange(len(self.v))
        last = self.at[:-1] + np.bincount(of[some], minlength=self.n) - 1
        self.cut = self.ranks[self.codes[last]]
        self.rest = np.sqrt(np.maximum(0, rest[last] ** 2 - square[last]))
        self.low, places = len(self.v).bit_length(), len(self.ranks).bit_length()
        self.bits = min(16, 62 - self.low - places)  # of the rest in a key: code, how much is gone, place
        key = np.sort(((self.codes[some].astype(np.int64) << self.bits) + self._gone(rest[some]) << self.low) + some)
        order = key & (1 << self.low) - 1
        self.of, self.value = of[order], self.v[order]
        self.sizes = np.bincount(self.codes[order], minlength=len(self.ranks))
        self.starts = np.cumsum(self.sizes) - self.sizes
        if floor > 0:
            self.key, self.left = key >> self.low, rest[order]
            self.top = np.where(self.sizes > 0, self.left[np.minimum(self.starts, len(self.left) - 1)], 0)
            self.bands = np.unique(np.concatenate(([-1], np.quantile(self.cut, np.linspace(0, 1, BANDS), method="lower"))))
            band = np.searchsorted(self.bands, self.ranks)[self.codes]  # a token counts for the bands before its own
            parts = np.bincount(band * self.n + of, square, (len(self.bands) + 1) * self.n).reshape(-1, self.n)
            self.rests = np.sqrt(np.cumsum(parts[::-1], axis=0)[::-1][1:])

    def _gone(self, rest: np.ndarray) -> np.ndarray:
        """Rises as the rest shrinks."""
        return (np.clip(1 - rest, 0, 1) * ((1 << self.bits) - 1)).astype(np.int64)

    def upto(self, codes: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Where the postings of a token whose rest is ``least`` or more end."""
        return np.searchsorted(self.key, (codes << self.bits) + self._gone(least), "right")

    def whole(self) -> _Side:
        """The same with the postings of all tokens."""
        if len(self.of) == len(self.v):
            return self
        if not hasattr(self, "_whole"):
            made, order = copy.copy(self), np.argsort(self.codes, kind="stable")
            made.of, made.value = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.at))[order], self.v[order]
            made.sizes = np.bincount(self.codes, minlength=len(self.ranks))
            made.starts = np.cumsum(made.sizes) - made.sizes
            self._whole = made
        return self._whole

    def rows(self, first: int, to: int) -> _Side:
        """Some of the documents."""
        if first == 0 and to == self.n:
            return self
        made, own = copy.copy(self), slice(int(self.at[first]), int(self.at[to]))
        made.ids, made.n, made.at, made.codes, made.v = self.ids.slice(first, to - first), to - first, self.at[first : to + 1] - self.at[first], self.codes[own], self.v[own]
        made.cut, made.rest = self.cut[first:to], self.rest[first:to]
        made.__dict__.pop("_whole", None)
        keep = (self.of >= first) & (self.of < to)
        made.of, made.value = self.of[keep] - first, self.value[keep]
        made.sizes = np.bincount(np.repeat(np.arange(len(self.ranks)), self.sizes)[keep], minlength=len(self.ranks))
        made.starts = np.cumsum(made.sizes) - made.sizes
        if hasattr(self, "rests"):
            made.rests = self.rests[:, first:to]
        return made


def product(q: _Side, d: _Side, meetings: int) -> np.ndarray:
    """The score of each query of a pack with each document of another, by the postings of tokens that both packs have."""
    place = np.searchsorted(d.ranks, q.ranks)
    mine = np.flatnonzero(d.ranks[np.minimum(place, len(d.ranks) - 1)] == q.ranks)
    theirs = place[mine]
    meet = q.sizes[mine] * d.sizes[theirs]
    mine, theirs, meet = mine[meet > 0], theirs[meet > 0], meet[meet > 0]
    sums = np.zeros(q.n * d.n)
    heavy = np.flatnonzero(meet * WORTH > q.n * d.n)
    for at in range(0, len(heavy), COLUMNS):
        some = heavy[at : at + COLUMNS]
        sums += (_matrix(q, mine[some]).T @ _matrix(d, theirs[some])).ravel()
    light = np.flatnonzero(meet * WORTH <= q.n * d.n)
    mine, theirs = mine[light], theirs[light]
    own = _taken(d.starts[theirs], d.sizes[theirs])
    row, dv = d.of[own].astype(np.int64), d.value[own]
    first, n = np.repeat(q.starts[mine], d.sizes[theirs]), np.repeat(q.sizes[mine], d.sizes[theirs])
    of, before = q.of.astype(np.int64) * d.n, np.cumsum(n) - n
    cuts = [*np.searchsorted(before, np.arange(0, n.sum(), meetings)).tolist(), len(n)]
    for s, e in zip(cuts, cuts[1:]):
        take, m = _taken(first[s:e], n[s:e]), n[s:e]
        sums += np.bincount(of[take] + np.repeat(row[s:e], m), np.repeat(dv[s:e], m) * q.value[take], q.n * d.n)
    return sums.reshape(q.n, d.n)


def _product(q: _Side, d: _Side) -> np.ndarray:
    return product(q, d, MEETINGS)


def _taken(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of runs of ``n`` from ``first`` on."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _matrix(side: _Side, codes: np.ndarray) -> np.ndarray:
    take, made = _taken(side.starts[codes], side.sizes[codes]), np.zeros((len(codes), side.n))
    made[np.repeat(np.arange(len(codes)), side.sizes[codes]), side.of[take]] = side.value[take]
    return made


def _reaching(q: _Side, d: _Side, sums: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``i, j, score`` of the pairs with ``floor`` at least, from the sums over prefixes.

    These hold all common tokens up to the lesser of the two cuts. What follows is at most the product of the lengths of
    what both vectors have there; of the pairs left the score is taken over whole vectors.
    """
    i, j = np.nonzero(sums > (1 - DEEPER) * floor - SLACK)  # after the prefixes less than the other part is left
    near = np.searchsorted(d.bands, q.cut, "right") - 1, np.searchsorted(q.bands, d.cut, "right") - 1
    q_first = q.cut[i] <= d.cut[j]
    more = np.where(q_first, q.rest[i] * d.rests[near[0][i], j], d.rest[j] * q.rests[near[1][j], i])
    keep = sums[i, j] + more >= floor - SLACK
    return _exact(q, d, i[keep], j[keep], floor)


def _exact(q: _Side, d: _Side, i: np.ndarray, j: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``i, j, score`` of those pairs, in order of ``i``, whose score over whole vectors is ``floor`` at least."""
    if len(i) * FEW > q.n * d.n and q.n * d.n <= CELLS:
        score = product(q.whole(), d.whole(), MEETINGS)[i, j]
        return i[score >= floor], j[score >= floor], score[score >= floor]
    place = np.searchsorted(d.ranks, q.ranks)
    place[d.ranks[np.minimum(place, len(d.ranks) - 1)] != q.ranks] = len(d.ranks)
    score, whole = np.empty(len(i)), np.zeros(len(d.ranks) + 1)
    bounds = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1], [True]))) if len(i) else []
    for s, e in zip(bounds, bounds[1:]):
        own = slice(q.at[i[s]], q.at[i[s] + 1])
        where = place[q.codes[own]]
        whole[where] = q.v[own]
        whole[-1] = 0
        n = d.at[j[s:e] + 1] - d.at[j[s:e]]
        take = _taken(d.at[j[s:e]].astype(np.int64), n.astype(np.int64))
        score[s:e] = np.add.reduceat(whole[d.codes[take]] * d.v[take], np.cumsum(n) - n)
        whole[where] = 0
    keep = score >= floor
    return i[keep], j[keep], score[keep]


def _near(q: _Side, d: _Side, floor: float, own_pack: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``i, j, score`` of the pairs with ``floor`` at least; of a pack with itself only those with ``i > j`` are sure to be there.

    Postings of a token meet as long as the rests of the two vectors multiply to ``DEEPER`` of the floor; the rests shrink
    along the tokens, so what a pair has in common after its last meeting adds less than that, and pairs whose meetings do
    not make up for the other part end here. Where pairs meet often, all of them are added up in tables.
    """
    least = DEEPER * floor
    place = np.searchsorted(d.ranks, q.ranks)
    mine = np.flatnonzero(d.ranks[np.minimum(place, len(d.ranks) - 1)] == q.ranks)
    mine = mine[q.top[mine] * d.top[place[mine]] >= least - SLACK]
    own = _taken(q.starts[mine], q.sizes[mine])
    code = np.repeat(place[mine], q.sizes[mine])
    keep = q.left[own] * d.top[code] >= least - SLACK
    own, code = own[keep], code[keep]
    first = d.starts[code]
    n = d.upto(code, (least - SLACK) / q.left[own]) - first
    meetings = int(n.sum())
    if meetings > MANY * q.n * d.n:
        found = [(at, _reaching(part, d, _product(part, d), floor)) for at, part in _slices(q, d.n)]
        return tuple(np.concatenate([x[k] + at * (k == 0) for at, x in found]) for k in range(3))
    of = q.of[own]
    per = np.bincount(of, n, q.n).cumsum()
    block = per.astype(np.int64) // NEAR
    table = meetings > SORTED * q.n * d.n
    if table:
        block = np.maximum.accumulate(block + np.arange(q.n) // max(1, TABLE // d.n))
    if q.n and block[-1] > block[0]:  # a document's meetings stay together
        order = np.argsort(of.astype(np.uint16) if q.n < 1 << 16 else of, kind="stable")
        own, first, n, of = own[order], first[order], n[order], of[order]
    rows = np.flatnonzero(np.diff(block, prepend=-1, append=np.iinfo(np.int64).max)) if q.n else np.zeros(1, int)
    bounds = np.searchsorted(of, rows) if len(rows) > 2 else np.array([0, len(of)])
    least = floor - least - SLACK
    i, j = [], []
    for k, (s, e) in enumerate(zip(bounds, bounds[1:])):
        m = n[s:e]
        take = _taken(first[s:e], m)
        pair = np.repeat((of[s:e] - rows[k]).astype(np.int64) * d.n, m) + d.of[take]
        part = np.repeat(q.value[own[s:e]], m) * d.value[take]
        if table:
            pair = np.flatnonzero(np.bincount(pair, part) >= least)
        elif len(pair):
            met = np.sort((pair << 24) + (part * (1 << 22)).astype(np.int64) + 1)  # a pair, and its product rounded up
            pair = met >> 24
            starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            pair = pair[starts[np.add.reduceat(met & (1 << 24) - 1, starts) >= least * (1 << 22)]]
        i.append(pair // d.n + rows[k])
        j.append(pair % d.n)
    i, j = np.concatenate(i), np.concatenate(j)
    return _exact(q, d, i[i > j], j[i > j], floor) if own_pack else _exact(q, d, i, j, floor)


def _slices(q: _Side, width: int) -> Iterator[tuple[int, _Side]]:
    """The documents of a pack, as many at a time as may meet ``width`` others."""
    step = max(1, CELLS // width)
    for at in range(0, q.n, step):
        yield at, q.rows(at, min(q.n, at + step))


def _all(q: _Side, d: _Side, k: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``before, i, j, score`` of the pairs above zero, with ``k`` those that may be among a query's best; ``before`` queries
    come before the first ``i``."""
    for at, part in _slices(q, d.n):
        sums = _product(part, d)
        least = np.partition(sums, d.n - k, axis=1)[:, [d.n - k]] - 2 * ROUNDING if k is not None and d.n > k else 0.0
        i, j = np.nonzero((sums > 0) & (sums >= least))
        yield at, i, j, sums[i, j]


def _best(i: np.ndarray, j: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which pairs may be among the ``k`` best of their query, whatever rounding does; of equal scores ``k`` stay."""
    order = np.lexsort((ids[j], -score, i))
    i, score = i[order], score[order]
    starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
    size = np.diff(np.concatenate((starts, [len(i)])))
    kth = np.repeat(np.where(size >= k, score[np.minimum(starts + k, starts + size) - 1], -1.0), size)
    runs = np.concatenate(([True], (i[1:] != i[:-1]) | (score[1:] != score[:-1])))
    nth = np.arange(len(i)) - np.flatnonzero(runs)[np.cumsum(runs) - 1]
    return order[(score >= kth - 2 * ROUNDING) & (nth < k)]


def scored(q: DataFrame, d: DataFrame, floor: float, k: int | None = None, same: bool = False) -> DataFrame:
    """``query_id, id, score`` of all pairs of packed vectors with a cosine above zero and of ``floor`` at least, not rounded;
    with ``k`` only those that may be among a query's best. With ``same``, the two are one table, and ``id < query_id``.

    Every pack of queries meets every pack of documents in a cross join; pairs that fall short end in the task, so what is
    written and shuffled grows with the vectors and the result, not with the pairs that had to be looked at.
    """
    ship(q.sparkSession)
    left, right = (x.select(*[F.col(c).alias(f"{side}_{c}") for c in x.columns]) for x, side in ((q, "q"), (d, "d")))
    both = left.join(right, F.col("q_pack") >= F.col("d_pack")) if same else left.crossJoin(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[int, _Side]] = {"q": {}, "d": {}}

        def side(batch: pa.RecordBatch, at: int, name: str) -> _Side:
            number, have = batch.column(f"{name}_pack")[at].as_py(), kept[name]
            if number in have:
                return have[number]
            if name == "q":
                have.clear()  # it meets all others of the task first
            made = _Side(batch, at, name, floor)
            if name == "q" or sum(len(x.v) for x in have.values()) + len(made.v) <= KEPT:  # they come round in the same order
                have[number] = made
            return made

        for batch in batches:
            for at in range(batch.num_rows):
                a, b = side(batch, at, "q"), side(batch, at, "d")
                names = [s.ids.to_numpy(zero_copy_only=False) for s in (a, b)]
                twice = same and batch.column("q_pack")[at] == batch.column("d_pack")[at]
                for before, i, j, score in [(0, *_near(a, b, floor, twice))] if floor > 0 else _all(a, b, k):
                    if k is not None and len(i):
                        keep = _best(i, j, score, names[1], k)
                        i, j, score = i[keep], j[keep], score[keep]
                    i = i + before
                    x, y = names[0][i], names[1][j]
                    if same:
                        if twice:
                            x, y, score = x[i > j], y[i > j], score[i > j]
                        x, y = np.maximum(x, y), np.minimum(x, y)
                    yield pa.RecordBatch.from_arrays([pa.array(x, a.ids.type), pa.array(y, b.ids.type), pa.array(score)], ["query_id", "id", "score"])
        trim()

    kinds = [x.schema["ids"].dataType.elementType.simpleString() for x in (q, d)]
    columns = [f"{side}_{c}" for side in "qd" for c in ("pack", "ids", "at", "codes", "tfs", "ranks", "idfs")]
    return both.select(*columns).mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def search(queries: DataFrame, docs: DataFrame, k: int | None = None, floor: float = 0.0) -> DataFrame:
    """``query_id, id, score``: the ``k`` most similar documents of each query ``(id, title, text)`` by cosine, or all with
    ``floor`` at least.

    Tokens that no document has are ignored; the floor is for the exact score; scores are rounded to six digits before
    ties go to the smaller id. Null and empty texts find nothing and are not found. Equal texts are scored once.
    """
    most = None if floor > 0 else SCORED
    made = index(docs, most)
    counts, members = term_counts(queries), made.members.select("id", "class")
    askers = classes(counts)
    found = scored(_packed(counts, askers, made.dictionary, most), made.packs, floor, k).withColumn("score", F.round("score", 6))
    first = F.row_number().over(Window.partitionBy("class").orderBy("id"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    if k is not None:
        members = members.withColumn("nth", first).filter(F.col("nth") <= k).drop("nth")
        found = found.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth")  # each task sends its best
    found = found.withColumnRenamed("id", "class").join(members, "class").select("query_id", "id", "score")
    if k is not None:
        found = found.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth")
    return found.join(askers.select(F.col("class").alias("query_id"), F.col("id").alias("asker")), "query_id").select(F.col("asker").alias("query_id"), "id", "score")


def similarity_join(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Documents ``(id, title, text)`` whose cosine is ``threshold`` or more, without making pairs of equal ones.

    Gives ``id, class`` of every document with a token, and ``a, b, score`` with ``b < a`` for classes by their smallest
    ids; members of one class have the cosine 1. Null and empty texts are in no class.
    """
    made = index(docs)
    found = scored(made.packs, made.packs, threshold, same=True)
    return made.members.select("id", "class"), found.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round("score", 6).alias("score"))
