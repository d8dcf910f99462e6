"""Byte-pair encoding over a distinct-word table, and decoding through an id-to-piece table."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitetide.session import bucketed, ship, table, trim

VOCABULARY = "word_bpe_49k.json"
#: Bytes of text of a chunk, which has a dictionary of its own words, and of the corpus for each part of the word table.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: Bytes of text taken at a time inside a batch, and words kept by a task from one such piece to the next.
PIECE_BYTES = 4 << 20
CACHE_WORDS = 1 << 20
_MARKS = ".,;:!?"
MARKS = len(_MARKS) + 1
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SIMPLE = f"^[{_LATIN}]+[{_MARKS}]?$"
_PLAIN = re.compile(f"[{_LATIN}]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer with truncation and padding off; special tokens that stand in a text stay single ids."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each task has a core of its own
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space of all texts, and where each text's words begin (one bound more than texts).

    The tokenizer's own rules never join characters across white space, so a text's ids are its words' ids in turn.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    return lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def pieces(batch: pa.RecordBatch, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``size`` bytes of text (column 1)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        limit = (ends[at - 1] if at else 0) + size
        to = max(at + 1, int(np.searchsorted(ends, limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def parts_of(chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The key of each distinct word and its closing mark (0: none).

    A word of Latin letters with at most one closing mark is keyed by its lower-cased letters, which the tokenizer
    always takes apart from the mark; any other word is its own key.
    """
    simple = pc.match_substring_regex(chunks, _SIMPLE)
    bare = pc.utf8_lower(pc.utf8_rtrim(chunks, _MARKS))
    last = pc.index_in(pc.utf8_slice_codeunits(chunks, -1, 1 << 30), value_set=pa.array(list(_MARKS))).fill_null(-1)
    marks = np.where(simple.to_numpy(zero_copy_only=False), last.to_numpy(zero_copy_only=False) + 1, 0)
    return pc.if_else(simple, bare, chunks), marks


def spread(starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the items of runs ``codes`` in turn, and where each run begins (one bound more)."""
    n = sizes[codes]
    ends = np.concatenate(([0], np.cumsum(n)))
    return np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], n), ends


@functools.lru_cache(maxsize=2)
def closing_pieces(path: str) -> np.ndarray:
    """Which ids end a unit."""
    model = load(path)
    return np.array([(model.id_to_token(k) or "").endswith("</w>") for k in range(model.get_vocab_size(with_added_tokens=True))])


class Words:
    """Ids of distinct words, remembered within a bound, for those who see words in turn."""

    made: ClassVar[dict[str, Words]] = {}

    @classmethod
    def of(cls, path: str) -> Words:
        """That of this process, which knows the words of the tasks before; at most ``CACHE_WORDS`` of them."""
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __init__(self, path: str):
        self.model, self.closing = load(path), closing_pieces(path)
        marks = [e.ids for e in self.model.encode_batch_fast(list(_MARKS), add_special_tokens=False)]
        self.mark_sizes = np.array([0] + [len(x) for x in marks])
        self.mark_flat = np.array([y for x in marks for y in x], np.int32)
        self.forget()

    def forget(self) -> None:
        self.met, self.flat, self.sizes = {}, [np.empty(0, np.int32)], [np.empty(0, np.int64)]

    def learn(self, keys: list[str]) -> None:
        """Encode words not met so far; plain ones together, as each ends with exactly one closing piece."""
        plain = [w for w in keys if w.isalpha() and _PLAIN.fullmatch(w)]
        for at in range(0, len(plain), 2000):
            group = plain[at : at + 2000]
            ids = np.array(self.model.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(group):
                raise ValueError("a plain word was not one unit")
            self._add(group, ids, np.diff(ends, prepend=0))
        done = set(plain)
        other = [w for w in keys if w not in done]
        for at in range(0, len(other), 2000):
            group = other[at : at + 2000]
            each = [e.ids for e in self.model.encode_batch_fast(group, add_special_tokens=False)]
            self._add(group, np.array([y for x in each for y in x], np.int32), np.array([len(x) for x in each], np.int64))

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.met.update(zip(words, range(len(self.met), len(self.met) + len(words)), strict=True))
        self.flat.append(ids)
        self.sizes.append(sizes)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        coded, bounds, keys = coded_texts(texts)
        distinct = keys.to_pylist()
        new = [w for w in distinct if w not in self.met]
        if len(self.met) + len(new) > CACHE_WORDS:
            self.forget()
            new = distinct
        self.learn(new)
        self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        at = np.fromiter((self.met[w] for w in distinct), np.int64, len(distinct))
        starts = np.cumsum(self.sizes[0]) - self.sizes[0]
        take, _ = spread(starts, self.sizes[0], at)
        return self.joined(coded, bounds, self.flat[0][take], self.sizes[0][at])

    def joined(self, coded: np.ndarray, bounds: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        """Ids of texts from their coded words and the ids (``flat`` in runs of ``sizes``) of the keys."""
        known = len(sizes)
        flat, sizes = np.concatenate((flat, self.mark_flat)), np.concatenate((sizes, self.mark_sizes))
        number = np.zeros(int(coded.max(initial=-1)) + 1, np.int32)
        number[coded] = 1
        words = np.flatnonzero(number)
        number[words] = np.arange(len(words), dtype=np.int32)
        back = number[coded]
        take, ends = spread(np.cumsum(sizes) - sizes, sizes, np.column_stack((words // MARKS, known + words % MARKS)).ravel())
        flat, first = flat[take], ends[::2]  # ids of each distinct word with its mark
        take, ends = spread(first[:-1], np.diff(first), back)
        return pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), pa.array(flat[take]))


def coded_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The code (number of its key, times ``MARKS``, plus its mark) of each word of all texts, where each text's words
    begin, and the keys; frequent keys have small numbers."""
    words, bounds = split_words(texts)
    coded = words.dictionary_encode()
    keys, marks = parts_of(coded.dictionary)
    coded_keys = keys.dictionary_encode()
    of, index = coded_keys.indices.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
    count = np.bincount(of[index], minlength=len(coded_keys.dictionary)) if len(index) else np.zeros(0, np.int64)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    each = (rank[of] * MARKS + marks if len(of) else np.empty(0)).astype(np.int32)
    return each[index], bounds, coded_keys.dictionary.take(pa.array(order))


class Pieces:
    """The fixed id-to-piece table of a tokenizer without a decoder: pieces are joined by one space."""

    made: ClassVar[dict[str, Pieces]] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        """The table of this process."""
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __init__(self, path: str):
        model = load(path)
        size = model.get_vocab_size(with_added_tokens=True)
        self.table = pa.array([(model.id_to_token(k) or "") + " " for k in range(size)], pa.binary())

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        flat = self.table.take(ids.flatten())
        _, offsets, data = flat.buffers()
        bounds = np.frombuffer(offsets, np.int32)[flat.offset : flat.offset + len(flat) + 1]
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
        raw = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(raw[bounds[s] : bounds[e] - 1]) if e > s else b"" for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def word_table(docs: DataFrame) -> DataFrame:
    """``word, n``: every distinct word key of the corpus and how often it occurs."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 4 * PIECE_BYTES):
                counts = split_words(piece.column(1))[0].value_counts()
                words = pa.table({"word": parts_of(counts.field("values"))[0], "n": counts.field("counts")})
                yield from words.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches()

    found = docs.select(F.lit(0), "text").mapInArrow(distinct, "word string, n long")
    return found.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def chunks(docs: DataFrame, keep: list[str], buckets: int, places: int, size: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of documents coded by their own words, written to the shared folder in ``places`` buckets: rows of two kinds.

    A document (``bucket`` -1): ``chunk``, its place, the columns ``keep`` and its words' codes. A part of the chunk's
    dictionary: ``chunk, bucket`` and the keys that belong to this part of the word table, with their numbers.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in keep], "text")
    own = [T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(keep)]
    schema = T.StructType([*_fields(("chunk", T.LongType()), ("bucket", T.IntegerType()), ("data", T.BinaryType())), *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, weight = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            texts = rows.column(len(keep)).chunk(0)
            codes, bounds, keys = coded_texts(texts)
            planes = [_planes(codes[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            names = ["chunk", "bucket", "data", *[f"c{k}" for k in range(len(keep))]]
            n = rows.num_rows
            for at in range(0, n, 1024):
                part = min(1024, n - at)
                columns = [rows.column(k).chunk(0).slice(at, part) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([pa.array([number] * part), pa.array([-1] * part, pa.int32()), pa.array(planes[at : at + part], pa.binary()), *columns], names)
            to = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in keys.to_pylist()), np.int64, len(keys))
            order = np.argsort(to, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
                words = "\n".join(keys.take(pa.array(group)).to_pylist()).encode("utf-8", "surrogatepass")
                data = _blob(_planes(np.diff(group, prepend=0)), zstandard.compress(words, 3))
                columns = [pa.nulls(1, rows.schema.field(k).type) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(to[group[0]])], pa.int32()), pa.array([data], pa.binary()), *columns], names)

        for batch in batches:
            for piece in pieces(pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(len(keep)), *batch.columns[:-1]], ["", "text", *keep])):
                held.append(pa.RecordBatch.from_arrays([*piece.columns[2:], piece.column(1)], [*[f"k{k}" for k in range(len(keep))], "text"]))
                weight += piece.column(1).nbytes
                if weight >= size:
                    yield from flush()
                    number, held, weight = number + 1, [], 0
        if held:
            yield from flush()
        trim()

    return bucketed(docs.mapInArrow(run, schema), "chunks", "chunk", places)


def _fields(*named) -> list[T.StructField]:
    return [T.StructField(*x) for x in named]


def _planes(codes: np.ndarray) -> bytes:
    """Numbers as their low bytes, then the next ones, and so on, compressed."""
    raw = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.compress(raw, 1)


def _codes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)


def _blob(*parts: bytes) -> bytes:
    return b"".join(x for part in parts for x in (len(part).to_bytes(4, "little"), part))


def _parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def encoded_words(dictionaries: DataFrame, path: str) -> DataFrame:
    """``chunk, bucket, data``: the ids of each dictionary's words. A word belongs to one bucket of the word table, where
    it is encoded once for all chunks."""

    def run(table_: pa.Table) -> pa.Table:
        parts = [_parts(x.as_py()) for x in table_.column("data")]
        words = [zstandard.decompress(w).decode("utf-8", "surrogatepass").split("\n") for _, w in parts]
        coder = Words(path)
        coder.learn(list(dict.fromkeys(w for part in words for w in part)))
        flat, sizes = np.concatenate(coder.flat), np.concatenate(coder.sizes)
        starts, out = np.cumsum(sizes) - sizes, []
        for (numbers, _), own in zip(parts, words, strict=True):
            at = np.fromiter((coder.met[w] for w in own), np.int64, len(own))
            out.append(_blob(numbers, _planes(sizes[at]), _planes(flat[spread(starts, sizes, at)[0]])))
        trim()
        return pa.table({"chunk": table_.column("chunk"), "bucket": table_.column("bucket"), "data": pa.array(out, pa.binary())})

    return dictionaries.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, data binary")


def with_ids(docs: DataFrame, keep: list[str], path: str, finish, schema: T.StructType, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Rows of ``finish(columns of keep, ids of the texts)`` for all of ``docs``: ids joined back to the words' places."""
    ship(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = chunks(docs, keep, max(4, -(-size // BUCKET_BYTES)), max(4, min(-(-size // CHUNK_BYTES), 50_000)), chunk)
    told = encoded_words(packed.filter("bucket >= 0").select("chunk", "bucket", "data"), path)

    def restore(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [_parts(x.as_py()) for x in right.column("data")]
        none = np.empty(0, np.int64)
        number = np.concatenate([none, *[np.cumsum(_codes(n)) for n, _, _ in parts]])
        sizes = np.concatenate([none, *[_codes(x) for _, x, _ in parts]])
        flat = np.concatenate([none, *[_codes(x) for _, _, x in parts]]).astype(np.int32)
        order = np.argsort(number)
        take, _ = spread(np.cumsum(sizes) - sizes, sizes, order)
        words, flat, sizes, out = Words(path), flat[take], sizes[order], []
        data = left.column("data")
        for at in range(0, len(data), 512):
            some = [_codes(x.as_py()) for x in data.slice(at, 512)]
            bounds = np.concatenate(([0], np.cumsum([len(c) for c in some])))
            ids = words.joined(np.concatenate(some), bounds, flat, sizes)
            out.append(finish([left.column(f"c{k}").slice(at, 512).combine_chunks() for k in range(len(keep))], ids))
        trim()
        return pa.concat_tables(out)

    rows = packed.filter("bucket < 0").drop("bucket")
    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(restore, schema)


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with ``ids``: the tokenizer's ids of each whole text (null or empty text: none), without added tokens.

    Words are split where the texts are read, each chunk of documents with a dictionary of its own. Every distinct word
    belongs to one part of the word table and is encoded once there; its ids go back to the chunks that hold it and are
    joined to its places. Long texts are whole; null ids, ties and repeated rows are kept; an empty table gives none.
    Further columns pass through, but a column ``ids`` is replaced.
    """
    docs = docs.drop("ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    names = schema.names

    def finish(columns: list[pa.Array], ids: pa.ListArray) -> pa.Table:
        return pa.table([*columns, ids], names=names)

    if "text" not in docs.columns:
        raise ValueError("a column text is needed")
    return with_ids(docs, docs.columns, path or vocabulary_path(), finish, schema, chunk)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``coded`` with ``decoded``: the tokenizer's fixed id-to-piece table is joined to each id where the row is.

    The table has as many rows as the vocabulary and is at hand in every task, so the join is a lookup by id and nothing
    is shuffled. This tokenizer has no decoder of its own, so pieces are joined by one space, special tokens included.
    Null or empty ids give an empty text. A column ``decoded`` is replaced.
    """
    ship(coded.sparkSession)
    path = path or vocabulary_path()

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table_ = Pieces(path)
        for ids in batches:
            yield pa.array(table_.decode(ids), pa.binary()).cast(pa.string())

    return coded.withColumn("decoded", text(F.col("ids")))


def digests(docs: DataFrame, path: str | None = None, names: list[str] | None = None, with_list: bool = False, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The columns ``names`` (``doc_id``), then ``n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``, by
    encoding and decoding each text; null ids, repeated rows and odd texts are treated as by ``encode``."""
    path, names = path or vocabulary_path(), names or ["doc_id"]
    more = _fields(("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), *([("ids", T.ArrayType(T.IntegerType()))] if with_list else []))
    schema = T.StructType([*docs.select(*names).schema.fields, *more])
    columns_ = schema.names

    def finish(columns: list[pa.Array], ids: pa.ListArray) -> pa.Table:
        bounds, flat = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<u4")).cast("B")
        sums = [hashlib.sha256(flat[4 * s : 4 * e]).hexdigest() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        texts = [hashlib.sha256(x).hexdigest() for x in Pieces.of(path).decode(ids)]
        made = [pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.string()), pa.array(texts, pa.string())]
        return pa.table([*columns, *made, *([ids] if with_list else [])], names=columns_)

    return with_ids(docs, names, path, finish, schema, chunk)


def op5_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
