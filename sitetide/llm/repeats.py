"""Shared frame of the two substring operators: find repeated windows of a fixed length over all documents.

Documents are packed into blocks of some megabytes. Every window of ``length`` symbols picks one of its inner stretches
of ``anchor`` symbols by the smallest hash, so equal windows pick the same anchor wherever they stand; consecutive
windows with one anchor form a run. Blocks send each distinct anchor once, anchors that occur elsewhere too come back,
and only runs of those are sent on, each distinct text of a block once, to the shard of the anchor. There an index over
the runs' texts (the operator's own method) decides which windows occur earlier, and a bit for each window returns.
A hot anchor's windows are sent one by one to shards by their own content, so a phrase that a third of all documents
hold costs each block one row and no shard more than its share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitetide.session import ship, trim, written

BLOCK_BYTES = 4 << 20
#: Text bytes of the whole corpus for each bucket of anchors and for each shard of runs.
BUCKET_BYTES = 16 << 20
SHARD_BYTES = 8 << 20
#: An anchor that occurs more often is hot.
HOT = 2048
#: Stands for a null id: such a row is later than all others.
NO_ID = np.iinfo(np.int64).max
#: Of equal hashes the leftmost place counts, so a place takes the lower bits; no block has a trillion symbols.
_POSITION = np.uint64((1 << 40) - 1)


@dataclass(frozen=True)
class Kind:
    """What is cut into windows: ``words`` or bytes, their ``length``, the ``anchor``, and whether an earlier place in the
    same document counts."""

    words: bool
    length: int
    anchor: int
    within: bool


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15


def stretch_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each stretch of ``n`` symbols, by doubling."""
    out, done, power, width = None, 0, h, 1
    size = len(h) - n + 1
    while n >> (width.bit_length() - 1):
        if n & width:
            factor = np.uint64(pow(_BASE, width, 1 << 64))
            piece = power[done : done + size]
            out = piece if out is None else out * factor + piece
            done += width
        if 2 * width <= n:
            power = power[: len(power) - width] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width:]
        width *= 2
    return mix(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size, width = len(x) - n + 1, 1
    while 2 * width <= n:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[:size], x[n - width : n - width + size])


class Block:
    """The symbols of some documents in ascending order of their ids, and the runs of windows with one anchor."""

    def __init__(self, payload: bytes, kind: Kind):
        table = pa.ipc.open_stream(payload).read_all()
        self.kind, self.ids = kind, table.column("doc_id")
        order = pc.fill_null(self.ids, int(NO_ID)).to_numpy()
        at = np.argsort(order, kind="stable")
        table, self.rank = table.take(pa.array(at)), order[at]
        self.ids = table.column("doc_id").combine_chunks()
        texts = pc.fill_null(table.column("text"), b"").combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.binary())
        if kind.words:
            self._words(texts)
        else:
            ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            self.bounds = ends - ends[0]
            self.begin = self.end = None
            self.hash = mix(np.arange(1, 257, dtype=np.uint64))[self.data]

    def _words(self, texts: pa.Array) -> None:
        import xxhash

        lists = pc.ascii_split_whitespace(texts.cast(pa.string(), safe=False))
        words, first = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        first = first - first[0]
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        keep = sizes > 0
        self.bounds = np.concatenate(([0], np.cumsum(keep)))[first]
        words, sizes = words.filter(pa.array(keep)), sizes[keep]
        coded = words.dictionary_encode()
        distinct = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        self.hash = distinct[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
        raw = raw[offsets[0] : offsets[-1]]
        self.data = np.full(len(raw) + len(words), 32, np.uint8)  # each word and a blank
        self.data[np.arange(len(raw)) + np.repeat(np.arange(len(words)), sizes)] = raw
        self.begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        self.end = self.begin + sizes

    def runs(self) -> tuple[np.ndarray, ...]:
        """``start, count, key, doc`` of each run: its first window, its windows, its anchor's hash, its document."""
        n, w, k = len(self.hash), self.kind.length, self.kind.anchor
        sizes = np.maximum(0, np.diff(self.bounds) - w + 1)
        total = int(sizes.sum())
        if not total:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
        starts = np.arange(total) + np.repeat(self.bounds[:-1] - (np.cumsum(sizes) - sizes), sizes)
        keys = stretch_hash(self.hash, k)
        packed = (mix(keys) & ~_POSITION) | np.arange(n - k + 1, dtype=np.uint64)
        chosen = (sliding_min(packed, w - k + 1)[starts] & _POSITION).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(chosen)) + 1))
        doc = np.searchsorted(self.bounds, starts[first], "right") - 1
        return starts[first], np.diff(np.append(first, total)), keys[chosen[first]], doc

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors and how many documents (places, where those count) hold them."""
        _, _, key, doc = self.runs()
        if self.kind.within:
            return np.unique(key, return_counts=True)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        return np.unique(key[new], return_counts=True)

    def units(self, keys: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """``start, count, route, doc`` of what is compared: runs with these anchors, hot ones cut into windows."""
        start, count, key, doc = self.runs()
        at = np.searchsorted(keys, key) if len(keys) else np.zeros(len(key), np.int64)
        known = (keys[np.minimum(at, len(keys) - 1)] == key) if len(keys) else np.zeros(len(key), bool)
        start, count, key, doc, is_hot = start[known], count[known], key[known], doc[known], hot[at[known]] if len(keys) else np.empty(0, bool)
        if is_hot.any():
            n = np.where(is_hot, count, 1)
            again = np.repeat(np.arange(len(start)), n)
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            whole = stretch_hash(self.hash, self.kind.length)
            start = start[again] + step
            key = np.where(is_hot[again], whole[np.minimum(start, len(whole) - 1)], key[again])
            count, doc = np.where(is_hot[again], 1, count[again]), doc[again]
        return start, count, key, doc

    def contents(self, start: np.ndarray, count: np.ndarray) -> list[bytes]:
        last = start + count + self.kind.length - 1
        a, b = (start, last) if self.begin is None else (self.begin[start], self.end[last - 1])
        raw = self.data.tobytes()
        return [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]

    def distinct(self, keys: np.ndarray, hot: np.ndarray, shards: int):
        """All units, for each the number of the first one with its text, those first ones by shard, and their texts."""
        start, count, route, doc = self.units(keys, hot)
        texts = self.contents(start, count)
        seen: dict[bytes, int] = {}
        first = np.array([seen.setdefault(t, k) for k, t in enumerate(texts)], np.int64)
        own = np.flatnonzero(first == np.arange(len(first)))
        shard = (route[own] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return (start, count, route, doc), first, own[order], shard[order], texts


def pack(**arrays) -> bytes:
    """Named arrays (or one of bytes) as compressed Arrow."""
    batch = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays.values()], list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(raw: bytes) -> dict[str, pa.Array]:
    table = pa.ipc.open_stream(raw).read_all().combine_chunks()
    return {name: (table.column(name).chunk(0) if table.column(name).num_chunks else pa.array([], table.schema.field(name).type)) for name in table.column_names}


def blocks(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """``block, bytes, payload``: the rows packed where they are read, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, weight = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            raw = pack(doc_id=table.column(0).chunk(0), text=table.column(1).chunk(0))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([weight]), pa.array([raw], pa.binary())], ["block", "bytes", "payload"])

        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1)], ["doc_id", "text"])
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + size - weight, "right")))
                held.append(batch.slice(at, to - at))
                weight += int(ends[to - 1] - before)
                at = to
                if weight >= size or at < batch.num_rows:
                    yield flush()
                    number, held, weight = number + 1, [], 0
        if held:
            yield flush()

    packed = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "block long, bytes long, payload binary")
    return written(packed, "blocks")


def earlier_windows(
    docs: DataFrame,
    kind: Kind,
    index: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, Kind], list[np.ndarray]],
    finish: Callable[[Block, np.ndarray], dict],
    schema: str,
) -> DataFrame:
    """Rows of ``finish(block, starts of windows that occur earlier)`` for all blocks.

    ``index`` gets distinct texts of one shard with routes, documents and places of their first occurrence and says for
    each text which of its windows occur earlier than there.
    """
    ship(docs.sparkSession)
    packed = blocks(docs)
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    buckets, shards = max(4, total // BUCKET_BYTES), max(4, total // SHARD_BYTES)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, counts = Block(payload.as_py(), kind).anchors()
                to = (keys % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order])) + 1
                groups = np.split(order, cuts) if len(order) else []
                raw = [keys[g].tobytes() + np.minimum(counts[g], 65535).astype("<u2").tobytes() for g in groups]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(to[g[0]]) for g in groups], pa.int32()), pa.array([number] * len(groups), pa.int64()), pa.array(raw, pa.binary())],
                    ["bucket", "block", "data"],
                )

    def repeated(table: pa.Table) -> pa.Table:
        raws = [x.as_py() for x in table.column("data")]
        sizes = [len(r) // 10 for r in raws]
        keys = np.concatenate([np.frombuffer(r, np.uint64, n) for r, n in zip(raws, sizes, strict=True)])
        counts = np.concatenate([np.frombuffer(r, "<u2", n, 8 * n) for r, n in zip(raws, sizes, strict=True)]).astype(np.int64)
        _, inverse = np.unique(keys, return_inverse=True)
        sums = np.bincount(inverse, weights=counts)[inverse]
        out_blocks, out, at = [], [], 0
        for number, n in zip(table.column("block").to_pylist(), sizes, strict=True):
            k, s = keys[at : at + n], sums[at : at + n]
            at += n
            if (s > 1).any():
                out_blocks.append(number)
                out.append(k[s > 1].tobytes() + (s[s > 1] > HOT).tobytes())
        return pa.table({"block": pa.array(out_blocks, pa.int64()), "data": pa.array(out, pa.binary())})

    def wanted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        raws = [x.as_py() for x in table.column("data")]
        if not raws:
            return np.empty(0, np.uint64), np.empty(0, bool)
        keys = np.concatenate([np.frombuffer(r, np.uint64, len(r) // 9) for r in raws])
        hot = np.concatenate([np.frombuffer(r, np.bool_, len(r) // 9, 8 * (len(r) // 9)) for r in raws])
        order = np.argsort(keys)
        return keys[order], hot[order]

    def send_units(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, hot = wanted(right)
        numbers, to, out = [], [], []
        for number, payload in zip(left.column("block").to_pylist(), left.column("payload"), strict=True):
            block = Block(payload.as_py(), kind)
            (start, count, route, doc), _, own, shard, texts = block.distinct(keys, hot, shards)
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for g in np.split(np.arange(len(own)), cuts) if len(own) else []:
                u = own[g]
                u = u[np.argsort(route[u], kind="stable")]
                numbers.append(number)
                to.append(int(shard[g[0]]))
                place = start[u] - block.bounds[doc[u]]
                out.append(pack(text=pa.array([texts[k] for k in u.tolist()], pa.binary()), count=count[u], route=route[u], doc=block.rank[doc[u]], place=place))
        trim()
        return pa.table({"shard": pa.array(to, pa.int32()), "block": pa.array(numbers, pa.int64()), "data": pa.array(out, pa.binary())})

    def decide(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in table.column("data")]
        number: dict[bytes, int] = {}
        ids = [np.array([number.setdefault(t, len(number)) for t in p["text"].to_pylist()], np.int64) for p in parts]
        flat = np.concatenate(ids)
        doc, place, route, count = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("doc", "place", "route", "count"))
        order = np.lexsort((place, doc, flat))
        lead = order[np.concatenate(([True], flat[order][1:] != flat[order][:-1]))]  # earliest of each text, by number
        bits = index(list(number), route[lead], doc[lead], place[lead], kind)
        later = doc > doc[lead][flat]
        if kind.within:
            later |= (doc == doc[lead][flat]) & (place > place[lead][flat])
        out, at = [], 0
        for i in ids:
            own = [np.ones(int(c), bool) if late else bits[k] for k, c, late in zip(i.tolist(), count[at : at + len(i)].tolist(), later[at : at + len(i)].tolist(), strict=True)]
            at += len(i)
            out.append(np.packbits(np.concatenate(own)).tobytes())
        trim()
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "data": pa.array(out, pa.binary())})

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        keys_rows = right.filter(pc.equal(right.column("shard"), -1))
        keys, hot = wanted(keys_rows)
        answers = {s: raw.as_py() for s, raw in zip(right.column("shard").to_pylist(), right.column("data"), strict=True) if s >= 0}
        made: list[pa.Table] = []
        for payload in left.column("payload"):
            block = Block(payload.as_py(), kind)
            (start, count, route, doc), first, own, shard, _ = block.distinct(keys, hot, shards)
            flags: dict[int, np.ndarray] = {}
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for g in np.split(np.arange(len(own)), cuts) if len(own) else []:
                u = own[g]
                u = u[np.argsort(route[u], kind="stable")]
                bits = np.unpackbits(np.frombuffer(answers[int(shard[g[0]])], np.uint8)).astype(bool)
                ends = np.concatenate(([0], np.cumsum(count[u])))
                flags.update((k, bits[s:e]) for k, s, e in zip(u.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            again = block.rank[doc] != block.rank[doc[first]]  # repeated rows of one id are no earlier document
            if kind.within:
                again |= (doc == doc[first]) & (first != np.arange(len(first)))
            marks = [np.ones(c, bool) if a else flags[f] for a, f, c in zip(again.tolist(), first.tolist(), count.tolist(), strict=True)]
            on = np.concatenate(marks) if marks else np.empty(0, bool)
            windows = np.arange(len(on)) + np.repeat(start - (np.cumsum(count) - count), count)
            made.append(pa.table(finish(block, windows[on])))
        trim()
        return pa.concat_tables(made)

    anchors = packed.select("block", "payload").mapInArrow(send_anchors, "bucket int, block long, data binary")
    wants = written(anchors.groupBy("bucket").applyInArrow(repeated, "block long, data binary"), "anchors")
    sent = packed.groupBy("block").cogroup(wants.groupBy("block")).applyInArrow(send_units, "shard int, block long, data binary")
    answers = sent.groupBy("shard").applyInArrow(decide, "block long, shard int, data binary")
    told = answers.unionByName(wants.select("block", F.lit(-1).alias("shard"), "data"))
    return packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(close, schema)


def covered(size: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which symbols lie in a window that begins at one of ``starts``."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:-1]) > 0


def groups_of(route: np.ndarray, weight: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in groups of about ``most`` weight; rows of one route stay together."""
    order = np.argsort(route, kind="stable")
    ends = np.cumsum(weight[order])
    new = np.concatenate(([True], route[order][1:] != route[order][:-1]))
    cell = (ends - weight[order]) // most
    at_route = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    cuts = np.flatnonzero(np.diff(cell[at_route])) + 1
    return np.split(order, cuts)
