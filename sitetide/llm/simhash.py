"""SimHash near-duplicates: deletion-variant signatures, an equality join on them, verification and components.

Two fingerprints that differ in at most 2n - 1 bits agree up to one bit in one of n segments, so the number of segments
follows the distance that is asked for. Texts that share no less than four fifths of their shingles often differ in more
bits than segments of a useful size allow; for these, bands of least hashes find further candidates, and a join of the
first shingles of each text, rare ones before common ones, finds all that are left. All this is done for texts only that
share so many of their shingles with other texts that one of these may be similar; most texts of a corpus do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sitetide.llm.skew import join_hot
from sitetide.operators.components import connected_components
from sitetide.operators.similarity import product
from sitetide.session import free_name, ship, table, trim, written

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Two texts are near copies if they share this much of their distinct shingles, as a fraction.
SIMILAR = (4, 5)
#: Bands of least hashes, and hashes of a band: two sets with a Jaccard index of 0.8 share a band with probability 0.99.
BANDS, ROWS = 16, 6
#: Shared first shingles that a pair of long texts must have, and the share of a text's shingles that asks for one.
SHARED, EACH = 16, 12
#: Texts that have a shingle that counts as common, and how many such shingles are kept, the most frequent ones. They set
#: the order of shingles only; no pair depends on them.
COMMON, MOST = 16, 1 << 18
#: Shingles of a chunk of texts whose shingles are told to all parts at once (texts are not cut), and characters of text for
#: each part.
CHUNK, PART_CHARS = 1 << 19, 1 << 23
#: Bits of a shingle's hash that tell it apart there; two that agree by chance only add a text to those looked at.
TOLD = 40
#: A first shingle of more sets gives no pairs of them: these meet in blocks of at most so many sets and hashes.
OFTEN, BLOCK, HASHES = 64, 512, 1 << 17
#: Places where two blocks have a shingle in common, counted at once.
MEETINGS = 1 << 18
#: So many documents at most are picked out by a broadcast of their ids; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def segments(distance: int) -> list[tuple[int, int]]:
    """The fewest segments (three at least) of which one holds at most one of ``distance`` differing bits."""
    n = max(3, distance // 2 + 1)
    ends = np.cumsum([64 // n + (k < 64 % n) for k in range(n)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _digests(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """The xxHash64 of each word shingle, eight bytes a row."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty((0, 8), np.uint8)
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    raw = b"".join(
        [digest(joined[s:e], seed) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    )
    return np.frombuffer(raw, np.uint8).reshape(-1, 8)


def _majority(rows: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 where there is no word."""
    return _majority(_digests(text, shingle, seed))


def shingle_set(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    return np.unique(_digests(text, shingle, seed).view(">u8").ravel().astype(np.uint64))


_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def bands(found: np.ndarray) -> np.ndarray:
    """A number for each band: equal where two sets have the same least shingle in all of its orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at : at + 4096, None] * _FACTORS[0] + _FACTORS[1]).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64)


def least_shared(n: int) -> tuple[int, int]:
    """What a set of ``n`` shares with any set that is similar, and how many of these its first ones are asked for."""
    up, down = SIMILAR
    shared = -(-n * up // down)
    return shared, max(1, min(SHARED, shared // EACH))


def first_shingles(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The upper halves of a set's first shingles, those of ``common`` (sorted) last.

    Two sets that share s shingles have the k-th shared one, in any order that is the same for both, among the first
    n - s + k of either; so similar sets share as many first ones as the lesser of both asks for.
    """
    shared, asked = least_shared(len(found))
    high = (found >> np.uint64(32)).astype(np.uint32)
    if len(common):
        at = np.minimum(np.searchsorted(common, high), len(common) - 1)
        is_common = common[at] == high
        high = np.concatenate((high[~is_common], high[is_common]))
    return high[: len(found) - shared + asked]


def sketch(text: str | None, shingle: int = SHINGLE, seed: int = SEED, common: np.ndarray = np.empty(0, np.uint32)) -> tuple[np.ndarray, np.ndarray]:
    """Of a text's set of shingles: a digest (equal sets have equal ones), its SimHash, its size, and its bands; and its
    first shingles."""
    found = shingle_set(text, shingle, seed)
    first = [xxhash.xxh64_intdigest(found.tobytes(), seed), _majority(found.astype(">u8").view(np.uint8).reshape(-1, 8)), len(found)]
    return np.concatenate((np.array(first, np.uint64), bands(found))), first_shingles(found, common)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every row."""
    return with_fingerprints(docs.select("doc_id", "text"), "fp", shingle, seed).drop("text")


def with_fingerprints(docs: DataFrame, name: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with the fingerprint in a column ``name`` that it does not have; only the texts go through Python."""
    ship(docs.sparkSession)

    @F.arrow_udf(T.LongType())
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(x.as_py(), shingle, seed) for x in texts], np.uint64).view(np.int64))
        trim()

    return docs.withColumn(name, made(F.col("text")))


_SKETCH = T.StructType([*[T.StructField(c, T.LongType()) for c in ("set", "fp", "size")], T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("firsts", T.ArrayType(T.IntegerType()))])


def with_sketches(docs: DataFrame, name: str, shingle: int = SHINGLE, seed: int = SEED, common: np.ndarray = np.empty(0, np.uint32)) -> DataFrame:
    """``docs`` with a struct ``set, fp, size, bands, firsts`` of each text's set of shingles in a column ``name`` that it
    does not have."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(common)

    @F.arrow_udf(_SKETCH)
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            both = [sketch(x.as_py(), shingle, seed, shared.value) for x in texts]
            rows = np.array([x for x, _ in both], np.uint64).reshape(-1, 3 + BANDS).view(np.int64)
            each = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(rows) + 1, BANDS, dtype=np.int32)), pa.array(rows[:, 3:].ravel()))
            ends = np.cumsum([0, *[len(x) for _, x in both]]).astype(np.int32)
            firsts = np.concatenate([np.empty(0, np.uint32), *[x for _, x in both]]).view(np.int32)
            lists = [each, pa.ListArray.from_arrays(pa.array(ends), pa.array(firsts))]
            yield pa.StructArray.from_arrays([*[pa.array(rows[:, k]) for k in range(3)], *lists], ["set", "fp", "size", "bands", "firsts"])
        trim()

    return docs.withColumn(name, made(F.col("text")))


def with_digests(docs: DataFrame, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the digest of each text's set of shingles, that of its sketch, in a column ``name`` that it does not
    have."""
    ship(docs.sparkSession)

    @F.arrow_udf(T.LongType())
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([xxhash.xxh64_intdigest(shingle_set(x.as_py(), shingle).tobytes(), SEED) for x in texts], np.uint64).view(np.int64))
        trim()

    return docs.withColumn(name, digest(F.col("text")))


def common_shingles(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """The upper halves of shingles that many different texts have, sorted."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                high = np.unique((shingle_set(x.as_py(), shingle) >> np.uint64(32)).astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array(high.view(np.int32))], ["high"])
        trim()

    texts = docs.select("text").dropDuplicates(["text"])
    counted = texts.mapInArrow(run, "high int").groupBy("high").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    found = counted.orderBy(F.desc("n"), "high").limit(MOST).select("high").collect()
    return np.sort(np.array([r[0] for r in found], np.int32).view(np.uint32))


def told_shingles(found: np.ndarray) -> tuple[np.ndarray, int]:
    """Of a set, the shingles that are counted, those with the least hashes, and how many of them it has in common with such
    shingles of any similar set at least."""
    asked = [max(1, min(s, 3 * (n - s) // 2)) for n in (len(found), least_shared(len(found))[0]) for s in (least_shared(n)[0],)]
    return found[: len(found) - least_shared(len(found))[0] + asked[0]], asked[1] if len(found) else 0


def _coded(values: np.ndarray) -> bytes:
    """Rising numbers as the bytes of their differences, all lowest bytes first, so that they are squeezed well."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : TOLD // 8].T.tobytes()


def _decoded(code: bytes) -> np.ndarray:
    planes = np.frombuffer(code, np.uint8).reshape(TOLD // 8, -1).astype(np.uint64)
    return np.cumsum((planes << (np.arange(TOLD // 8, dtype=np.uint64) * np.uint64(8))[:, None]).sum(axis=0, dtype=np.uint64), dtype=np.uint64)


def told_apart(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, _set, alone`` of every row: the digest of its set of shingles, and whether too few of these are in other rows
    for any other to be equal or similar.

    A chunk of texts tells each part of the hashes which of them it has, those of several texts once; the part tells the
    chunks which of theirs others have too. A row is alone if fewer of its first shingles are met than similar sets share. So
    work and disk grow with the texts, a frequent shingle counts once for each chunk, and rows that are alone need no further search.
    """
    ship(docs.sparkSession)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts, kind = max(32, chars // PART_CHARS), docs.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(kind)
    told = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("part", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("hashes", "many", "owners")]])
    own = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("sets", T.ArrayType(T.LongType())), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("asked", "met")]])

    def chunk_rows(chunk: int, ids: list, digests: list[int], asked: list[int], firsts: list[np.ndarray]) -> pa.RecordBatch:
        """A row for each part, and one with the chunk's own rows."""
        owner = np.repeat(np.arange(len(firsts), dtype=np.uint16), [len(x) for x in firsts])
        value, part = np.divmod(np.concatenate(firsts), np.uint64(parts))
        key = (part << np.uint64(TOLD)) | value
        order = np.argsort(key)
        key, owner = key[order], owner[order]
        del value, part, order
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        times = np.diff(starts, append=len(key))
        met = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(firsts))
        bounds = np.arange(parts + 1, dtype=np.uint64) << np.uint64(TOLD)
        once, many = (key[starts[pick]] for pick in (times == 1, times > 1))
        owner, mask = owner[starts[times == 1]], np.uint64((1 << TOLD) - 1)
        at, of = np.searchsorted(once, bounds), np.searchsorted(many, bounds)
        wanted = np.flatnonzero((np.diff(at) > 0) | (np.diff(of) > 0)).tolist()
        columns = [
            [_coded(once[at[k] : at[k + 1]] & mask) for k in wanted], [_coded(many[of[k] : of[k + 1]] & mask) for k in wanted],
            [owner[at[k] : at[k + 1]].tobytes() for k in wanted],
        ]
        none = pa.nulls(len(wanted))
        last = [ids, np.array(digests, np.uint64).view(np.int64).tolist(), asked, met.tolist()]
        schema = [pa.list_(arrow_kind), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        arrays = [pa.array([chunk] * (len(wanted) + 1), pa.int64()), pa.array([*wanted, chunk % parts], pa.int32())]
        arrays += [pa.array([*c, None], pa.binary()) for c in columns]
        arrays += [pa.concat_arrays([none.cast(t), pa.array([x], t)]) for x, t in zip(last, schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [*told.names, *own.names])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, hashes = TaskContext.get().partitionId() << 32, ([], [], [], []), 0
        for batch in batches:
            for k in range(batch.num_rows):
                found = shingle_set(batch.column(1)[k].as_py(), shingle)
                firsts, asked = told_shingles(found)
                row = batch.column(0)[k].as_py(), xxhash.xxh64_intdigest(found.tobytes(), SEED), asked, firsts >> np.uint64(64 - TOLD)
                for column, x in zip(held, row, strict=True):
                    column.append(x)
                hashes += len(firsts)
                if hashes >= CHUNK or len(held[0]) == 1 << 16:
                    yield chunk_rows(chunk, *held)
                    chunk, held, hashes = chunk + 1, ([], [], [], []), 0
        if held[0]:
            yield chunk_rows(chunk, *held)
        trim()

    def meet(rows: pa.Table) -> pa.Table:
        """Of a part, the rows of each chunk once more for every shingle that another chunk has as well."""
        from_chunks = rows.filter(rows.column("hashes").is_valid())
        once = [_decoded(x.as_py()) for x in from_chunks.column("hashes")]
        every, times = np.unique(np.concatenate([np.empty(0, np.uint64), *once, *[_decoded(x.as_py()) for x in from_chunks.column("many")]]), return_counts=True)
        owners = []
        for mine, x in zip(once, from_chunks.column("owners"), strict=True):
            owners.append(np.frombuffer(x.as_py(), np.uint16)[times[np.searchsorted(every, mine)] > 1].tobytes())
        answers = from_chunks.set_column(from_chunks.schema.get_field_index("owners"), "owners", pa.array(owners, rows.schema.field("owners").type))
        names = ["chunk", "owners", *own.names]
        del once, every, times
        trim()
        return pa.concat_tables([answers.select(names), rows.filter(rows.column("hashes").is_null()).select(names)])

    def tally(rows: pa.Table) -> pa.Table:
        head = rows.filter(rows.column("ids").is_valid()).combine_chunks().to_batches()[0]
        ids, sets, asked, met = (head.column(c)[0].values for c in own.names)
        owners = np.concatenate([np.empty(0, np.uint16), *[np.frombuffer(x.as_py(), np.uint16) for x in rows.column("owners") if x.is_valid]])
        alone = np.bincount(owners, minlength=len(ids)) + met.to_numpy() < asked.to_numpy()
        del owners
        trim()
        return pa.table([ids, sets, pa.array(alone)], ["doc_id", "_set", "alone"])

    sent = docs.select("doc_id", "text").mapInArrow(tell, T.StructType([*told, *own]))
    answers = sent.groupBy("part").applyInArrow(meet, T.StructType([told["chunk"], told["owners"], *own]))
    return answers.groupBy("chunk").applyInArrow(tally, T.StructType([T.StructField("doc_id", kind), T.StructField("_set", T.LongType()), T.StructField("alone", T.BooleanType())]))


def variants(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``key`` before the columns of ``fps``: for each bit of ``fp``, its segment with that bit as a wildcard (64 rows)."""
    parts = segments(distance)
    of = [next((lo, hi - lo) for lo, hi in parts if lo <= j < hi) for j in range(64)]
    bits = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(of[j][0]).alias("low"), F.lit(of[j][1]).alias("width")) for j in range(64)])
    out = fps.select(*fps.columns, F.explode(bits).alias("_b"))
    key = "(_b.j << 22) | cast((shiftrightunsigned(fp, _b.low) & ((1L << _b.width) - 1)) & ~(1L << (_b.j - _b.low)) as int)"
    return out.select(F.expr(key).alias("key"), *fps.columns)


def first_bucket(diff: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """The first wildcard bit under which two fingerprints that differ in these bits meet."""
    out = np.full(len(diff), -1, np.int64)
    for lo, hi in segments(distance):
        part = diff & np.uint64(((1 << hi) - 1) ^ ((1 << lo) - 1))
        count = np.bitwise_count(part)
        bit = np.bitwise_count(np.maximum(part, np.uint64(1)) - np.uint64(1)).astype(np.int64)
        bit = np.where(count == 0, lo, bit)
        out = np.where((out < 0) & (count <= 1), bit, out)
    return out


def bucket_links(key: int, fps: np.ndarray, distance: int = DISTANCE) -> tuple[list, list]:
    """Links that connect what one bucket connects, without all its pairs.

    Breadth first over the bucket: each visited fingerprint is compared with those not reached yet, so a tight group
    is used up by its first members. A link is given only in the first bucket where its two ends meet; by induction
    over the buckets the links of all buckets still connect whatever is linked.
    """
    left, mine = fps, key >> 22
    a, b = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            diff = left ^ x
            near = np.bitwise_count(diff) <= distance
            if near.any():
                got = left[near]
                keep = got[first_bucket(diff[near], distance) == mine]
                a.extend([x] * len(keep))
                b.extend(keep)
                queue.extend(got)
                left = left[~near]
    return a, b


def _linked(distance: int):
    """Links of each bucket of ``key, fp`` rows sorted by key."""

    def emit(keys: np.ndarray, fps: np.ndarray):
        a, b = [], []
        if len(keys):
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
            size = ends - starts
            two = starts[size == 2]
            diff = fps[two] ^ fps[two + 1]
            good = (np.bitwise_count(diff) <= distance) & (first_bucket(diff, distance) == keys[two] >> 22)
            a.extend(fps[two][good])
            b.extend(fps[two + 1][good])
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                more = bucket_links(int(keys[s]), fps[s:e], distance)
                a.extend(more[0])
                b.extend(more[1])
        x, y = np.array(a, np.uint64).view(np.int64), np.array(b, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, fps = np.concatenate((keys, k)), np.concatenate((fps, f))
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if done:
                yield emit(keys[:done], fps[:done])
                keys, fps = keys[done:], fps[done:]
        yield emit(keys, fps)
        trim()

    return run


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; fingerprints at most ``distance`` bits apart are linked.

    Equal fingerprints are one node, so a hot group of copies costs one row. The 64 one-wildcard variants of each
    distinct fingerprint meet in buckets of distinct 8-byte values. A null text has no words and fingerprint zero, as
    an empty one; a long text is whole; rows with a null id take part but never name a component (null where a group has
    no id at all); repeated rows are rows of their own. An empty table gives none; other columns are ignored.
    """
    fps = written(fingerprints(docs, shingle), "fingerprints")
    each = written(classes(fps, distance).select("fp", "n", "component_id"), "classes")
    return join_hot(fps, each, ["fp"], "n").select("doc_id", "fp", "component_id")


def classes(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp, least, n, component, component_id`` of every distinct fingerprint: the smallest id that has it, its rows, a
    fingerprint that names its group, and the smallest id of the group."""
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    spread = variants(nodes.select("fp"), distance).repartition("key").sortWithinPartitions("key")
    edges = spread.mapInArrow(_linked(distance), "a long, b long")
    groups = connected_components(edges)
    joined = written(nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    named = written(joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "groups")
    return join_hot(joined, named, ["component"], "members").drop("members")


def keep_one(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of ``docs``: that with the smallest id.

    Groups are those of ``near_duplicates``. Rows with a null id stay only where their group has no id; of repeated
    rows with one id and one fingerprint a single one stays. Any further columns pass through, whatever their names. An
    empty table gives none.
    """
    fps = written(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", F.col("fp").alias("of"))).alias("first")
    kept = classes(fps, distance).groupBy("component").agg(first).select("first.least", "first.of")
    name = free_name("fp", docs)
    return _picked(with_fingerprints(docs, name, shingle), F.col(name), kept, docs.columns)


def _picked(rows: DataFrame, key: F.Column, kept: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each of ``kept (least, of)`` by id and key, with these columns.

    Few rows carry a kept id, so a broadcast of the kept ids is tried where their number allows; else both sides meet
    by id and key. Repeated rows of one id and key are numbered to keep one.
    """
    kept_id, kept_of, nth = (free_name(c, rows) for c in ("kept_id", "kept_of", "nth"))
    kept = kept.select(F.col("least").alias(kept_id), F.col("of").alias(kept_of))
    joined = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (key == F.col(kept_of)))
    one = joined.withColumn(nth, F.row_number().over(Window.partitionBy(kept_id, kept_of).orderBy(F.lit(0))))
    return one.filter(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in columns])


def _texts(wanted: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """``_set, text`` of the sets in ``wanted``, one text each; ``sets (_set, least)`` tells which document has a set."""
    needed = written(wanted.distinct().join(sets.select("_set", "least"), "_set"), "needed")
    ids = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    found = docs.select("doc_id", "text").join(ids.select("least").distinct(), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    texts = with_digests(found.select("text"), "_set", shingle).select("_set", "text").join(ids.select("_set"), "_set", "left_semi")
    return written(texts.dropDuplicates(["_set"]), "texts")  # a null or repeated id may have several texts


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("_set"))


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Those of ``pairs (a, b)`` of sets that have a Jaccard index of ``SIMILAR`` at least, from their ``texts``."""
    up, down = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, met, good = batch.column(0).to_pylist(), batch.column(1).to_pylist(), {}, []
            for ends, column in ((a, batch.column(2)), (b, batch.column(3))):
                for k, end in enumerate(ends):
                    if end not in met:
                        met[end] = shingle_set(column[k].as_py(), shingle)
            for x, y in zip(a, b, strict=True):
                shared = len(np.intersect1d(met[x], met[y], assume_unique=True))
                good.append(shared * down >= up * (len(met[x]) + len(met[y]) - shared))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
        trim()

    left = texts.select(F.col("_set").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("_set").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _met_firsts(sets: DataFrame, often: int = OFTEN) -> DataFrame:
    """Where sets ``(_set, size, firsts, component)`` of different components meet: ``a, b, often``.

    A first shingle of at most ``often`` sets gives the pairs of those with fitting sizes; a pair stays if it shares as many
    of these shingles as similar sets do. Of any other first shingle, ``b``, there is a row for each set that has it: similar
    sets that fall short of the first kind share one of the second.
    """
    up, down = SIMILAR
    asked = F.greatest(F.lit(1), F.least(F.lit(SHARED), F.floor(F.ceil(F.col("size") * up / down) / EACH)))
    posts = sets.select(F.explode("firsts").alias("high"), "_set", "component", F.col("size").cast("int").alias("size"), asked.cast("int").alias("asked"))

    def met(own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The pairs of one shingle, sizes rising: each set with the later ones that are not too large."""
        order = np.argsort(own[2], kind="stable")
        ids, component, size, least = (x[order] for x in own)
        last = np.searchsorted(size * up, size * down, "right")
        for k in range(len(ids) - 1):
            keep = np.flatnonzero(component[k + 1 : last[k]] != component[k]) + k + 1
            if len(keep):
                mine = np.full(len(keep), ids[k])
                yield row(np.minimum(mine, ids[keep]), np.maximum(mine, ids[keep]), np.minimum(least[keep], least[k]), False)

    def row(a: np.ndarray, b: np.ndarray, least: np.ndarray, many: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(x) for x in (a, b, least)], pa.array(np.full(len(a), many))], ["a", "b", "asked", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, rest, known = np.empty(0, np.int32), [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)], None

        def emit(end: int) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(high[:end])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [end]))
            several = np.flatnonzero(np.maximum.reduceat(rest[1][:end], starts) != np.minimum.reduceat(rest[1][:end], starts))
            several = several[ends[several] - starts[several] <= often]
            held, rows = [], 0
            many = np.repeat((ends - starts > often) | (high[starts] == known), ends - starts)
            if many.any():
                yield row(rest[0][:end][many], high[:end][many].astype(np.int64), rest[3][:end][many], True)
            for s, e in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
                if high[s] == known:
                    continue
                for batch in met([x[s:e] for x in rest]):
                    held.append(batch)
                    rows += batch.num_rows
                    if rows > 1 << 16 or len(held) > 1 << 12:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, rows = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            high, rest = np.concatenate((high, cols[0])), [np.concatenate((x, c)) for x, c in zip(rest, cols[1:], strict=True)]
            done = int(np.searchsorted(high, high[-1])) if len(high) else 0
            if len(high) - done > often:  # what more there is of the last shingle need not be waited for
                done = len(high)
            if done:
                yield from emit(done)
                known = int(high[done - 1])
                high, rest = high[done:], [x[done:] for x in rest]
        if len(high):
            yield from emit(len(high))
        trim()

    rows = posts.repartition("high").sortWithinPartitions("high").mapInArrow(run, "a long, b long, asked int, often boolean")
    return rows.groupBy("a", "b", "often").agg(F.count("*").alias("n"), F.min("asked").alias("asked")).filter("often OR n >= asked").select("a", "b", "often")


class _Block:
    """The sets of a block as postings: ``ranks`` are its shingles; of each, the sets ``of`` from ``starts`` on."""

    def __init__(self, batch: pa.RecordBatch, k: int, side: str):
        at, hashes, self.component = (batch.column(f"{side}_{c}")[k].values.to_numpy(zero_copy_only=False) for c in ("at", "hashes", "components"))
        self.n, self.size = len(at) - 1, np.diff(at)
        self.ranks, codes = np.unique(hashes, return_inverse=True)
        self.of = np.repeat(np.arange(self.n, dtype=np.int32), self.size)[np.argsort(codes, kind="stable")]
        self.sizes = np.bincount(codes, minlength=len(self.ranks))
        self.starts, self.value = np.cumsum(self.sizes) - self.sizes, np.ones(len(self.of))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links ``a, b`` as few as connect what all of them connect."""
    names, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    linked = np.zeros((len(names), len(names)), bool)
    x, y = codes[: len(a)], codes[len(a) :]
    linked[x, y] = linked[y, x] = True
    left, queue, ends = np.ones(len(names), bool), [], ([], [])
    for first in range(len(names)):
        if left[first]:
            left[first], queue = False, [first]
        while queue:
            node = queue.pop()
            got = np.flatnonzero(linked[node] & left)
            left[got] = False
            queue.extend(got.tolist())
            ends[0].extend([node] * len(got))
            ends[1].extend(got.tolist())
    return tuple(names[np.array(e, np.int64)] for e in ends)


def _met_often(often: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, block: int | None = None) -> DataFrame:
    """Links ``of_a, of_b`` that connect the components of similar sets of which both have one of the shingles in
    ``often (_set, high)``, from their texts.

    Sets lie in blocks, those with the same least such shingle side by side. Blocks that have such a shingle in common meet
    in a cross join, and all pairs of their sets are judged by the task that has both; it gives as few links as connect their
    components. So no row is made for a pair, and a group of any size is dealt to all tasks.
    """
    (up, down), block = SIMILAR, block or BLOCK
    each = often.groupBy("_set").agg(F.collect_list("high").alias("highs"))
    rows = written(texts.join(each, "_set").join(sets.select("_set", "component"), "_set"), "rows")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes = [], 0

        def made() -> pa.RecordBatch:
            found, highs, components = zip(*held, strict=True)
            sizes = [len(x) for x in found]
            lists = [np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), np.concatenate(found).view(np.int64), np.array(components, np.int64), np.unique(np.concatenate(highs)).astype(np.int32)]
            whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists]
            return pa.RecordBatch.from_arrays([*whole, pa.array([min(sizes)]), pa.array([max(sizes)])], ["at", "hashes", "components", "highs", "least", "most"])

        for batch in batches:
            for k in range(batch.num_rows):
                found = shingle_set(batch.column(0)[k].as_py(), shingle)
                if held and (len(held) >= block or hashes + len(found) > HASHES):
                    yield made()
                    held, hashes = [], 0
                held.append((found, batch.column(1)[k].values.to_numpy(), batch.column(2)[k].as_py()))
                hashes += len(found)
        if held:
            yield made()
        trim()

    least = F.array_min("highs").alias("_least")
    ranged = rows.select("text", "highs", "component", least, "_set").repartitionByRange("_least", "_set").sortWithinPartitions("_least", "_set").select("text", "highs", "component")
    blocks = ranged.mapInArrow(packed, "at array<int>, hashes array<bigint>, components array<bigint>, highs array<int>, least bigint, most bigint")
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks", 1)
    left, right = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "xy")
    fits = (F.col("x_least") * up <= F.col("y_most") * down) & (F.col("y_least") * up <= F.col("x_most") * down)
    both = left.join(right, (F.col("x_block") >= F.col("y_block")) & fits & F.arrays_overlap("x_highs", "y_highs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column("x_block")[k].as_py()
                if number != last[0]:
                    last = number, _Block(batch, k, "x")
                x, y = last[1], _Block(batch, k, "y")
                shared = product(x, y, MEETINGS)
                close = (shared * down >= up * (x.size[:, None] + y.size - shared)) & (x.component[:, None] != y.component)
                i, j = np.nonzero(close)
                yield pa.RecordBatch.from_arrays([pa.array(e) for e in spanning(x.component[i], y.component[j])], ["of_a", "of_b"])
        trim()

    names = [f"{side}_{c}" for side in "xy" for c in ("block", "at", "hashes", "components")]
    return both.select(*names).mapInArrow(run, "of_a long, of_b long")


def similar_sets(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """``_set, least, component`` of every distinct set of shingles: the smallest id that has it and a set that names
    its group. Sets are linked by a true Jaccard index of ``SIMILAR`` or more.

    Candidates are the links of fingerprints at most ``distance`` bits apart, by their deletion variants, and each set
    with a leader of each of its bands; every band has an order of its own for that, so sets of a group meet under
    several leaders. A group of n sets gives at most ``BANDS`` x n candidates, never all its pairs. What these miss is
    found between groups only: sets of two groups that share enough of their first shingles, by ``_met_firsts``, and by
    ``_met_often`` where many sets have such a shingle.
    """
    up, down = SIMILAR
    made = with_sketches(docs.select("doc_id", "text"), "s", shingle, common=common_shingles(docs, shingle))
    each = made.groupBy(F.col("s.set").alias("_set")).agg(F.min("doc_id").alias("least"), F.any_value("s.fp").alias("fp"), F.any_value("s.size").alias("size"), F.any_value("s.bands").alias("bands"), F.any_value("s.firsts").alias("firsts"))
    sets = written(each, "sets")
    fps = written(sets.groupBy("fp").agg(F.min("_set").alias("head"), F.count("*").alias("n")), "heads")
    links = variants(fps.select("fp"), distance).repartition("key").sortWithinPartitions("key").mapInArrow(_linked(distance), "a long, b long")
    ends = [fps.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_set")) for c in ("a", "b")]
    by_bits = links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_set").alias("a"), F.col("b_set").alias("b"))
    same = join_hot(sets.select("fp", "_set"), fps.filter("n > 1"), ["fp"], "n").select(F.col("_set").alias("a"), F.col("head").alias("b"))
    keyed = sets.select("_set", F.posexplode("bands").alias("band", "key"))
    leaders = keyed.groupBy("band", "key").agg(F.min_by("_set", F.xxhash64("_set", "band")).alias("leader"), F.count("*").alias("n")).filter("n > 1")
    leaders = written(leaders, "leaders")
    by_bands = join_hot(keyed, leaders, ["band", "key"], "n").select(F.col("_set").alias("a"), F.col("leader").alias("b"))
    found = by_bits.unionByName(same).unionByName(by_bands).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sizes = [sets.select(F.col("_set").alias(c), F.col("size").alias(f"n{c}")) for c in ("a", "b")]
    near = found.join(sizes[0], "a").join(sizes[1], "b").filter(F.least("na", "nb") * down >= F.greatest("na", "nb") * up).select("a", "b")
    near = written(near, "pairs")
    edges = written(_similar(near, _texts(_ends(near), docs, sets, shingle), shingle), "edges")
    named = connected_components(edges).select(F.col("node").alias("_set"), F.col("component").alias("of"))
    grouped = written(sets.join(named, "_set", "left").select("_set", "least", "size", "firsts", F.coalesce("of", "_set").alias("component")), "grouped")
    met = written(_met_firsts(grouped), "met")
    pairs, often = met.filter("NOT often").select("a", "b"), met.filter("often").select(F.col("a").alias("_set"), F.col("b").cast("int").alias("high"))
    several = often.join(grouped.select("_set", "component"), "_set").groupBy("high").agg(F.min("component").alias("c"), F.max("component").alias("d")).filter("c < d")
    often = written(often.join(several.select("high"), "high"), "often")
    texts = _texts(_ends(pairs).unionByName(often.select("_set")), docs, sets, shingle)
    more = _similar(pairs, texts, shingle)
    of = [grouped.select(F.col("_set").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b")]
    links = more.join(of[0], "a").join(of[1], "b").select("of_a", "of_b").unionByName(_met_often(often, grouped, texts, shingle))
    joined = connected_components(links, "of_a", "of_b").select(F.col("node").alias("component"), F.col("component").alias("of"))
    return grouped.join(joined, "component", "left").select("_set", "least", F.coalesce("of", "component").alias("component"))


def _of_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` with one of ``ids (doc_id)``, null among them, or without (``left_semi``, ``left_anti``)."""
    name = free_name("of_id", docs)
    ids = ids.select(F.col("doc_id").alias(name))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(name)), how)


def keep_similar(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of ``similar_sets``, with the columns of ``docs``: that with the smallest id.

    Rows with a null id stay only where their group has no id; of repeated rows with one id and one set a single one
    stays. Texts without words are one set. Further columns pass through, whatever their names; an empty table gives none.
    Rows that are alone (``told_apart``) stay as they are; groups are looked for among the others. Only rows that share
    their id with a row that goes are told apart by their sets.
    """
    rows = written(told_apart(docs, shingle), "told")
    others = written(rows.filter("NOT alone").groupBy("doc_id", "_set").agg(F.count("*").alias("n")), "others")
    some = written(_of_ids(docs.select("doc_id", "text"), others.select("doc_id").distinct(), "left_semi"), "some")
    first = F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", F.col("_set").alias("of"))).alias("first")
    kept = written(similar_sets(some, distance, shingle).groupBy("component").agg(first).select("first.least", "first.of"), "kept")
    once = others.join(kept, F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("_set") == F.col("of")) & (F.col("n") == 1), "left_anti")
    ids = written(once.select("doc_id").distinct(), "ids")
    alone = rows.filter("alone").select(F.col("doc_id").alias("least"), F.col("_set").alias("of"))
    kept = kept.unionByName(alone).withColumnRenamed("least", "doc_id")
    kept = _of_ids(kept, ids, "left_semi").select(F.col("doc_id").alias("least"), "of")
    name = free_name("set", docs)
    parted = _picked(with_digests(_of_ids(docs, ids, "left_semi"), name, shingle), F.col(name), kept, docs.columns)
    return _of_ids(docs, ids, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(parted)


def op7_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
