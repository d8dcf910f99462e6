"""Token ids in ORC: run-length coded ids in stripes, with row indexes and Bloom filters on the document id."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitetide.llm.bpe import Words, pieces, vocabulary_path
from sitetide.session import own_folder, ship, table, trim

END_ID = 1
ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.02",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(4 << 20),
    "orc.compress": "ZSTD",
}
#: Text bytes of one range of ids, at most by about the evenness of the ranges.
RANGE_BYTES = 32 << 20


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Write ``part, seq, doc_id, ids`` of every row as ORC files whose order is ascending ``doc_id``.

    Documents are dealt to ranges of ids and sorted inside; ``part`` numbers the ranges and ``seq`` the rows of one,
    so the two give the order of the whole output, ties included. Null ids come first; a null text holds only the
    end id, as does an empty one; long texts are whole; an empty table gives files without rows; columns other than
    ``doc_id`` and ``text`` are ignored. The ids column is integer run-length coded by ORC.
    """
    ship(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ranged = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seq = Words.of(vocabulary), 0
        for batch in batches:
            for piece in pieces(batch):
                ids = coder.encode(piece.column(1))
                bounds = ids.offsets.to_numpy()
                flat = np.insert(ids.values.to_numpy(), bounds[1:], end_id)
                ends = bounds + np.arange(len(bounds), dtype=np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                rows = pa.array(np.arange(seq, seq + len(made)))
                seq += len(made)
                yield pa.RecordBatch.from_arrays([piece.column(2), rows, piece.column(0), made], ["part", "seq", "doc_id", "ids"])
        trim()

    out = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(run, f"part int, seq long, doc_id {kind}, ids array<int>")
    out.write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; given ids, only stripes whose statistics and Bloom filters may hold them are read."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


@F.arrow_udf(T.LongType())
def ids_crc32(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""

    for ids in batches:
        flat, bounds = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<u4")).cast("B"), ids.offsets.to_pylist()
        yield pa.array([zlib.crc32(flat[4 * s : 4 * e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64())


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``: the ids before a row in file order, from sums inside a range and sums of the ranges before."""
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # one row for each range
    before = totals.select("part", F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("skip"))
    joined = rows.join(before, "part")
    own = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return joined.withColumn("start", (own + F.coalesce("skip", F.lit(0))).cast("long"))


def op2_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{own_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    rows = read_tokens(spark, path).select("part", "seq", "doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_crc32("ids").alias("ids_crc32"))
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
