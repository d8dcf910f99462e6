"""Filter interaction audit: one mask of failed filters a document, and all orders of the filters walked by single swaps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetide.llm.skew import join_hot
from sitetide.session import ship, table, written

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bounds of the filters: words at least, distinct words in a hundred at least, capitals in a hundred characters at most.
MIN_WORDS = 50
MIN_DISTINCT = 65
MAX_CAPITALS = 5
MARKS = "[#$%&*|]"


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask``: the digest of each whole text and, bit by bit, which filters but the last it fails.

    Filters: A few words, B few distinct words, C many capitals, D holds a mark. A null text counts as empty, which has no
    words and so fails A alone; a null source is the part ''. Written once, as several steps read it.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    length = F.length("t")
    capitals = length - F.length(F.translate("t", CAPITALS, ""))
    failed = (
        n < MIN_WORDS,
        distinct * 100 < n * MIN_DISTINCT,
        capitals.cast("long") * 100 > length.cast("long") * MAX_CAPITALS,
        F.col("t").rlike(MARKS),
    )
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))
    return written(rows.select("doc_id", "part", F.sha2("t", 256).alias("digest"), mask.alias("mask")), "failures")


def with_copies(failed: DataFrame) -> DataFrame:
    """``failed`` with the bit of the last filter, E: the same text under a smaller id, anywhere in the table.

    Only digests and ids meet. A null id is smaller than none and has none below it; rows that repeat the smallest id of a
    text all pass. Copies are summed before they are shuffled, and the texts with most copies are broadcast.
    """
    firsts = written(failed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "firsts")
    rows = join_hot(failed, firsts, ["digest"], "copies")
    bit = F.when(F.col("doc_id") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0)
    return rows.select("doc_id", "part", (F.col("mask") + bit).alias("mask"))


def cells(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: at most 32 rows a part. A document is good (toxic) if any of its labels says so."""
    said = labels.groupBy("doc_id").agg(F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("toxic = 1")).alias("toxic"))
    rows = marked.join(said.filter("good or toxic"), "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places k whose swap with k + 1 leads from one order of n things to the next, through all of them once.

    The last thing sweeps through the others from end to end and back; each time it rests at an end, the others take one
    step of their own walk.
    """
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + (1 if down else 0)
        down = not down


class Walk:
    """Counts of each step of the present order of filters, for the cells ``{mask: (n, good, toxic)}`` of one part."""

    def __init__(self, found: dict[int, tuple[int, int, int]], filters: str = FILTERS):
        self.found, self.order = found, list(range(len(filters)))
        self.names = filters
        self.total = sum(c[0] for c in found.values())
        self.alone = [found.get(1 << f, (0, 0, 0))[0] for f in self.order]
        self.fails = [sum(c[0] for m, c in found.items() if m >> f & 1) for f in self.order]
        self.steps = []
        before = 0
        for f in self.order:
            self.steps.append(self.removed(f, before))
            before |= 1 << f

    def removed(self, f: int, before: int) -> tuple[int, int, int]:
        """Documents, good and toxic ones, that fail a filter and none of the set ``before`` it."""
        hit = [c for m, c in self.found.items() if m >> f & 1 and not m & before]
        return sum(c[0] for c in hit), sum(c[1] for c in hit), sum(c[2] for c in hit)

    def swap(self, k: int) -> None:
        """Exchange the filters at k and k + 1: no other step has other filters before it than it had."""
        before = sum(1 << f for f in self.order[:k])
        second, first = self.order[k : k + 2]
        self.order[k : k + 2] = first, second
        self.steps[k : k + 2] = self.removed(first, before), self.removed(second, before | 1 << first)

    def rows(self) -> list[tuple]:
        kept, out = self.total, []
        name = "".join(self.names[f] for f in self.order)
        for at, (f, (n, good, toxic)) in enumerate(zip(self.order, self.steps, strict=True)):
            kept -= n
            out.append((name, at + 1, kept, n, self.fails[f] - n, self.alone[f], good, toxic, f))
        return out


def walked(found: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """A row for each order and step; the last field is the filter's removed documents, summed over all orders."""
    walk, rows = Walk(found, filters), []
    share = [0] * len(filters)
    path = swaps(len(filters))
    while True:
        for row in walk.rows():
            share[row[-1]] += row[3]
            rows.append(row)
        k = next(path, None)
        if k is None:
            return [(*row[:-1], share[row[-1]]) for row in rows]
        walk.swap(k)


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and the counts of each step of each order of the filters, for each source.

    Documents meet in cells of (part, mask), which are summed before they are shuffled; then each part's at most 32 cells
    are walked: the next order differs by one swap of neighbours, so two steps are counted anew from the cells, and the
    Shapley sums grow along the walk. Null ids have no labels; repeated rows count each; long texts are read whole; columns
    other than ``doc_id, text, source`` are ignored; an empty table has no part and gives no row.
    """
    ship(docs.sparkSession)
    found = cells(with_copies(failures(docs)), labels)
    parts = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = walked({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in of})
                columns = [list(c) for c in zip(*rows, strict=True)]
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
                made = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string()), *made], ["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
