"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside cells, one row kept per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitetide.llm.skew import join_hot
from sitetide.operators.components import connected_components
from sitetide.session import ship, table, written

THRESHOLD = 0.93
#: Distinct vectors the cells are fitted on, at most; vectors a cell should hold; cells each vector is put in.
SAMPLE = 40_000
CELL = 512
PROBES = 3
#: A cell with more than SPLIT times CELL vectors is cut into cells of its own, fitted on at most SUB_SAMPLE of them.
SPLIT = 8
SUB_SAMPLE = 20_000
#: Rows of one block: a product of two blocks is at most 2 x BLOCK x BLOCK doubles.
BLOCK = 1024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; an empty cell keeps its old centroid."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[s : s + 4096] @ centres.T, axis=1) for s in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def unit_rows(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as unit rows in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable() -> F.Column:
    """A label, and a vector of finite parts that are not all zero; never null."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))


def classes(vectors: DataFrame) -> DataFrame:
    """``node, label, embedding, least, n``: distinct usable vectors of a label with a number of their own, their smallest
    id (null where none has one) and how many rows they stand for. Written, so that the numbers stay."""
    kept = vectors.select("vec_id", "label", "embedding").filter(_usable())
    made = kept.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    return written(made.withColumn("node", F.monotonically_increasing_id()), "classes")


def fit_cells(distinct: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> dict:
    """``{(label, length): centroids}`` from at most ``sample`` distinct vectors, one centroid for ``cell`` vectors."""
    total = distinct.count()
    picked = distinct.select("label", "embedding").orderBy(F.xxhash64("embedding", "label")).limit(sample).toArrow()
    frame = pd.DataFrame({"label": picked.column(0).to_pandas(), "v": picked.column(1).to_pylist()})
    frame["size"] = frame.v.map(len)
    cells = {}
    for (label, size), rows in frame.groupby(["label", "size"]):
        x = unit_rows(pa.array(rows.v.tolist(), pa.list_(pa.float64())))
        k = round(len(x) * max(1.0, total / max(1, len(frame))) / cell)
        cells[(label, size)] = spherical_kmeans(x, max(1, min(k, len(x) // 4)))
    return cells


def assign(distinct: DataFrame, cells: dict, probes: int = PROBES) -> DataFrame:
    """``cell, cells, node, n, embedding``: a row in each of the ``probes`` nearest cells of its label and length.

    Labels or lengths outside the fitted sample share the one cell 0 of their own key.
    """
    sent = distinct.sparkSession.sparkContext.broadcast(cells)  # at most ``sample`` / 4 centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            labels = batch.column(0).to_pylist()
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            groups: dict = {}
            for row, key in enumerate(zip(labels, sizes.tolist(), strict=True)):
                groups.setdefault(key, []).append(row)
            for key, at in groups.items():
                part = batch.take(pa.array(at))
                centres = fitted.get(key)
                near = np.zeros((len(at), 1), np.int32)
                if centres is not None and len(centres) > 1:
                    p = min(probes, len(centres))
                    near = np.argpartition(-(unit_rows(part.column(1)) @ centres.T), p - 1, axis=1)[:, :p].astype(np.int32)
                lists = pa.array(list(near), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["label", "embedding", "node", "n", "cells"])

    kinds = {f.name: f.dataType.simpleString() for f in distinct.schema}
    schema = f"label {kinds['label']}, embedding {kinds['embedding']}, node long, n long, cells array<int>"
    placed = distinct.select("label", "embedding", "node", "n").mapInArrow(run, schema)
    return placed.withColumn("length", F.size("embedding")).withColumn("cell", F.explode("cells"))


def refine(distinct: DataFrame, placed: DataFrame, cell: int = CELL, probes: int = PROBES, split: int = SPLIT) -> DataFrame:
    """``placed`` with its large cells cut into cells of about ``cell`` vectors, so that their number follows the data.

    Each large cell gets centroids from a bounded sample of its own; its vectors meet these block by block and go to the
    ``probes`` nearest. A vector's ``cells`` are then those of all the cells that it was in.
    """
    key = ["label", "length", "cell"]
    counts = placed.groupBy(*key).agg(F.count("*").alias("members"))
    large = written(counts.filter(F.col("members") > split * cell).withColumn("blocks", F.ceil(F.col("members") / 50_000).cast("int")), "large")
    if large.isEmpty():
        return placed
    large = F.broadcast(large)  # no more rows than fitted cells
    inside = placed.select(*key, "node", "embedding").join(large, key)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("node")))
    sample = inside.withColumn("nth", nth).filter(F.col("nth") <= SUB_SAMPLE)

    def fit(rows: pa.Table) -> pa.Table:
        x = unit_rows(rows.column("embedding").combine_chunks())
        centres = spherical_kmeans(x, max(1, min(round(rows.column("members")[0].as_py() / cell), len(x) // 4)))
        same = {c: pa.array([rows.column(c)[0].as_py()] * len(centres), rows.schema.field(c).type) for c in (*key, "blocks")}
        return pa.table(same | {"number": pa.array(range(len(centres)), pa.int64()), "centre": pa.array(centres.tolist(), pa.list_(pa.float64()))})

    def near(rows: pa.Table, own: pa.Table) -> pa.Table:
        x, c = unit_rows(rows.column("embedding").combine_chunks()), unit_rows(own.column("centre").combine_chunks())
        p, number = min(probes, len(c)), own.column("number").to_numpy() + 1 + (rows.column("cell")[0].as_py() << 20)
        best = np.concatenate([np.argpartition(-(x[s : s + 4096] @ c.T), p - 1, axis=1)[:, :p] for s in range(0, len(x), 4096)])
        return pa.table({"node": rows.column("node"), "inner": pa.array(number[best].tolist(), pa.list_(pa.int64()))})

    kinds = {f.name: f.dataType.simpleString() for f in inside.schema}
    schema = f"{', '.join(f'{c} {kinds[c]}' for c in key)}, blocks int, number long, centre array<double>"
    centres = written(sample.groupBy(*key).applyInArrow(fit, schema), "centres")
    centres = centres.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = inside.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    inner = dealt.groupBy(*key, "block").cogroup(centres.groupBy(*key, "block")).applyInArrow(near, "node long, inner array<long>")
    others = placed.join(large.select(*key), key, "left_anti").select("node", F.shiftleft(F.col("cell").cast("long"), 20).alias("c"))
    cells = inner.select("node", F.explode("inner").alias("c")).unionByName(others).groupBy("node").agg(F.collect_list("c").alias("cells"))  # probes x probes at most
    rows = distinct.select("label", "embedding", "node", "n").join(cells, "node")
    return rows.withColumn("length", F.size("embedding")).withColumn("cell", F.explode("cells"))


def _compare(threshold: float):
    def run(table_: pa.Table) -> pa.Table:
        cell = table_.column("cell")[0].as_py()
        i, j = table_.column("i")[0].as_py(), table_.column("j")[0].as_py()
        block = table_.column("block").to_numpy()
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        x = unit_rows(table_.column("embedding").combine_chunks())
        n, node = table_.column("n").to_numpy(), table_.column("node").to_numpy()
        cells = table_.column("cells").to_pylist()
        own = np.full((len(cells), max(map(len, cells))), -1, np.int64)
        for row, of in enumerate(cells):
            own[row, : len(of)] = of
        a, b = np.nonzero(x[first] @ x[second].T >= threshold)
        a, b = first[a], second[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        keep = np.ones(len(a), bool)  # a pair counts in the smallest cell that both are in
        for s in range(0, len(a), 1 << 18):
            same = (own[a[s : s + (1 << 18)], :, None] == own[b[s : s + (1 << 18)], None, :]) & (own[a[s : s + (1 << 18)], :, None] >= 0)
            common = np.where(same, own[a[s : s + (1 << 18)], :, None], np.iinfo(np.int64).max).min(axis=(1, 2))
            keep[s : s + (1 << 18)] = common == cell
        a, b = a[keep], b[keep]
        links = np.zeros(len(node), np.int64)
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        root = np.arange(len(node))
        while len(a):  # smallest member by row of each connected part
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        on = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[on]), "other": pa.array(node[root[on]]), "links": pa.array(links[on])})

    return run


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    sample: int = SAMPLE,
    cell: int = CELL,
    probes: int = PROBES,
    block: int = BLOCK,
    split: int = SPLIT,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors (vec_id, embedding, label)``.

    Vectors of one label with a cosine of at least ``threshold`` are linked. Equal vectors of a label are one class
    with a count, so hot copies cost one row. Each class goes to its ``probes`` nearest cells, large cells are cut into
    cells of their own; a cell is dealt to
    blocks of about ``block`` rows and each pair of blocks is one group, which gives link counts and a spanning forest,
    never its pairs. A pair is found where the two share a cell, and counted once. Null labels, null or zero vectors
    and those with null or non-finite parts link with nothing, as do vectors of different lengths. A repeated ``vec_id``
    counts as further rows of the same name; rows without an id link and count as others do, but never name a component
    (null where it has no id at all) and are never kept. An empty table gives none; extra columns are ignored.
    """
    ship(vectors.sparkSession)
    distinct = classes(vectors)
    placed = written(assign(distinct, fit_cells(distinct, sample, cell), probes), "cells")
    finer = refine(distinct, placed, cell, probes, split)
    placed = placed if finer is placed else written(finer, "cells")
    key = ["label", "length", "cell"]
    counts = placed.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = placed.join(counts, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    both = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.select(*key, F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "n", "cells", "embedding")
    found = written(both.groupBy(*key, "i", "j").applyInArrow(_compare(threshold), "node long, other long, links long"), "links")
    groups = connected_components(found, "node", "other")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    each = distinct.join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    each = written(each.select("label", "embedding", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), "component"), "named")
    named = written(each.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "groups")
    each = join_hot(each, named, ["component"], "members").select(F.col("label").alias("l"), F.col("embedding").alias("e"), "n", "links", "component_id")
    rows = vectors.select("vec_id", "label", "embedding")
    usable = join_hot(rows.withColumns({"l": F.col("label"), "e": F.col("embedding")}), each, ["l", "e"], "n")
    told = usable.select("vec_id", (F.col("links") + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    alone = rows.filter(~_usable())
    told = told.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return told.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_kmeans_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
