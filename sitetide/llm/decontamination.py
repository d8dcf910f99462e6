"""Benchmark decontamination: one Aho-Corasick automaton over normalised item windows scans each text once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitetide.session import ship, table, written

WINDOW = 10
#: Characters of distinct windows in one automaton; more windows make more scans, one after the other.
PART_CHARS = 16_000_000
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``window, ids``: the distinct windows of all item texts and the ids (as strings) of the items that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words_of(text)
                for at in range(max(1, len(w) - size + 1) if w else 0):
                    ids.append(item)
                    out.append(b" ".join(w[at : at + size]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], ["id", "window"])

    found = items.select(F.col("item_id").cast("string").alias("id"), "text").mapInArrow(run, "id string, window string")
    return found.groupBy("window").agg(F.collect_set("id").alias("ids"))


def automaton(rows: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for window, ids in rows:
        made.add_word(f" {window} ", (window.count(" ") + 1, tuple(ids)))
    made.make_automaton()
    return made


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple[int, np.ndarray, set[str]]:
    """Words of the text, which of them lie in an occurrence of a window, and the ids of the items concerned."""
    w = words_of(text)
    hit = np.zeros(len(w) + 1, np.int64)
    ids: set[str] = set()
    if w and len(machine):
        hay = " " + b" ".join(w).decode("utf-8", "surrogatepass") + " "
        found = [(end, value) for end, value in machine.iter(hay)]
        if found:
            gaps = np.flatnonzero(np.fromiter((c == " " for c in hay), bool, len(hay)))
            last = np.searchsorted(gaps, [end for end, _ in found])  # words that end before this gap
            for stop, (_, (count, of)) in zip(last.tolist(), found, strict=True):
                hit[stop - count] += 1
                hit[stop] -= 1
                ids.update(of)
    return len(w), np.cumsum(hit)[: len(w)] > 0, ids


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """The hit words' maximal runs as code-point offsets in the original text, end exclusive."""
    out: list[tuple[int, int]] = []
    before = False
    for word, on in zip(_WORD.finditer(text.translate(_LOWER)), hit.tolist(), strict=True):
        if on:
            out.append((out.pop()[0] if before else word.start(), word.end()))
        before = on
    return out


def _scanner(sent, first: bool, at: int, names: tuple[str, str, str]):
    """Adds words, hit words and item ids behind the columns (or unites them with those that stand there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(sent.value)
        for batch in batches:
            count, hits, ids = [], [], []
            for text in batch.column(at):
                n, hit, found = scan(text.as_py(), machine)
                count.append(n)
                hits.append(np.flatnonzero(hit).astype(np.int32))
                ids.append(found)
            own = batch.columns if first else batch.columns[:-3]
            if not first:
                hits = [np.union1d(x, np.array(y, np.int32)) for x, y in zip(hits, batch.column(len(own) + 1).to_pylist(), strict=True)]
                ids = [x.union(y) for x, y in zip(ids, batch.column(len(own) + 2).to_pylist(), strict=True)]
            made = [pa.array(count, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array([sorted(x) for x in ids], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*own, *made], [*batch.schema.names[: len(own)], *names])

    return run


NAMES = ("n_words", "hit", "ids")


def contamination(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, part_chars: int = PART_CHARS, keep: bool = False, names: tuple[str, str, str] = NAMES
) -> DataFrame:
    """``doc_id, text, n_words, hit (word positions), ids (sorted item ids)`` of every row, the last three as ``names``.

    With ``keep`` all columns of ``docs`` stay, but those named like a result. The windows are measured first; each
    automaton is built from at most about ``part_chars`` characters of them, so what is broadcast has a bound, and a
    larger benchmark takes several scans whose hits are united. Null texts and texts without words hit nothing; an item
    with a null id still hits but is not listed; an empty benchmark leaves all documents clean. Repeated rows are judged
    alike.
    """
    spark = docs.sparkSession
    ship(spark)
    found = written(windows(items, size), "windows")
    chars = found.agg(F.sum(F.length("window") + F.coalesce(F.size("ids"), F.lit(0)) * 8)).first()[0] or 0
    parts = max(1, -(-chars // part_chars))
    out = docs.drop(*names) if keep else docs.select("doc_id", "text")
    kinds = (T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()))
    more = [T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True)]
    schema, at = T.StructType([*out.schema.fields, *more]), out.columns.index("text")
    for part in range(parts):
        rows = found.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part).collect()  # about part_chars of text
        sent = spark.sparkContext.broadcast([(r["window"], r["ids"]) for r in rows])
        out = out.mapInArrow(_scanner(sent, part == 0, at, names), schema)
        if part + 1 < parts:
            out = written(out, "scanned")
    return out


def hit_spans(found: DataFrame) -> DataFrame:
    """``doc_id, spans`` (array of start, end in the original text) for the contaminated rows of ``contamination``."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(text, hit):
        out = []
        for t, h in zip(text, hit, strict=True):
            on = np.zeros(len(words_of(t)), bool)
            on[np.asarray(h, np.int64)] = True
            out.append([{"start": s, "end": e} for s, e in spans_of(t, on)])

        return pd.Series(out)

    return found.filter(F.size("hit") > 0).select("doc_id", spans("text", "hit").alias("spans"))


def op6_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )
