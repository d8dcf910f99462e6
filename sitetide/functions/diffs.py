"""Line differences as data: the opcodes of two versions of a page, and what is read from them by column expressions."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitetide.functions.noise import normalize, strip_rotating
from sitetide.session import free_name

CONTEXT = 3
MAX_ROWS = 400
UNIFIED_CONTEXT = 2
OPCODES = "struct<a:array<string>,b:array<string>,ops:array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>>"
#: The heads of a unified difference.
HEADS = ("--- было", "+++ стало")

#: What of a text is compared: without noise, without rotating blocks, or its lines with words.
LINES = {
    "normal": lambda x: (normalize(x) or "").splitlines(),
    "stripped": lambda x: strip_rotating(x or "").splitlines(),
    "worded": lambda x: [line for line in (x or "").splitlines() if line.strip()],
}


def opcodes(kind: str):
    """A function of two columns: the compared lines ``a`` and ``b`` and the opcodes between them, in order."""

    @F.pandas_udf(OPCODES)
    def found(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = ("tag", "i1", "i2", "j1", "j2")
        for olds, news in pairs:
            rows = []
            for old, new in zip(olds, news, strict=True):
                a, b = LINES[kind](old), LINES[kind](new)
                rows.append((a, b, [dict(zip(names, op, strict=True)) for op in difflib.SequenceMatcher(None, a, b).get_opcodes()]))
            yield pd.DataFrame(rows, columns=["a", "b", "ops"])

    return found


def _part(lines: Column, start: Column, end: Column) -> Column:
    return F.slice(lines, start + 1, end - start)


def _marked(lines: Column, start: Column, end: Column, mark: str) -> Column:
    return F.transform(_part(lines, start, end), lambda x: F.concat(F.lit(mark), x))


def change_runs(d: Column) -> Column:
    """Runs of changed lines: those removed (``-``), then those added (``+``)."""
    changed = F.filter(d["ops"], lambda o: o["tag"] != "equal")
    return F.transform(changed, lambda o: F.concat(_marked(d["a"], o["i1"], o["i2"], "-"), _marked(d["b"], o["j1"], o["j2"], "+")))


def with_hunks(rows: DataFrame, d: str, name: str = "hunks", context: int = UNIFIED_CONTEXT) -> DataFrame:
    """``rows`` and, of the opcodes in the column ``d``, ``i1, i2, j1, j2, lines`` of each island of changes.

    Changes with at most twice ``context`` equal lines between them belong together, and each island has ``context`` equal
    lines around it where there are so many. Changed opcodes, the first of each island and the islands are columns one
    after the other, so each is worked out once a page.
    """
    changed, heads = free_name("changed", rows), free_name("heads", rows)
    a, b, ops = (F.col(f"`{d}`.{c}") for c in ("a", "b", "ops"))
    numbered = F.filter(F.transform(ops, lambda o, k: F.struct(o.alias("o"), k.alias("k"))), lambda x: x["o"]["tag"] != "equal")

    def begins(c: Column, k: Column) -> Column:
        gap = c["o"]["i1"] - F.get(F.col(changed), k - 1)["o"]["i2"]
        return F.when((k == 0) | (gap > 2 * context), k)

    def said(o: Column) -> Column:
        both = F.concat(_marked(a, o["i1"], o["i2"], "-"), _marked(b, o["j1"], o["j2"], "+"))
        return F.when(o["tag"] == "equal", _marked(a, o["i1"], o["i2"], " ")).otherwise(both)

    def island(h: Column, m: Column) -> Column:
        first = F.get(F.col(changed), h)
        last = F.get(F.col(changed), F.coalesce(F.get(F.col(heads), m + 1), F.size(changed)) - 1)
        before, after = F.least(F.lit(context), first["o"]["i1"]), F.least(F.lit(context), F.size(a) - last["o"]["i2"])
        lines = F.concat(
            _marked(a, first["o"]["i1"] - before, first["o"]["i1"], " "),
            F.flatten(F.transform(F.slice(ops, first["k"] + 1, last["k"] - first["k"] + 1), said)),
            _marked(a, last["o"]["i2"], last["o"]["i2"] + after, " "),
        )
        ends = {"i1": first["o"]["i1"] - before, "i2": last["o"]["i2"] + after, "j1": first["o"]["j1"] - before, "j2": last["o"]["j2"] + after, "lines": lines}
        return F.struct(*[x.alias(c) for c, x in ends.items()])

    made = rows.withColumn(changed, numbered)
    made = made.withColumn(heads, F.filter(F.transform(changed, begins), lambda k: k.isNotNull()))
    return made.withColumn(name, F.transform(heads, island)).drop(changed, heads)


def _range(start: Column, end: Column) -> Column:
    """Line numbers from 1; one line goes without a length, and no line is named by the line before it."""
    n = end - start
    return F.when(n == 1, (start + 1).cast("string")).otherwise(F.concat_ws(",", F.when(n == 0, start).otherwise(start + 1).cast("string"), n.cast("string")))


def unified(found: Column) -> Column:
    """The text of a unified difference from its ``hunks``; empty where there are none."""

    def one(h: Column) -> Column:
        head = F.concat(F.lit("@@ -"), _range(h["i1"], h["i2"]), F.lit(" +"), _range(h["j1"], h["j2"]), F.lit(" @@"))
        return F.concat(F.array(head), h["lines"])

    text = F.array_join(F.concat(F.array(*[F.lit(x) for x in HEADS]), F.flatten(F.transform(found, one))), "\n")
    return F.when(F.size(found) == 0, "").otherwise(text)


def side_by_side(d: Column, context: int = CONTEXT, limit: int = MAX_ROWS) -> Column:
    """``old_line, new_line, kind, skipped`` rows; equal lines far from a change collapse into one ``skip`` row."""
    none = F.lit(None).cast("string")

    def row(left: Column, right: Column, kind: Column, skipped: Column) -> Column:
        return F.struct(left.alias("old_line"), right.alias("new_line"), kind.alias("kind"), skipped.cast("int").alias("skipped"))

    def same(o: Column, start: Column, n: Column) -> Column:
        left, right = F.slice(d["a"], o["i1"] + start + 1, n), F.slice(d["b"], o["j1"] + start + 1, n)
        return F.zip_with(left, right, lambda x, y: row(x, y, F.lit("equal"), F.lit(0)))

    def changed(o: Column) -> Column:
        def one(x: Column, y: Column) -> Column:
            kind = F.when(x.isNull(), "added").when(y.isNull(), "removed").otherwise("changed")
            return row(x, y, kind, F.lit(0))

        return F.zip_with(_part(d["a"], o["i1"], o["i2"]), _part(d["b"], o["j1"], o["j2"]), one)

    def equal(o: Column, k: Column) -> Column:
        n = o["i2"] - o["i1"]
        head, tail = F.when(k > 0, context).otherwise(0), F.when(k < F.size(d["ops"]) - 1, context).otherwise(0)
        hidden = n - head - tail
        folded = F.concat(same(o, F.lit(0), F.greatest(head, F.lit(0))), F.array(row(none, none, F.lit("skip"), hidden)), same(o, n - tail, tail))
        return F.when(hidden <= 0, same(o, F.lit(0), n)).otherwise(folded)

    rows = F.flatten(F.transform(d["ops"], lambda o, k: F.when(o["tag"] == "equal", equal(o, k)).otherwise(changed(o))))
    return F.slice(rows, 1, limit)
