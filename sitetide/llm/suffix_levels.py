"""Suffix-array dedup of byte windows: new batches get suffix arrays, are merge-scanned against the levels of a family,
and levels of about equal size merge."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sitetide.llm.repeats import Block, Kind, covered, earlier_windows, groups_of
from sitetide.session import table

WINDOW = 100
ANCHOR = 20
#: Bytes of text of one family, suffixes of one new batch, and suffixes whose bytes are looked at together in a scan.
FAMILY_BYTES = 4 << 20
BATCH = 1 << 19
SCAN = 1 << 14


class Family:
    """Suffix arrays of geometrically growing size over parts of one text: numbers of suffixes, in the order of their
    first ``length`` bytes, each distinct one once. The bytes themselves stand in the text alone."""

    def __init__(self, text: np.ndarray, length: int):
        self.rows, self.kind = np.lib.stride_tricks.sliding_window_view(text, length), f"S{length}"
        self.levels: list[np.ndarray] = []

    def bytes_of(self, suffixes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.rows[suffixes]).view(self.kind).ravel()

    def suffix_array(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in order, equal ones by place, and which equal the one before."""
        keys = self.bytes_of(suffixes)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        return suffixes[order], np.concatenate((np.zeros(min(1, len(keys)), bool), keys[1:] == keys[:-1]))

    def scan(self, level: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walk a level and a new suffix array together, stretch by stretch: which new suffixes the level holds, and how
        many of the level come before each."""
        held, before, at = np.zeros(len(new), bool), np.full(len(new), len(level)), 0
        for start in range(0, len(level), SCAN):
            known = self.bytes_of(level[start : start + SCAN])
            while at < len(new):
                keys = self.bytes_of(new[at : at + SCAN])
                reach = int(np.searchsorted(keys, known[-1], "right"))  # new ones that this stretch decides
                where = np.searchsorted(known, keys[:reach])
                held[at : at + reach] = known[where] == keys[:reach]
                before[at : at + reach] = start + where
                at += reach
                if reach < len(keys):
                    break
        return held, before

    def add(self, new: np.ndarray, before: list[np.ndarray]) -> None:
        """A new level of suffixes that no level holds; as long as the last level is of about its size, they merge by
        their places in it, which the scan has told."""
        while self.levels and len(self.levels[-1]) <= 2 * len(new):
            level, places = self.levels.pop(), before.pop()
            if len(places) != len(new):  # merged before: walk again
                places = self.scan(level, new)[1]
            merged = np.empty(len(level) + len(new), np.int64)
            mine = np.arange(len(new)) + places
            theirs = np.ones(len(merged), bool)
            theirs[mine] = False
            merged[mine], merged[theirs] = new, level
            new = merged
        if len(new):
            self.levels.append(new)


def earlier_bytes(texts: list[bytes], route: np.ndarray, doc: np.ndarray, place: np.ndarray, kind: Kind) -> list[np.ndarray]:
    """For each text, which of its windows also start at an earlier place (document, then offset).

    Windows enter in the order of their places, in batches: each batch gets a suffix array, repeats inside it and what
    the merge scans find in the levels are marked, and what is new joins the family.
    """
    bits: list[np.ndarray] = [np.empty(0, bool)] * len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    for group in groups_of(route, sizes, FAMILY_BYTES):
        group = group[np.lexsort((place[group], doc[group]))]
        n = sizes[group]
        text = np.frombuffer(b"".join([texts[k] for k in group.tolist()]), np.uint8)
        first = np.cumsum(n) - n
        windows = n - kind.length + 1
        start = np.arange(int(windows.sum())) + np.repeat(first - (np.cumsum(windows) - windows), windows)
        flag, family = np.zeros(len(text), bool), Family(text, kind.length)
        for at in range(0, len(start), BATCH):
            batch, again = family.suffix_array(start[at : at + BATCH])
            scans = [family.scan(level, batch) for level in family.levels]
            old = np.logical_or.reduce([again, *[held for held, _ in scans]])
            flag[batch[old]] = True
            family.add(batch[~old], [before[~old] for _, before in scans])
        for k, s, e in zip(group.tolist(), first.tolist(), (first + windows).tolist(), strict=True):
            bits[k] = flag[s:e]
    return bits


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` and the kept bytes (``kept``, or ``kept_sha256``) of every row.

    A byte of the UTF-8 text goes when a string of ``window`` bytes that covers it also starts earlier: in a document
    with a smaller id, or earlier in the same one. Null and empty texts have none; a long text is whole; rows with a null
    id are later than all others and, like repeated rows of one id, no document is earlier than another of them. An empty
    table gives none; extra columns are ignored, whatever their names.
    """
    kind = Kind(False, window, anchor, True)

    def finish(block: Block, starts: np.ndarray) -> dict:
        gone = covered(len(block.data), starts, block.kind.length)
        counts, kept = [], []
        for s, e in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True):
            off = gone[s:e]
            edges = int(np.diff(off.astype(np.int8), prepend=0).clip(0).sum())
            counts.append((e - s, int(off.sum()), edges))
            kept.append(block.data[s:e][~off].tobytes())
        cols = np.array(counts, np.int64).reshape(-1, 3)
        out = {"doc_id": block.ids} | {c: pa.array(cols[:, k]) for k, c in enumerate(("n_bytes", "n_removed", "n_spans"))}
        if digest:
            return out | {"kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        return out | {"kept": pa.array(kept, pa.binary())}

    last = "kept_sha256 string" if digest else "kept binary"
    return earlier_windows(docs, kind, earlier_bytes, finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


def op4_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), digest=True)
