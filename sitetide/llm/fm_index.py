"""Substring dedup of word windows: a compressed FM-index for each shard, searched backwards over wavelet levels."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sitetide.llm.repeats import Block, Kind, covered, earlier_windows, groups_of
from sitetide.session import table

WINDOW = 13
ANCHOR = 6
#: Words of one index.
INDEX_WORDS = 1 << 18


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols at least, by doubling ranks."""
    _, rank = np.unique(text, return_inverse=True)
    done, most = 1, int(rank.max(initial=0)) + 1
    while done < depth and most < len(text):
        after = np.zeros(len(text), np.int64)
        after[: len(text) - done] = rank[done:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (most + 1) + after, return_inverse=True)
        most, done = int(rank.max()) + 1, 2 * done
    return np.argsort(rank, kind="stable")


class Wavelet:
    """A wavelet matrix: for each bit of the symbols a packed bit vector with counts at every 64th place."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (values >> shift) & 1
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))[:-1].astype(np.int32)
            zeros = int(len(bit) - bit.sum())
            self.levels.append((shift, words, before, zeros))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before its place; ``starts`` has each symbol's place in the last level."""
        for shift, words, before, zeros in self.levels:
            ones = before[place >> 6] + np.bitwise_count(words[place >> 6] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            place = np.where((symbol >> shift) & 1, zeros + ones, place - ones)
        return place - starts[symbol]


class FMIndex:
    """Backward search over texts that end in symbol 0, whose suffixes are ordered by ``depth`` symbols at least.

    The suffix array is not kept: there are packed wavelet levels, and of the texts' documents the least of each run of
    suffixes whose length is a power of two, as numbers of 16 bits where they fit, else of 32.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int):
        sa = suffix_array(text, depth)
        last = text[sa - 1]
        count = np.bincount(text)
        self.size, self.less = len(text), np.cumsum(count) - count
        bits = max(1, int(len(count) - 1).bit_length())
        self.wavelet = Wavelet(last.astype(np.int64), bits)
        symbols = np.arange(len(count))
        key = np.zeros(len(count), np.int64)  # order of the last level: by reversed bits
        for b in range(bits):
            key |= ((symbols >> b) & 1) << (bits - 1 - b)
        order = np.argsort(key)
        self.starts = np.empty(len(count), np.int64)
        self.starts[order] = np.cumsum(count[order]) - count[order]
        small = np.uint16 if int(owner.max(initial=0)) < 1 << 16 else np.uint32
        self.least = [owner[sa].astype(small)]
        while 2 ** len(self.least) <= len(text):
            low = self.least[-1]
            half = 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(low[: len(low) - half], low[half:]))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with a symbol and then what the given ranges begin with."""
        both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)), self.starts)
        return self.less[symbol] + both[: len(symbol)], self.less[symbol] + both[len(symbol) :]

    def first_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner of each range that is not empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.least[0].dtype)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - 2**k])
        return out

    def matching_statistics(self, text: np.ndarray, begin: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each place of streamed symbols, the length of the longest stretch that ends there, does not reach before
        ``begin``, and stands in a text of an owner before ``own``."""
        low, high = np.zeros(len(text), np.int64), np.full(len(text), self.size)
        length, on, step = np.zeros(len(text), np.int64), np.arange(len(text)), 0
        while len(on):
            on = on[on - step >= begin[on]]
            a, b = self.extend(text[on - step], low[on], high[on])
            some = b > a
            on, a, b = on[some], a[some], b[some]
            earlier = self.first_owner(a, b) < own[on]
            on = on[earlier]
            low[on], high[on] = a[earlier], b[earlier]
            step += 1
            length[on] = step
        return length


def earlier_words(texts: list[bytes], route: np.ndarray, doc: np.ndarray, place: np.ndarray, kind: Kind) -> list[np.ndarray]:
    """For each text, which of its windows also occur in a text whose first document is smaller.

    The texts of a shard are indexed in groups of bounded size that keep an anchor's texts together. Then they are
    streamed: matching statistics against the texts of earlier documents, and every window that ends where they reach
    the threshold is reported. An equal text of a later document needs no search of its own, as all of it is earlier.
    """
    bits: list[np.ndarray] = [np.empty(0, bool)] * len(texts)
    split = [t.split(b" ") for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    for group in groups_of(route, sizes + 1, INDEX_WORDS):
        words = [w for k in group.tolist() for w in (*split[k], b"")]
        coded = pa.array(words, pa.binary()).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        end = coded.dictionary.to_pylist().index(b"")
        text = np.where(code == end, 0, np.where(code < end, code + 1, code))  # 0 ends a text
        n = sizes[group]
        first = np.cumsum(n + 1) - (n + 1)
        owner = np.repeat(np.unique(doc[group], return_inverse=True)[1], n + 1)
        begin = np.repeat(first, n + 1)
        begin[first + n] = len(text)  # no stretch ends at the end of a text
        found = FMIndex(text, owner, int(n.max(initial=1))).matching_statistics(text, begin, owner) >= kind.length
        for k, s, e in zip(group.tolist(), (first + kind.length - 1).tolist(), (first + n).tolist(), strict=True):
            bits[k] = found[s:e]
    return bits


def _finish(block: Block, starts: np.ndarray) -> dict:
    gone = covered(len(block.hash), starts, block.kind.length)
    raw, out = block.data.tobytes(), {"doc_id": block.ids, "n_words": [], "n_removed": [], "kept": []}
    for s, e in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True):
        off = gone[s:e]
        out["n_words"].append(e - s)
        out["n_removed"].append(int(off.sum()))
        if not off.any():
            kept = raw[block.begin[s] : block.end[e - 1]] if e > s else b""
        else:
            kept = b" ".join(raw[block.begin[k] : block.end[k]] for k in (np.flatnonzero(~off) + s).tolist())
        out["kept"].append(kept)
    return out | {"n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept": pa.array(out["kept"], pa.binary())}


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed`` and the kept words (``kept_text``, or ``kept_sha256``) of every row.

    A word goes when a window of ``window`` words that covers it also starts in a document with a smaller id. Words are
    runs of characters other than ASCII white space. Null and empty texts have no words; a long text is whole; rows with
    a null id are later than all others and never remove each other's words, nor do repeated rows of one id. An empty
    table gives none; extra columns are ignored, whatever their names.
    """
    kind = Kind(True, window, anchor, False)

    def finish(block: Block, starts: np.ndarray) -> dict:
        out = _finish(block, starts)
        kept = out.pop("kept").to_pylist()
        if digest:
            return out | {"kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        return out | {"kept_text": pa.array([x.decode("utf-8") for x in kept], pa.string())}

    last = "kept_sha256" if digest else "kept_text"
    return earlier_windows(docs, kind, earlier_words, finish, f"doc_id long, n_words long, n_removed long, {last} string")


def op1_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"), digest=True)
