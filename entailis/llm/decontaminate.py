"""Benchmark decontamination with an FM-index per training shard.

A shard is a batch of documents.  All of its words form one sequence, over which
an FM-index is built: suffix array by prefix doubling, Burrows-Wheeler transform
in a wavelet matrix, sampled suffix positions.  All benchmark windows of words
that the shard has are searched backwards at once, occurrences are located by
walking to sampled positions, and overlapping occurrences merge into removal
spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entailis.llm.common import LOWER_ASCII, prepare

WINDOW = 13
#: Every how many text positions a suffix position is kept.
SAMPLE = 16
#: Benchmark text of one block, which the driver holds at a time, and blocks that a Python worker keeps.
BLOCK_BYTES = 8 << 20
KEPT_BLOCKS = 16

_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in LOWER_ASCII)


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, the runs of digits, ASCII letters and characters from U+0080 on."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


class WaveletMatrix:
    """Ranks and symbols of a sequence of integers below 2^bits."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.n = bits, len(seq)
        self.packed, self.before, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(np.uint8)
            raw = np.packbits(bit, bitorder="little")
            word = np.zeros(len(raw) // 8 + 2, np.uint64)
            word.view(np.uint8)[: len(raw)] = raw
            self.packed.append(word)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(word), dtype=np.int64)])
            self.zeros.append(self.n - int(bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k][at] + np.bitwise_count(self.packed[k][at] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start, i = np.zeros_like(i), i.copy()
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = self._ones(k, start), self._ones(k, i)
            start, i = np.where(one, self.zeros[k] + a, start - a), np.where(one, self.zeros[k] + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each position, its rank there)."""
        symbol, start, i = np.zeros_like(i), np.zeros_like(i), i.copy()
        for k in range(self.bits):
            one = (self.packed[k][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            symbol = symbol << 1 | one
            a, b = self._ones(k, start), self._ones(k, i)
            start, i = np.where(one, self.zeros[k] + a, start - a), np.where(one, self.zeros[k] + b, i - b)
        return symbol, i - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence whose last symbol is unique, by prefix doubling of unresolved suffixes."""
    n = len(text)
    todo = np.argsort(text, kind="stable")
    first = np.r_[True, text[todo][1:] != text[todo][:-1]]
    rank = np.empty(n, np.int64)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[todo] = start
    alone = first & np.r_[first[1:], True]
    todo, step = todo[~alone], 1
    while todo.size:
        key = rank[todo] * n + rank[todo + step]
        order = np.argsort(key, kind="stable")
        todo, key = todo[order], key[order]
        group, place = key // n, np.arange(len(todo))
        outer = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], place, 0))
        first = np.r_[True, key[1:] != key[:-1]]
        rank[todo] = group + np.maximum.accumulate(np.where(first, place, 0)) - outer
        todo = todo[~(first & np.r_[first[1:], True])]
        step *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


class FMIndex:
    """Backward search in a sequence of runs; symbols from 1 on, each run ends with a 0."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = SAMPLE):
        n, ends = len(text), np.flatnonzero(text == 0)
        order = text + len(ends) - 1
        order[ends] = np.arange(len(ends))  # each run's end is a symbol of its own, below all words
        sa = suffix_array(order)
        self.n, self.sample = n, sample
        bwt = text[sa - 1]
        self.wavelet = WaveletMatrix(bwt, max(1, int(alphabet).bit_length()))
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=alphabet + 1))]
        held = (sa % sample == 0) | (bwt == 0)  # a run's start is sampled, so no walk leaves its run
        self.held, self.position = held, np.where(held, sa, -1)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of patterns, right-aligned in the rows of a matrix."""
        m = patterns.shape[1]
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for t in range(m):
            live = live[(lengths[live] > t) & (low[live] < high[live])]
            if not live.size:
                break
            c = patterns[live, m - 1 - t]
            low[live], high[live] = self.below[c] + self.wavelet.rank(c, low[live]), self.below[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        out, rows, walked = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while live.size:
            done = self.held[rows[live]]
            out[live[done]] = self.position[rows[live[done]]] + walked[live[done]]
            live = live[~done]
            if live.size:
                c, rank = self.wavelet.access(rows[live])
                rows[live] = self.below[c] + rank
                walked[live] += 1
        return out


def sorted_items(items: set[str | None]) -> list[str | None]:
    """Ids in order, a null one last."""
    return sorted(items, key=lambda i: (i is None, i or ""))


class Phrases:
    """The words of benchmark items as one sequence of numbers: every window is a range of it, so nothing is larger than the texts."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window, vocab = window, {}
        self.items = sorted_items({i for i, _ in items})
        at = {i: k for k, i in enumerate(self.items)}
        flat, sizes, owners = [], [], []
        for item, text in sorted({(i, t) for i, t in items}, key=repr):
            ids = [vocab.setdefault(w, len(vocab)) for w in words(text)]
            if ids:
                flat.append(np.array(ids, np.int32))
                sizes.append(len(ids))
                owners.append(at[item])
        self.vocab = list(vocab)
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        self.sizes, self.owners = np.array(sizes, np.int64), np.array(owners, np.int64)

    def patterns(self, ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows of words that ids has, as its numbers, right-aligned; their lengths; the item of each)."""
        number = np.fromiter((ids.get(w, 0) for w in self.vocab), np.int64, len(self.vocab))
        seq = number[self.flat] if len(self.flat) else np.zeros(0, np.int64)
        many = np.maximum(1, self.sizes - self.window + 1)  # windows of each item
        begin = np.repeat(np.cumsum(self.sizes) - self.sizes, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        length, owner = np.repeat(np.minimum(self.sizes, self.window), many), np.repeat(self.owners, many)
        unknown = np.r_[0, np.cumsum(seq == 0)]
        fine = unknown[begin + length] == unknown[begin]
        begin, length, owner = begin[fine], length[fine], owner[fine]
        place = (begin + length)[:, None] + np.arange(-self.window, 0)
        return np.where(place >= begin[:, None], seq[np.maximum(place, 0)], 0) if len(begin) else np.zeros((0, self.window), np.int64), length, owner


class Shard:
    """The index of a batch of whole texts: every word of every text, equal texts once."""

    def __init__(self, texts: list[str | None]):
        docs = [words(t) for t in texts]
        self.sizes = np.array([len(d) for d in docs], np.int64)
        first: dict[str, int] = {}
        self.like = [first.setdefault(t, k) if t else k for k, t in enumerate(texts)]
        self.own = [k for k, w in enumerate(self.like) if w == k and self.sizes[k]]
        self.ids: dict[bytes, int] = {}
        number, n = self.ids.setdefault, int(self.sizes[self.own].sum()) + len(self.own)
        end = [None]
        # A 0 after each text: no occurrence goes beyond it.
        flat = np.fromiter((0 if w is None else number(w, len(self.ids) + 1) for k in self.own for w in (*docs[k], *end)), np.int64, n)
        self.starts, self.length = np.r_[0, np.cumsum(self.sizes[self.own] + 1)].astype(np.int64), n
        self.index = FMIndex(flat, len(self.ids)) if n else None

    def scan(self, blocks: Iterable[Phrases]) -> list[tuple[int, list[tuple[int, int]], list[str | None]]]:
        """(number of words, merged spans of hit words, sorted items) of each text, over all blocks of the benchmark."""
        spans: list[list[tuple[int, int]]] = [[] for _ in self.like]
        items: list[set[str | None]] = [set() for _ in self.like]
        change = np.zeros(self.length + 1, np.int64)
        for block in blocks if self.index is not None else ():
            self._find(block, change, items)
        covered = np.diff(np.r_[0, (np.cumsum(change[:-1]) > 0).astype(np.int8), 0])
        first, last = np.flatnonzero(covered > 0), np.flatnonzero(covered < 0)
        doc = np.searchsorted(self.starts, first, "right") - 1
        for d, a, b in zip(doc.tolist(), (first - self.starts[doc]).tolist(), (last - self.starts[doc]).tolist(), strict=True):
            spans[self.own[d]].append((a, b))
        return [(int(n), spans[w], sorted_items(items[w])) for n, w in zip(self.sizes, self.like, strict=True)]

    def _find(self, block: Phrases, change: np.ndarray, items: list[set[str | None]]) -> None:
        patterns, lengths, owners = block.patterns(self.ids)
        low, high = self.index.search(patterns, lengths)
        hit = np.flatnonzero(low < high)
        if not hit.size:
            return
        many = (high - low)[hit]
        rows = np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pattern, at = np.repeat(hit, many), self.index.locate(rows)
        np.add.at(change, at, 1)
        np.add.at(change, at + lengths[pattern], -1)
        pairs = np.unique((np.searchsorted(self.starts, at, "right") - 1) * len(block.items) + owners[pattern])
        for d, i in zip((pairs // len(block.items)).tolist(), (pairs % len(block.items)).tolist(), strict=True):
            items[self.own[d]].add(block.items[i])


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Column:
    """A column struct(n_words, spans, items, unnamed) for the whole texts of docs.

    spans: half-open ranges of hit words, merged; items: ids, as sorted strings,
    of the items with an occurring window (``window`` consecutive words, or all
    words of a shorter item).  A null text or one without words has no words;
    items without words have no window; rows with a null id are one item that
    is not in items: its windows hit as all others do, and unnamed says whether
    one occurs (op8_decontaminate counts it in n_items, as OP8_SQL does);
    repeated items and rows count as one and as often as they occur.

    The benchmark is read in blocks of about block_bytes, one on the driver at a
    time; each goes to the executors as an array of word numbers.  A shard is
    indexed once and searched for every block in turn; a Python worker keeps
    KEPT_BLOCKS of them and reads the others again from its local copy.
    """
    spark = docs.sparkSession
    prepare(spark)
    bench = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    total = bench.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    shared = []
    for b in range(blocks):
        held = (bench.where(F.pmod(F.xxhash64("text", "item"), F.lit(blocks)) == b) if blocks > 1 else bench).collect()
        shared.append(spark.sparkContext.broadcast(Phrases([(r["item"], r["text"]) for r in held], window)))
    return _scanner(shared)(F.col(text).cast("string"))


_FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>, unnamed boolean"


def _in_turn(shared: list) -> Iterator[Phrases]:
    for k, block in enumerate(shared):
        yield block.value
        if k >= KEPT_BLOCKS:
            block.__dict__.pop("_value", None)  # read again when it is next asked for


def _scanner(shared: list):
    @F.pandas_udf(_FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        got = Shard([t if isinstance(t, str) else None for t in texts]).scan(_in_turn(shared))
        return pd.DataFrame({"n_words": [n for n, _, _ in got], "spans": [[{"start": a, "end": e} for a, e in s] for _, s, _ in got], "items": [[x for x in i if x is not None] for _, _, i in got], "unnamed": [None in i for _, _, i in got]})

    return scan


def n_hit(found: str) -> Column:
    """The number of hit words of a column made by contamination()."""
    return F.aggregate(F.col(f"{found}.spans"), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def is_contaminated(n_words: Column, hit: Column) -> Column:
    """Whether hit words make up a twentieth of the words or more."""
    return (hit > 0) & (20 * hit >= n_words)
