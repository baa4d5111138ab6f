"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols sit in the leaves of a segment tree; leaf ``i`` holds the merge
rank of the pair that starts at symbol ``i``.  The root yields the lowest rank,
its leftmost leaf the place.  A merge changes three leaves, each in logarithmic
time, until no pair can be merged.  Words of common length are merged together
in numpy, one tree per row of a matrix; long words have a tree of their own.

Vocabularies are read from a tokenizer JSON file on each executor; none is
trained here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entailis.llm.common import prepare

#: The split of byte-level BPE before merges, as published with the vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int64(2**62)
#: Words of more bytes than this get a tree of their own.
LONG = 64
#: Most words whose ids are kept in a Python worker; the store is emptied when it is full.
CACHE_WORDS = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def unsupported(spec: dict) -> list[str]:
    """What a tokenizer file asks for that this encoder does not do; truncation, padding and post-processors are never applied."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    found = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    found += ["model type"] if model.get("type", "BPE") != "BPE" else []
    found += ["normalizer"] if spec.get("normalizer") else []
    found += ["pre-tokenizer"] if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) else []
    found += ["decoder"] if (spec.get("decoder") or {}).get("type") != "ByteLevel" else []
    return found + [f"added token {t['content']!r}" for t in spec["added_tokens"] if any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized"))]


class SegmentTree:
    """Minimum over leaves, with the leftmost leaf of the minimum."""

    def __init__(self, leaves: list[int]):
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.tree = [int(NONE)] * self.size + leaves + [int(NONE)] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def least(self) -> tuple[int, int]:
        """(minimum, its leftmost leaf)."""
        tree, i = self.tree, 1
        while i < self.size:
            i *= 2
            if tree[i] > tree[i + 1]:
                i += 1
        return tree[1], i - self.size

    def put(self, leaf: int, value: int) -> None:
        tree, i = self.tree, leaf + self.size
        tree[i] = value
        while i > 1:
            i >>= 1
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                break
            tree[i] = least


class ByteBPE:
    """A byte-level BPE vocabulary: ``encode`` and ``decode``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if unread := unsupported(spec):
            raise ValueError(f"{path}: not a plain byte-level BPE: {', '.join(unread)}")
        alphabet = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        top = max([*vocab.values(), *added.values()])
        self.pieces = [b""] * (top + 1)
        for token, i in vocab.items():
            self.pieces[i] = bytes(alphabet[c] for c in token)
        for token, i in added.items():
            self.pieces[i] = token.encode()
        self.added = added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.find = regex.compile(PATTERN).findall
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        self.base = top + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        # Ranks in an open-addressed table, looked up by whole arrays.
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        self.made = made
        for rank, key in enumerate(keys.tolist()):
            i = self._slot(key)
            while self.slots[i] not in (-1, key):
                i = (i + 1) & ((1 << self.bits) - 1)
            if self.slots[i] == -1:
                self.slots[i], self.ranks[i] = key, rank
        self.cache: dict[str, bytes] = {}

    def _slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> (64 - self.bits)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; NONE where a side is missing (-1) or no merge exists."""
        key = left * self.base + right
        i = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.slots[i]
        out = np.where(held == key, self.ranks[i], NONE)
        open_ = np.flatnonzero((held != key) & (held != -1))
        while open_.size:
            i[open_] = (i[open_] + 1) & ((1 << self.bits) - 1)
            held = self.slots[i[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.ranks[i[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out

    def _merge_long(self, word: bytes) -> bytes:
        """The ids of one word by its own segment tree."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        symbols, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = SegmentTree([*self._rank(ids[:-1], ids[1:]).tolist(), int(NONE)])
        one = lambda a, b: int(self._rank(np.array([a]), np.array([b]))[0])
        while True:
            rank, i = tree.least()
            if rank >= NONE:
                break
            j = after[i]
            symbols[i], symbols[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            tree.put(j, int(NONE))
            tree.put(i, one(symbols[i], symbols[after[i]]) if after[i] < n else int(NONE))
            if before[i] >= 0:
                tree.put(before[i], one(symbols[before[i]], symbols[i]))
        return np.array([s for s in symbols if s >= 0], np.int32).tobytes()

    def _merge_many(self, words: list[bytes], width: int) -> list[bytes]:
        """The ids of words of at most ``width`` bytes (a power of two), a segment tree per row."""
        n = len(words)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        length = np.fromiter(map(len, words), np.int64, n)
        place = np.arange(width)
        symbols = np.where(place < length[:, None], self.byte_ids[flat], -1)
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, np.int64)
        tree[:, width : 2 * width - 1] = self._rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1)
        step = width
        while step > 1:
            tree[:, step // 2 : step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
            step //= 2

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + width
            tree[rows, node] = value
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def at(rows: np.ndarray, spot: np.ndarray) -> np.ndarray:
            return np.where((spot >= 0) & (spot < width), symbols[rows, np.clip(spot, 0, width - 1)], -1)

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while rows.size:
            node = np.ones(rows.size, np.int64)
            for _ in range(width.bit_length() - 1):
                node = 2 * node + (tree[rows, 2 * node] > tree[rows, 2 * node + 1])
            i = node - width
            j = after[rows, i]
            symbols[rows, i] = self.made[tree[rows, 1]]
            symbols[rows, j] = -1
            then = after[rows, j]
            after[rows, i] = then
            ahead = then < width
            before[rows[ahead], then[ahead]] = i[ahead]
            prior = before[rows, i]
            new = symbols[rows, i]
            put(rows, j, np.full(rows.size, NONE))
            put(rows, i, self._rank(new, at(rows, then)))
            held = prior >= 0
            put(rows[held], prior[held], self._rank(at(rows[held], prior[held]), new[held]))
            rows = rows[tree[rows, 1] < NONE]
        kept = symbols >= 0
        ids, ends = symbols[kept].astype(np.int32).tobytes(), np.cumsum(kept.sum(1)) * 4
        out, start = [], 0
        for end in ends.tolist():
            out.append(ids[start:end])
            start = end
        return out

    def _learn(self, words: set[str]) -> None:
        """Put the ids of these words into the cache."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            if len(b) > LONG:
                self.cache[w] = self._merge_long(b)
            else:
                by_width.setdefault(1 << max(1, (len(b) - 1).bit_length()), []).append((w, b))
        for width, of in by_width.items():
            for k in range(0, len(of), 4096):
                part = of[k : k + 4096]
                self.cache.update(zip((w for w, _ in part), self._merge_many([b for _, b in part], width), strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split = []
        for t in texts:
            if self.split_added and self.split_added.search(t):
                split.append([(x, [] if x in self.added else self.find(x)) for x in self.split_added.split(t) if x])
            else:
                split.append([("", self.find(t))])
        cache = self.cache
        missing = {w for parts in split for _, words in parts for w in words if w not in cache}
        if missing:
            self._learn(missing)
        out = []
        for parts in split:
            ids = []
            for x, words in parts:
                ids.extend(map(cache.__getitem__, words)) if x not in self.added else ids.append(np.int32(self.added[x]).tobytes())
            out.append(b"".join(ids))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """One vocabulary per Python worker and path."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every whole text and the text decoded from them.

    docs: any columns; only ``key`` and ``text`` are read, so other columns and
    their names do not matter.  Returns (key, ids array<int>, decoded string),
    one row for each input row: repeated rows stay repeated, a null or empty
    text has no ids and decodes to the empty string, an empty table gives an
    empty table.  path: a tokenizer JSON file present on every executor.
    Memory: a batch of rows, its ids, and at most CACHE_WORDS words.
    """
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = bpe.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            decoded = [bpe.decode(np.frombuffer(x, np.int32).tolist()) for x in ids]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists, pa.array(decoded, pa.string())], ["key", "ids", "decoded"])

    return narrow.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)
