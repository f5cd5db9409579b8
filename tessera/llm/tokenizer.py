"""Byte-level BPE encoding of a whole corpus by speculation and verification.

A word (a piece of the public pre-tokenisation pattern) is first cut by greedy
longest match.  Such a proposal equals the merge-by-rank encoding exactly if
every two neighbouring tokens are *compatible*: encoding their concatenation
gives back the same two tokens.  Compatibility of all distinct pairs of a batch
is decided at once over numpy arrays by walking both tokens down their merge
trees.  Only words with an incompatible pair are merged step by step.

Edge cases: null and empty texts have the empty list; a text may be of any
length; strings that look like special tokens are ordinary text; lone
surrogates, which UTF-8 cannot hold, become U+FFFD.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What PATTERN means on ASCII text, in the faster standard engine.
_ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"
CACHE_WORDS = 1_000_000
_OPEN: dict[str, "ByteBPE"] = {}


class ByteBPE:
    """Ranks read from a ``.tiktoken`` file; ids are ranks."""

    def __init__(self, path: str):
        import re

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.longest = max(map(len, self.ranks))
        n = max(self.ranks.values()) + 1
        self.left = np.arange(n, dtype=np.int64)
        self.right = np.arange(n, dtype=np.int64)
        base = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.is_base = np.zeros(n, bool)
        self.is_base[base] = True
        keys, merged = [], []
        for word, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(word) > 1:
                # the last merge that makes a token joins its encoding without it
                a, b = self._exact(word, limit=rank)
                self.left[rank], self.right[rank] = a, b
                keys.append(a * n + b)
                merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.n = n
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int64)[order]
        self.findall = regex.compile(PATTERN).findall
        self.findall_ascii = re.compile(_ASCII, re.ASCII).findall
        self.cache: dict[str, tuple[int, ...]] = {}
        self.compatible: dict[int, bool] = {}
        self.failing = 0

    def _exact(self, word: bytes, limit: int | None = None) -> list[int]:
        """Merging by rank, lowest first; with ``limit`` only ranks below it."""
        ranks = self.ranks
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 64 and limit is None:
            return self._exact_long(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best) and (limit is None or r < limit):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _exact_long(self, parts: list[bytes]) -> list[int]:
        """The same with a heap, for very long words."""
        import heapq

        ranks, n = self.ranks, len(parts)
        nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if live[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i] = a + b
            live[j] = False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (r := ranks.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [ranks[p] for p, on in zip(parts, live) if on]

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], self.n)

    def check_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair whether its tokens may stand side by side."""
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), self.n, np.int64)
        todo = np.arange(len(a))
        while len(todo):
            x, y, lim = a[todo], b[todo], limit[todo]
            bad = self._lookup(x, y) < lim
            good[todo[bad]] = False
            todo, x, y = todo[~bad], x[~bad], y[~bad]
            # the token made later is undone first
            undo_left = x > y
            stuck = np.where(undo_left, self.is_base[x], self.is_base[y])
            other = np.where(undo_left, self.is_base[y], self.is_base[x])
            left_now = undo_left ^ stuck
            limit[todo] = np.where(left_now, x, y + 1)
            a[todo] = np.where(left_now, self.right[x], x)
            b[todo] = np.where(left_now, y, self.left[y])
            todo = todo[~(stuck & other)]
        return good

    def _greedy(self, word: bytes) -> list[int]:
        ranks, out, i, n = self.ranks, [], 0, len(word)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                r = ranks.get(word[i:j])
                if r is not None:
                    out.append(r)
                    i = j
                    break
        return out

    def learn(self, words: list[str]) -> None:
        """Put the encodings of unseen words into the cache."""
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        if len(self.compatible) > CACHE_WORDS:
            self.compatible.clear()
        ranks, proposals = self.ranks, []
        for word in words:
            raw = word.encode("utf-8", "replace") if word.isascii() else word.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()
            whole = ranks.get(raw)
            if whole is not None:
                self.cache[word] = (whole,)
            else:
                proposals.append((word, raw, self._greedy(raw)))
        pairs = {a * self.n + b for _, _, ids in proposals for a, b in zip(ids, ids[1:])} - self.compatible.keys()
        if pairs:
            flat = np.fromiter(pairs, np.int64, len(pairs))
            self.compatible.update(zip(flat.tolist(), self.check_pairs(flat // self.n, flat % self.n).tolist()))
        known, n = self.compatible, self.n
        for word, raw, ids in proposals:
            if not all(known[a * n + b] for a, b in zip(ids, ids[1:])):
                self.failing += 1
                ids = self._exact(raw)
            self.cache[word] = tuple(ids)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [(self.findall_ascii if t.isascii() else self.findall)(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.cache)
        if new:
            self.learn(list(new))
            if not all(w in self.cache for words in cut for w in words):  # the cache was emptied
                self.learn(list(set().union(*cut)))
        get = self.cache.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, words)), np.int32) for words in cut]


def open_bpe(path: str) -> ByteBPE:
    if path not in _OPEN:
        _OPEN[path] = ByteBPE(path)
    return _OPEN[path]


def encode_column(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k", out: str = "ids") -> DataFrame:
    """``key`` and the ids of ``text``: one narrow pass, no shuffle."""
    path = os.path.join(tokenizers, f"{name}.tiktoken")
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = open_bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = bpe.encode_batch(part.column(1).to_pylist())
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, out])

    return df.select(key, text).mapInArrow(run, f"`{key}` {key_type}, `{out}` array<int>")
