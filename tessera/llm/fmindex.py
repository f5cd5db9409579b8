"""Evaluation texts leaking into training text: an FM-index per training shard.

Each task gathers its documents into shards of a bounded number of words, turns
them into word ids and builds an FM-index over the shard: suffix order by prefix
doubling, the Burrows-Wheeler transform in a wavelet matrix whose ranks drive
the backward search, and suffix positions sampled for locating.  All phrases of
``min_words`` consecutive words of the test items are searched at once, block by
block; every hit is located, mapped back to its document and merged into spans.

The index holds every word of every document; words that occur in no test item
are one symbol, which no phrase holds.

A word is a run of letters and digits; case, compatibility forms and invisible
characters inside it do not matter, everything between words is ignored.

Edge cases: null, empty and wordless texts have no rows; items of fewer than
``min_words`` words cannot leak; repeated rows give one result; a test set is
sent to the tasks only below ``ITEMS_LIMIT`` characters, beyond that the search
runs over parts of the test set, each below the limit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
SHARD_WORDS = 1_000_000
BLOCK = 65_536
SAMPLE = 16
ITEMS_LIMIT = 32_000_000
_INNER = "­​-‍⁠﻿"
WORD = re.compile(rf"[^\W_]+(?:[{_INNER}]+[^\W_]+)*")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


@lru_cache(maxsize=1 << 18)
def fold(word: str) -> str:
    word = unicodedata.normalize("NFKC", word).casefold()
    return "".join(c for c in word if unicodedata.category(c) != "Cf")


def words_of(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return list(map(fold, WORD.findall(text)))


class WaveletMatrix:
    """rank(c, i): occurrences of c among the first i symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros(len(c), np.int64)
        for b, ones, zeros in self.levels:
            one = ((c >> b) & 1).astype(bool)
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            i = np.where(one, zeros + ones[i], i - ones[i])
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for b, ones, zeros in self.levels:
            one = ones[i + 1] - ones[i]
            c |= one.astype(np.int64) << b
            i = np.where(one == 1, zeros + ones[i], i - ones[i])
        return c


class FMIndex:
    """Over word ids >= 1; 0 separates documents and is never searched."""

    def __init__(self, seq: np.ndarray, sigma: int):
        n = len(seq)
        order = self._suffixes(seq)
        before = seq[order - 1]  # the symbol before each suffix; cyclic at 0, where seq ends with 0
        self.bits = max(1, int(sigma).bit_length())
        self.tree = WaveletMatrix(before.astype(np.int64), self.bits)
        self.first = np.zeros(sigma + 2, np.int64)
        np.cumsum(np.bincount(seq, minlength=sigma + 1), out=self.first[1:])
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled = sampled
        self.slot = np.cumsum(sampled) - 1
        self.positions = order[sampled]
        self.n = n

    @staticmethod
    def _suffixes(seq: np.ndarray) -> np.ndarray:
        """Full suffix order by prefix doubling; every separator differs from every other.

        A rank is the first slot of its group of equal prefixes, so that a group is ordered in
        place and what stands alone is never looked at again.
        """
        n = len(seq)
        zero = seq == 0
        count = int(zero.sum())
        rank = np.where(zero, np.cumsum(zero) - 1, seq.astype(np.int64) + count)
        step, top = 1, int(rank.max()) + 2
        if top < 1 << 20:  # three symbols at once
            after = np.concatenate([rank + 1, [0, 0]])
            rank, step = (rank * top + after[1 : n + 1]) * top + after[2 : n + 2], 3
        order = np.argsort(rank, kind="stable")
        slots = np.arange(n)  # of the suffixes still to be told apart
        keys = rank[order]
        rank = np.empty(n, np.int64)
        while True:
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
            alone = new & np.concatenate([new[1:], [True]])
            slots = slots[~alone]
            if not len(slots):
                return order
            some = order[slots]
            far = some + step
            keys = rank[some] * (n + 1) + np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
            by = np.argsort(keys, kind="stable")
            order[slots], keys = some[by], keys[by]
            step *= 2

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each phrase with a hit: its row and the interval of suffixes."""
        live = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            lo, hi = self.first[c] + self.tree.rank(c, lo), self.first[c] + self.tree.rank(c, hi)
            keep = hi > lo
            live, lo, hi = live[keep], lo[keep], hi[keep]
            if not len(live):
                break
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            done = self.sampled[rows]
            out[todo[done]] = self.positions[self.slot[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            if len(todo):
                c = self.tree.access(rows)
                rows = self.first[c] + self.tree.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """All phrases of the test items, as rows of word ids."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        self.size, self.ids = size, {}
        rows, owners = [], []
        for item, text in items:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text or "")]
            for i in range(len(ids) - size + 1):
                rows.append(ids[i : i + size])
                owners.append(item)
        matrix = np.array(rows, np.int64).reshape(-1, size)
        self.rows, inverse = np.unique(matrix, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        order = np.argsort(inverse, kind="stable")
        self.owners = np.array(owners, np.int64)[order]
        self.owner_at = np.searchsorted(inverse[order], np.arange(len(self.rows) + 1))


class Shard:
    """Documents in, leaks out; holds at most about SHARD_WORDS words."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.get = phrases.ids.get
        self.clear()

    def clear(self) -> None:
        self.parts, self.at, self.docs = [np.zeros(1, np.int64)], [], []
        self.length = 1

    def add(self, doc: int, text: str) -> None:
        words = words_of(text)
        if words:
            get, other = self.get, len(self.phrases.ids) + 1
            self.at.append(self.length)
            self.docs.append((doc, text))
            self.parts += [np.fromiter((get(w, other) for w in words), np.int64, len(words)), np.zeros(1, np.int64)]
            self.length += len(words) + 1

    def leaks(self) -> list[tuple[int, int, int, int, int]]:
        """(doc, item, first character, end, words) of every merged span."""
        phrases, found = self.phrases, []
        if self.docs and len(phrases.rows):
            index = FMIndex(np.concatenate(self.parts), len(phrases.ids) + 1)
            starts = np.array(self.at)
            for block in range(0, len(phrases.rows), BLOCK):
                hit, lo, hi = index.search(phrases.rows[block : block + BLOCK])
                if not len(hit):
                    continue
                rows = np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange(int((hi - lo).sum()))
                phrase = np.repeat(hit + block, hi - lo)
                place = index.locate(rows)
                run = np.searchsorted(starts, place, "right") - 1
                many = phrases.owner_at[phrase + 1] - phrases.owner_at[phrase]
                pick = np.repeat(phrases.owner_at[phrase + 1] - np.cumsum(many), many) + np.arange(int(many.sum()))
                found.append(np.stack([np.repeat(run, many), phrases.owners[pick], np.repeat(place - starts[run], many)]))
        out = []
        if found:
            run, item, place = np.concatenate(found, axis=1)
            order = np.lexsort((place, item, run))
            run, item, place = run[order], item[order], place[order]
            new = np.concatenate([[True], (run[1:] != run[:-1]) | (item[1:] != item[:-1]) | (place[1:] > place[:-1] + 1)])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(new)]]) - 1
            offsets: dict[int, list[tuple[int, int]]] = {}
            for f, l in zip(first.tolist(), last.tolist()):
                r = int(run[f])
                doc, text = self.docs[r]
                if id(text) not in offsets:
                    offsets = {id(text): [m.span() for m in WORD.finditer(text)]}
                spans, a, b = offsets[id(text)], int(place[f]), int(place[l]) + phrases.size - 1
                out.append((doc, int(item[f]), spans[a][0], spans[b][1], b - a + 1))
        self.clear()
        return out


def _search(docs: DataFrame, items: list[tuple[int, str]], doc_key: str, text: str, item_key: str, min_words: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    names = [doc_key, item_key, "span_start", "span_end", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(Phrases(shared.value, min_words))

        def flush() -> pa.RecordBatch:
            rows = shard.leaks()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if body:
                        shard.add(doc, body)
                if shard.length > SHARD_WORDS:
                    yield flush()
        yield flush()

    schema = ", ".join(f"`{n}` bigint" for n in names)
    return docs.select(doc_key, text).mapInArrow(run, schema)


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every passage of ``min_words`` or more words that a document shares with a test item."""
    items = items.select(F.col(item_key).alias("_i"), F.col(item_text).alias("_t")).where(F.col("_i").isNotNull() & F.col("_t").isNotNull())
    chars = items.agg(F.sum(F.length("_t"))).first()[0] or 0
    parts = chars // ITEMS_LIMIT + 1
    found = None
    for k in range(parts):  # one pass per ITEMS_LIMIT characters of test items
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("_i"), F.lit(parts)) == k)
        one = _search(docs, [tuple(r) for r in some.distinct().collect()], doc_key, text, item_key, min_words)
        found = one if found is None else found.unionByName(one)
    return found.dropDuplicates()


def removal_spans(leaks: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """Overlapping or touching spans of one document merged, whatever the item."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc_key).orderBy("span_start", "span_end")
    reach = F.max("span_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = leaks.withColumn("_new", F.coalesce(F.col("span_start") > reach, F.lit(True)).cast("int"))
    return (
        marked.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(doc_key, "_no")
        .agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.array_sort(F.collect_set(item_key)).alias("item_ids"))
        .drop("_no")
    )
