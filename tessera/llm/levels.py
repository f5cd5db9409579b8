"""Reading level of the prose in each document.

A linear ranker is learnt from pairs of graded samples of different level: it
scores a sentence from syntax (length, word length, commas, long words, capital
abbreviations) and from hashed vocabulary, and a sample by the mean over its
sentences.  A document's score is the median over its own sentences, so that a
few sentences of another level do not move it.  Isotonic regression over the
samples' scores calibrates scores into levels.

Code blocks, lists, headings, tables and quotations are left aside, and so are
sentences of which most words occur in no graded sample (foreign passages).

Edge cases: null and blank texts have no row; a text without any prose
sentence is judged by all its lines, and if it has no known word at all it
gets the lowest level; repeated rows give one result; samples without text or
level are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many graded samples are read for training.
SAMPLES = 5_000
HASHED = 1 << 14
SYNTAX = 5
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_ASIDE = re.compile(r"^(?:[ \t]*(?:[-*+•]|\d+[.)])[ \t]+.*|[ \t]*[#>|].*|(?: {4}|\t).*|[ \t]*[=\-*_]{3,}[ \t]*)$", re.M)
_SENTENCE = re.compile(r"[.!?。！？]+[\"')\]]*(?:\s+|$)|\n[ \t]*\n+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


@lru_cache(maxsize=1 << 18)
def bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "replace")) % HASHED


def sentences(text: str) -> list[list[str]]:
    """Words of each prose sentence."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    prose = _ASIDE.sub("\n", _FENCE.sub("\n", text) if "```" in text or "~~~" in text else text)
    out = [w for s in _SENTENCE.split(prose) if len(w := _WORD.findall(s)) > 1]
    return out or [w for s in text.split("\n") if (w := _WORD.findall(s))]


def syntax(words: list[str]) -> tuple[float, ...]:
    n = len(words)
    sizes = list(map(len, words))
    return (
        math.log(n),
        sum(sizes) / n / 5,
        sum(s > 8 for s in sizes) / n,
        sum(s > 12 for s in sizes) / n,
        sum(w.isupper() and len(w) > 1 for w in words) / n,
    )


def vector(words: list[str]) -> np.ndarray:
    x = np.zeros(SYNTAX + HASHED)
    x[:SYNTAX] = syntax(words)
    for w in words:
        x[SYNTAX + bucket(w)] += 1 / len(words)
    return x


def pool_adjacent(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on x: block ends and their values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, last x
    for i in order:
        blocks.append([y[i], 1, x[i]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, c, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, last]
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Ranker:
    def __init__(self, samples: list[tuple[str, int]], rounds: int = 400, ridge: float = 1e-3):
        own = [(vector(words), i) for i, (t, _) in enumerate(samples) for words in sentences(t)]
        self.ready = bool(own)
        if not own:
            return
        x, of = np.stack([v for v, _ in own]), np.array([i for _, i in own])
        grade = np.array([g for _, g in samples])
        self.known = x[:, SYNTAX:].sum(0) > 0
        used = np.flatnonzero(np.concatenate([np.ones(SYNTAX, bool), self.known]))
        scale = np.concatenate([x[:, :SYNTAX].std(0) + 1e-9, np.full(HASHED, 0.02)])[used]
        z = x[:, used] / scale
        # a pair of samples is compared sentence by sentence, each with its sample's level
        w = self._fit(z, grade[of], rounds, ridge)
        self.weights = np.zeros(SYNTAX + HASHED)
        self.weights[used] = w / scale
        self.vocabulary: dict[str, float] = {}
        scores = np.array([self.score(t) for t, _ in samples])
        self.ends, self.values = pool_adjacent(scores, grade.astype(float))
        # a cut between two levels lies midway between the blocks that round to them
        grades = np.round(self.values)
        turn = np.flatnonzero(grades[1:] != grades[:-1])
        starts = np.array([scores[scores > e].min(initial=np.inf) for e in self.ends])
        self.cuts = (self.ends[turn] + starts[turn]) / 2
        self.grades = np.concatenate([grades[turn], grades[-1:]]).astype(int)

    @staticmethod
    def _fit(z: np.ndarray, y: np.ndarray, rounds: int, ridge: float, pairs: int = 20_000) -> np.ndarray:
        """Logistic loss over pairs of different level, by momentum."""
        rng = np.random.default_rng(7)
        w, v = np.zeros(z.shape[1]), np.zeros(z.shape[1])
        for _ in range(rounds):
            a, b = rng.integers(0, len(y), (2, pairs))
            keep = y[a] != y[b]
            a, b = a[keep], b[keep]
            high, low = np.where(y[a] > y[b], a, b), np.where(y[a] > y[b], b, a)
            score = z @ w
            p = 1 / (1 + np.exp(np.clip(score[high] - score[low], -30, 30)))
            pull = np.bincount(high, p, len(y)) - np.bincount(low, p, len(y))
            v = 0.9 * v + z.T @ pull / max(1, len(high)) - ridge * w
            w += 0.3 * v
        return w

    def __getstate__(self):
        return self.__dict__ | {"vocabulary": {}}

    def _word(self, word: str) -> float | None:
        b = bucket(word)
        return float(self.weights[SYNTAX + b]) if self.known[b] else None

    def sentence_scores(self, text: str) -> list[float]:
        if len(self.vocabulary) > 500_000:
            self.vocabulary.clear()
        cache, out, base = self.vocabulary, [], self.weights[:SYNTAX].tolist()
        for words in sentences(text):
            total, seen = 0.0, 0
            for w in words:
                try:
                    v = cache[w]
                except KeyError:
                    v = cache[w] = self._word(w)
                if v is not None:
                    total += v
                    seen += 1
            if 2 * seen >= len(words):
                out.append(total / len(words) + sum(a * b for a, b in zip(base, syntax(words))))
        return out

    def score(self, text: str) -> float:
        own = self.sentence_scores(text)
        return float(np.median(own)) if own else -math.inf

    def level(self, text: str) -> int:
        return int(self.grades[int(np.searchsorted(self.cuts, self.score(text), "left"))])


def train(samples: DataFrame, text: str = "text", level: str = "reading_level", limit: int = SAMPLES) -> Ranker:
    rows = samples.where(F.col(level).isNotNull() & (F.trim(text) != "")).select(text, level).distinct().orderBy(F.xxhash64(text), text, level).limit(limit).collect()
    return Ranker([(r[0], int(r[1])) for r in rows])


def reading_levels(docs: DataFrame, ranker: Ranker, key: str = "doc_id", text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keys, levels = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if model.ready and t and not t.isspace():
                    keys.append(k)
                    levels.append(model.level(t))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema[0].type), pa.array(levels, pa.int64())], [key, "reading_level"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, reading_level bigint")
