"""Splitting oversized texts at natural boundaries, by pointer doubling.

Sizes are characters that are not Unicode white space.  The boundaries of a text
are its block starts (a line that is not indented, after a blank line), line
starts, word starts and, inside a run of characters longer than the limit, every
``gcd(size, overlap)``-th character.  Every boundary is joined to the farthest
legal end of a piece that begins there, and from that end back to the start of
the next piece, as far as the overlap allows.  Squaring that successor table
marks all pieces in logarithmically many rounds, for all texts of a batch at
once and over numpy arrays.

The end of a piece is the farthest block start within the limit if that fills
half of it, else the farthest line start that does, else the farthest word
start, else (only within an over-long run) the farthest forced boundary.

Edge cases: null and empty texts and texts within the limit have no pieces
unless ``whole`` is set, which gives them as one; overlap is reduced where it
would keep a piece from reaching beyond the one before; a size below 1 counts
as 1 and an overlap is kept below the size; a null language, and one without a
setting, has the setting of the null language; repeated rows of one key give
their pieces once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Unicode White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_TABLE = np.zeros(0x3001, bool)
_TABLE[WHITE] = True
BATCH_CHARS = 2_000_000


def white(chars: np.ndarray) -> np.ndarray:
    return _TABLE[np.minimum(chars, 0x3000)] & (chars <= 0x3000)


def _farthest(nodes: np.ndarray, count: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Of each row the last of ``nodes`` whose count is within the limit, -1: none."""
    if not len(nodes):
        return np.full(len(limit), -1)
    at = np.searchsorted(count[nodes], limit, "right") - 1
    return np.where(at >= 0, nodes[at.clip(0)], -1)


def split_batch(texts: list[str], sizes: np.ndarray, overlaps: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, start, end, size and forced flag of every piece, in order.

    Each text must hold at least one character.
    """
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(length)])
    sizes = np.maximum(sizes, 1)
    overlaps = np.clip(overlaps, 0, sizes - 1)
    blank = white(chars)
    total = np.concatenate([[0], np.cumsum(~blank)])
    before = np.concatenate([[True], blank[:-1]])
    before[begin[:-1]] = True
    words = np.flatnonzero(~blank & before)  # where a word starts

    feed = (chars == 10) | ((chars == 13) & np.concatenate([chars[1:] != 10, [True]]))
    lines = np.unique(np.concatenate([begin[:-1], np.flatnonzero(feed) + 1]))
    lines = lines[lines < len(chars)]
    line_of = lines[np.searchsorted(lines, words, "right") - 1]  # each word's line
    leads = np.ones(len(words), bool)  # first word of its line
    leads[1:] = line_of[1:] != line_of[:-1]
    rank = np.where(leads, 2, 1)
    spot = np.where(leads, line_of, words)
    flush = leads & (line_of == words)
    last_line = np.searchsorted(lines, words[1:], "right") - np.searchsorted(lines, words[:-1], "right")
    rank[1:][flush[1:] & (last_line > 1)] = 3
    # runs longer than their text's limit get boundaries inside
    of_word = np.searchsorted(begin, words, "right") - 1
    stop = np.searchsorted(np.flatnonzero(blank), words)
    blanks = np.append(np.flatnonzero(blank), len(chars))
    stop = np.minimum(blanks[stop], begin[of_word + 1])
    inner = [np.arange(w + g, s, g) for w, s, g in ((w, s, math.gcd(int(sizes[t]), int(overlaps[t]))) for w, s, t in zip(words.tolist(), stop.tolist(), of_word.tolist()) if s - w > sizes[t])] if (stop - words > sizes[of_word]).any() else []
    inner = np.concatenate(inner) if inner else np.zeros(0, np.int64)
    # nodes: all boundaries, and the two ends of each text
    place = np.concatenate([spot, inner, begin[:-1], begin[1:]])
    kind = np.concatenate([rank, np.zeros(len(inner), int), np.full(len(texts), 4), np.full(len(texts), 5)])
    text = np.concatenate([of_word, np.searchsorted(begin, inner, "right") - 1, np.arange(len(texts)), np.arange(len(texts))])
    order = np.lexsort((kind, place, text))
    place, kind, text = place[order], kind[order], text[order]
    first = np.flatnonzero(kind == 4)
    # a boundary at a text's very start is the start itself
    keep = ~((kind < 4) & (place == begin[text]))
    place, kind, text = place[keep], kind[keep], text[keep]
    first, last = np.flatnonzero(kind == 4), np.flatnonzero(kind == 5)
    count = total[place]
    n = np.arange(len(place))
    limit = np.minimum(count + sizes[text], count[last[text]])
    half = count + sizes[text] // 2
    end = np.full(len(n), -1)
    reach_end = count[last[text]] <= count + sizes[text]
    end[reach_end] = last[text][reach_end]
    for least in (3, 2, 1, 0):
        choice = _farthest(np.flatnonzero((kind >= least) & (kind != 4)), count, limit)
        good = (end < 0) & (choice > n) & (text[choice] == text)
        if least > 1:
            good &= count[choice] > half
        else:
            good &= count[choice] > count
        end[good] = choice[good]
    end = np.where(end < 0, last[text], end)
    # the next start: as far back as the overlap allows, at a line if there is one
    back = count[end] - overlaps[text]
    nxt = end.copy()
    for least in (1, 2):
        nodes = np.flatnonzero((kind >= least) & (kind != 4))
        at = np.searchsorted(count[nodes], back, "left")
        choice = nodes[at.clip(max=len(nodes) - 1)] if len(nodes) else end
        good = (choice > n) & (choice < end) & (count[choice] >= back)
        nxt = np.where(good, choice, nxt)
    inside = np.flatnonzero(kind == 0)
    if len(inside):
        at = np.searchsorted(count[inside], back, "left")
        choice = inside[at.clip(max=len(inside) - 1)]
        nxt = np.where((nxt == end) & (kind[end] == 0) & (choice > n) & (choice < end) & (count[choice] >= back), choice, nxt)
    nxt = np.where(end[nxt] > end, nxt, end)
    nxt = np.where(kind[end] == 5, n, nxt)  # the last piece leads nowhere
    # pointer doubling
    on = np.zeros(len(n), bool)
    on[first] = True
    jump = nxt
    while True:
        seen = np.flatnonzero(on)
        more = jump[seen]
        if on[more].all() and (jump[jump] == jump).all():
            break
        on[more] = True
        jump = jump[jump]
    s = np.flatnonzero(on & (kind != 5))
    return text[s], place[s] - begin[text[s]], place[end[s]] - begin[text[s]], count[end[s]] - count[s], kind[end[s]] == 0


def split_column(df: DataFrame, settings: dict[str | None, tuple[int, int]], key: str, text: str, language: str, with_text: bool = True, whole: bool = False) -> DataFrame:
    """(key, piece_no, start, end, size, forced[, piece]); ``end`` is exclusive."""
    kind = df.schema[key].dataType.simpleString()
    default = settings[None]

    def emit(keys, texts, sizes, overlaps, key_type):
        t, start, end, size, forced = split_batch(texts, np.array(sizes), np.array(overlaps))
        if not whole:  # one piece only: it was within the limit
            many = np.bincount(t, minlength=len(texts))[t] > 1
            t, start, end, size, forced = t[many], start[many], end[many], size[many], forced[many]
        number = np.arange(len(t)) - np.searchsorted(t, t)
        columns = [pa.array([keys[i] for i in t.tolist()], key_type), pa.array(number, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(size, pa.int64()), pa.array(forced)]
        names = [key, "piece_no", "start", "end", "size", "forced"]
        if with_text:
            columns.append(pa.array([texts[i][a:b] for i, a, b in zip(t.tolist(), start.tolist(), end.tolist())]))
            names.append("piece")
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, sizes, overlaps, held = [], [], [], [], 0
            for k, t, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
                size, overlap = settings.get(lang, default)
                if not t or (len(t) <= size and not whole):
                    continue
                keys.append(k), texts.append(t), sizes.append(size), overlaps.append(overlap)
                held += len(t)
                if held > BATCH_CHARS:
                    yield emit(keys, texts, sizes, overlaps, batch.schema[0].type)
                    keys, texts, sizes, overlaps, held = [], [], [], [], 0
            if texts:
                yield emit(keys, texts, sizes, overlaps, batch.schema[0].type)

    schema = f"`{key}` {kind}, piece_no bigint, start bigint, end bigint, size bigint, forced boolean" + ", piece string" * with_text
    return df.select(key, text, language).mapInArrow(run, schema)


def read_settings(df: DataFrame) -> dict[str | None, tuple[int, int]]:
    """Limits by language; there are as many rows as languages."""
    rows = df.select("language", "chunk_size", "chunk_overlap").distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 languages in the settings")
    out = {r[0]: (int(r[1]), int(r[2] or 0)) for r in rows if r[1] is not None}
    return {None: (1000, 200)} | out
