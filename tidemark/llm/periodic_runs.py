"""Periodic runs of words, found with a recompression grammar.

A run is a stretch of consecutive words with smallest period q and length >= max(6, 4 q) that no neighbouring word extends. A few documents at a
time are written as one sequence of word numbers, with a number of its own before each document and at the end.

*Grammar.* Block compression (equal neighbours become one symbol of letter and count) and pair compression (letters fall in two halves; a left
letter and the right one after it become one symbol) alternate until each document is a symbol or two. Symbols are named by sorting, so equal
names are equal strings. *Extensions.* `Grammar.common` matches two places symbol by symbol: it climbs wherever both stand at the border of a
symbol of the next level, steps over equal ones (over blocks by their counts), and goes down where symbols differ; many pairs move at once.
*Candidates.* A run of period q holds four neighbouring multiples of q, whose words are equal; all such places for q = 1, 2, ... cost a harmonic
sum. Their extensions to both sides are the run. Of the periods found for one stretch the smallest is its own, the others are multiples.

Work stays in its row: documents are not shuffled, and a task holds the grammar of one slice of SLICE bytes, or of one longer text.

Defined cases: a null or empty text, or one of white space, has no words; a null doc_id counts as the empty string where it is hashed; repeated
rows are judged one by one; an empty table gives an empty result; further columns are ignored; a very long text is a slice of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import query, sliced, table

#: Production parameters: least length of a run, and least exponent.
LENGTH, EXPONENT = 6, 4
#: Bytes of text whose documents share a grammar.
SLICE = 1 << 21
#: Pair levels at most; a level leaves about three quarters of the symbols.
LEVELS = 120


class Grammar:
    """Run-length grammar of a sequence. Values from `single` on occur once each and are never merged; the first and the last value are such."""

    def __init__(self, words: np.ndarray, single: int):
        fresh = int(words.max()) + 1
        symbols, apart = words.astype(np.int64), words >= single
        levels, inner = [], []
        for turn in range(LEVELS):
            n = len(symbols)
            edge = np.ones(n, bool)
            if turn % 2 == 0:
                edge[1:] = symbols[1:] != symbols[:-1]
            else:
                left = (((symbols * 0x9E3779B1 + turn * 0x85EBCA6B) >> 13) ^ (symbols >> 3) ^ turn) & 1 == 0
                edge[1:] = ~(left[:-1] & ~left[1:] & ~apart[:-1] & ~apart[1:])
            first = np.flatnonzero(edge)
            if len(first) == n:
                continue
            size = np.diff(np.append(first, n))
            above = symbols[first].copy()
            many = np.flatnonzero(size > 1)
            second = size[many] if turn % 2 == 0 else symbols[first[many] + 1]
            _, named = np.unique(above[many] * (max(fresh, n) + 1) + second, return_inverse=True)
            above[many] = fresh + named
            fresh += int(named.max()) + 1
            levels.append((symbols, np.cumsum(edge) - 1, edge, np.append(edge[1:], True)))
            inner.append((first, first + size - 1, turn % 2 == 0))
            apart = apart[first]
            symbols = above
            if n - len(first) and len(symbols) <= 2 * int(apart.sum()):
                break
        levels.append((symbols, np.zeros(len(symbols), np.int64), np.zeros(len(symbols), bool), np.zeros(len(symbols), bool)))
        base = np.cumsum([0, *(len(x[0]) for x in levels)])
        self.size = len(words)
        self.symbol = np.concatenate([x[0] for x in levels])
        self.up = np.concatenate([x[1] + base[k + 1] for k, x in enumerate(levels)])
        self.edge = {1: np.concatenate([x[2] for x in levels]), -1: np.concatenate([x[3] for x in levels])}
        self.down = {1: np.concatenate([np.zeros(self.size, np.int64), *(first + base[k] for k, (first, _, _) in enumerate(inner))]),
                     -1: np.concatenate([np.zeros(self.size, np.int64), *(last + base[k] for k, (_, last, _) in enumerate(inner))])}
        # what is left of a symbol's block, itself included, to the right and to the left
        rest = {1: [], -1: []}
        for k, (symbols, *_) in enumerate(levels):
            n, (first, last, blocks) = len(symbols), inner[k] if k < len(inner) else (None, None, False)
            place, size = np.arange(n), None if not blocks else last - first + 1
            rest[1].append(np.repeat(last, size) - place + 1 if blocks else np.ones(n, np.int64))
            rest[-1].append(place - np.repeat(first, size) + 1 if blocks else np.ones(n, np.int64))
        self.rest = {d: np.concatenate(parts) for d, parts in rest.items()}

    def common(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """Number of equal values from i and from j on, to the right (way 1) or to the left (way -1); i != j."""
        a, b, rising = i.astype(np.int64), j.astype(np.int64), np.ones(len(i), bool)
        edge, down, rest, symbol, up = self.edge[way], self.down[way], self.rest[way], self.symbol, self.up
        left = np.arange(len(i))
        while len(left):
            x, y = a[left], b[left]
            equal = symbol[x] == symbol[y]
            climb = equal & rising[left] & edge[x] & edge[y]
            lower = ~equal & (x >= self.size)
            step = way * np.minimum(rest[x], rest[y])
            a[left] = np.where(climb, up[x], np.where(lower, down[x], np.where(equal, x + step, x)))
            b[left] = np.where(climb, up[y], np.where(lower, down[y], np.where(equal, y + step, y)))
            rising[left[lower]] = False
            left = left[equal | lower]
        return np.abs(a - i)


def runs(words: np.ndarray, single: int, longest: int, length: int = LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period. Values from `single` on occur once each and stand first and last."""
    period, place = [], []
    for q in range(1, longest // exponent + 1):
        grid = words[::q]
        same = grid[1:] == grid[:-1]
        row = same[:len(same) - exponent + 2].copy()
        for k in range(1, exponent - 1):
            row &= same[k:k + len(row)]
        found = np.flatnonzero(row)
        if len(found):
            period.append(np.full(len(found), q))
            place.append(found * q)
    if not period:
        return np.zeros((0, 3), np.int64)
    grammar = Grammar(words, single)
    q, i = np.concatenate(period), np.concatenate(place)
    # neighbouring grid places mostly lie in one run: the first of them goes ahead, the rest follow where its run ends before them
    head = np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1] + q[1:]))
    group = np.cumsum(head) - 1

    def extend(q, i):
        return i - grammar.common(i - 1, i + q - 1, -1), i + q + grammar.common(i, i + q, 1)

    start, end = extend(q[head], i[head])
    rest = ~head & (i + q >= end[group])
    more = extend(q[rest], i[rest])
    q, start, end = np.append(q[head], q[rest]), np.append(start, more[0]), np.append(end, more[1])
    keep = end - start >= np.maximum(length, exponent * q)
    q, start, end = q[keep], start[keep], end[keep]
    order = np.lexsort((q, end, start))
    q, start, end = q[order], start[order], end[order]
    once = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(q) else np.zeros(0, bool)
    q, start, end = q[once], start[once], end[once]
    order = np.lexsort((q, start))
    return np.stack([start[order], end[order] - start[order], q[order]], axis=1)


def unrolled(words: list, doc_id: int | None) -> list:
    """The words with the planted repetition of the contract: every tenth document, by its hash, repeats a stretch to its end."""
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a:a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[:n - a]


_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed binary"


def collapse(docs: DataFrame, change=None) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs, collapsed) of each text: the number of runs, the one with the greatest exponent,
    all of them as lines, and the text's words without those that a run repeats. `change(words, doc_id)` may replace the words first."""

    def work(batches):
        for batch in sliced(batches, SLICE):
            ids = batch.column(0).to_pylist()
            texts = [(t or b"").split() for t in batch.column(1).to_pylist()]
            if change is not None:
                texts = [change(w, k) for w, k in zip(texts, ids)]
            flat = [w for text in texts for w in text]
            coded = pa.array(flat, pa.binary()).dictionary_encode()
            single = len(coded.dictionary)
            size = np.array([len(w) for w in texts], np.int64)
            begin = np.cumsum(size + 1) - size
            words = np.empty(len(flat) + len(texts) + 1, np.int64)
            inside = np.ones(len(words), bool)
            inside[begin - 1] = inside[-1] = False
            words[inside] = coded.indices.to_numpy()
            words[~inside] = single + np.arange(len(texts) + 1)
            found = runs(words, single, int(size.max()))
            doc = np.searchsorted(begin, found[:, 0], "right") - 1
            bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
            rows = []
            for k, text in enumerate(texts):
                if bounds[k] == bounds[k + 1]:
                    rows.append((ids[k], 0, None, None, None, None, "", b" ".join(text)))
                    continue
                own = found[bounds[k]:bounds[k + 1]] - [begin[k], 0, 0]
                gone = np.zeros(len(text) + 1, np.int64)
                np.add.at(gone, own[:, 0] + own[:, 2], 1)
                np.add.at(gone, own[:, 0] + own[:, 1], -1)
                kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
                own = own.tolist()
                s, n, q = max(own, key=lambda r: ((r[1] << 66) // r[2], -r[0], -r[2]))
                rows.append((ids[k], len(own), s, n, q, 1000 * n // q, "".join(f"{s},{n},{q}\n" for s, n, q in own), b" ".join([text[i] for i in kept])))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 6, pa.string(), pa.binary()])], names=[x.split()[0] for x in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(work, _OUT)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse(table(spark, sf_dir, "documents"), unrolled)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.col("runs").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
