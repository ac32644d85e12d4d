"""Periodic runs of words: seeds from repeated k-grams, extended along the diagonals of the self-comparison."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import let, words

LEAST, EXPONENT = 6, 4     # a run has at least this many words, and this many periods
TASK_WORDS = 400_000       # words of several documents that are indexed together
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _named(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (a, b) occur twice or more, and a number for each of those: equal pairs, equal numbers."""
    codes, _ = pd.factorize((a.astype(np.int64) << 32) | b)
    twice = np.bincount(codes)[codes] > 1 if len(codes) else np.zeros(0, bool)
    return twice, codes[twice]


class Grams:
    """Repeated k-grams of one text or of many: their positions, ascending, and their names."""

    def __init__(self, k: int, at: np.ndarray, name: np.ndarray):
        self.k, self.at, self.name = k, at, name

    def grown(self, by: int) -> "Grams":
        """(k + ``by``)-grams, ``by`` <= k. One can only repeat where its two k-grams do."""
        there = np.searchsorted(self.at, self.at + by)
        there[there == len(self.at)] = 0
        both = np.flatnonzero(self.at[there] == self.at + by) if len(self.at) else there
        twice, name = _named(self.name[both], self.name[there[both]])
        return Grams(self.k + by, self.at[both][twice], name)

    def seeds(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, lag) of neighbouring occurrences of a gram that lie ``low`` to ``high`` words apart. Where such
        seeds follow one another on a diagonal, the first stands for all.
        """
        order = np.argsort(self.name, kind="stable")
        p, name = self.at[order], self.name[order]
        lag = p[1:] - p[:-1]
        ok = (name[1:] == name[:-1]) & (lag >= low) & (lag <= high)
        p, lag = p[:-1][ok], lag[ok]
        order = np.lexsort((p, lag))
        p, lag = p[order], lag[order]
        first = np.ones(len(p), bool)
        first[1:] = (lag[1:] != lag[:-1]) | (p[1:] != p[:-1] + 1)
        return p[first], lag[first]


def _reach(w: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many words from ``i`` on, going by ``step``, equal the ones ``lag`` later."""
    done, width = 0, 32
    while True:
        if step > 0:
            a, b = w[i + done:i + done + width], w[i + done + lag:i + done + lag + width]
        else:
            hi = i - done + 1
            lo = max(hi - width, 0)
            a, b = w[lo:hi][::-1], w[lo + lag:hi + lag][::-1]
        n = min(len(a), len(b))
        off = np.flatnonzero(a[:n] != b[:n])
        if len(off):
            return done + int(off[0])
        done += n
        if n < width:
            return done
        width *= 2


def runs_of(w: np.ndarray, unit: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, ascending. ``w``: word numbers of several documents, each followed by a
    number that occurs nowhere else; ``unit``: the document of each place.

    A run with period q from 2^j to 2^(j+1) - 1 overlaps itself at lag q in (EXPONENT - 1) q words or more, so every
    k-gram of k = (EXPONENT - 1) 2^j words in that overlap recurs q later. As k >= q, it cannot recur sooner in the run
    unless q is a multiple of the smallest period, so neighbouring occurrences are enough: no gram ever gives all its
    pairs. Each seed outside what its diagonal has covered already is extended both ways.
    """
    twice, name = _named(unit, w)
    base = Grams(1, np.flatnonzero(twice), name)
    two = base.grown(1)
    four = two.grown(2)
    grams, low, high = four.grown(1), 1, 1       # period 1: 6 words, 5 of them in the overlap
    found, covered = {}, {}
    while len(grams.at):
        for p, lag in zip(*(s.tolist() for s in grams.seeds(low, high))):
            if p < covered.get(lag, 0):
                continue
            start = p - _reach(w, p, lag, -1) + 1
            end = p + _reach(w, p, lag, 1)
            covered[lag] = end
            length = end - start + lag
            if length >= max(LEAST, EXPONENT * lag):
                found.setdefault((start, length), lag)  # lags ascend, so the smallest period comes first
        low, high = high + 1, 2 * high + 1
        grams = grams.grown(1) if grams.k == 5 else grams.grown(grams.k)
    return sorted((start, length, lag) for (start, length), lag in found.items())


def _collapsed(ws: list[bytes], runs) -> bytes:
    """The words, one blank between, without those that lie behind the first period of any run."""
    if not runs:
        return b" ".join(ws)
    edge = np.zeros(len(ws) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([x for x, d in zip(ws, np.cumsum(edge).tolist()) if not d])


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _several(texts: list[list[bytes]]):
    """Runs of every text, found together."""
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    w, number, lo = np.empty(int(ends[-1]), np.int64), _Numbers(), 0
    for t, hi in zip(texts, ends.tolist()):
        w[lo:hi - 1] = np.fromiter(map(number.__getitem__, t), np.int64, len(t))
        lo = hi
    w[ends - 1] = len(number) + np.arange(len(texts))
    out = [[] for _ in texts]
    for start, length, period in runs_of(w, np.repeat(np.arange(len(texts)), sizes)):
        d = int(np.searchsorted(ends, start, "right"))
        out[d].append((start - int(ends[d - 1] if d else 0), length, period))
    return out


def _run(batches):
    for b in batches:
        ids, texts = b.column("doc_id"), b.column("text")
        lo = 0
        while lo < b.num_rows:
            hi, held, n = lo, [], 0
            while hi < b.num_rows and (hi == lo or n < TASK_WORDS):
                held.append((texts[hi].as_py() or b"").split())  # blanks: x20 and x09 to x0D
                n += len(held[-1])
                hi += 1
            runs = _several(held)
            yield pa.RecordBatch.from_arrays([
                ids.slice(lo, hi - lo), pa.array([len(t) for t in held], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], pa.list_(RUN)),
                pa.array([_collapsed(t, rs) for t, rs in zip(held, runs)], pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])
            lo = hi


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row of (doc_id, text).

    ``runs``: array of (start, length, period) by start, then period, in words from 0: maximal stretches with smallest
    period q of at least ``max(LEAST, EXPONENT * q)`` words. ``collapsed`` (text): the words outside, and the first period
    of every run, joined by one blank; a word that any run holds behind its first period is dropped.

    Documents stay where they are: no shuffle. A null or empty text has no words, no runs and an empty ``collapsed``. Rows
    that repeat an id, or have none, are each searched. A very long text is indexed whole by its task, with about 100 bytes a word.
    An empty table gives no rows; other columns, whatever their names, are not returned.
    """
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        _run, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def longest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equals, null if there is none."""
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda s, x: F.when(better(x, s), x).otherwise(s))


def with_planted_run(doc_id: Column, text: Column) -> Column:
    """The text, its tail made periodic where the digest of the id ends in 0: with h = crc32 of the id, g = h div 10 and
    n words, each word i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, a + (i - a) % p))), " ")

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words(text), planted)).otherwise(text)
