"""Benchmark decontamination: a BM25 index of test items, queried by every passage with block-max bounds."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise

K1, B = 1.2, 0.75
SHARE = 0.6          # of an item's own score that a passage must reach
OVERLAP = 0.8        # of the words of the question, and of the answer, that the passage must hold
SHINGLE_OVERLAP = 0.4
ANSWER_WORDS = 8
BLOCK_ITEMS = 8
CHUNK_WORDS = 50_000
MAX_INDEX_CHARS = 16_000_000  # item text that one index holds
HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("word_at", pa.int64()), ("score", pa.float64()),
                 ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])

# A-Z to a-z; ASCII characters but letters and digits to blanks; bytes above ASCII stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), one after another, and the range that each comes from."""
    n = hi - lo
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n), owner


@dataclass
class Item:
    item_id: int
    words: np.ndarray      # term numbers in order
    question: Counter
    answer: Counter
    shingles: set


@dataclass
class Statistics:
    """Of all items, whatever part of them an index holds."""
    items: int
    mean: float           # words of an item
    longest: int
    df: dict[bytes, int]  # items with a term, for the terms of the index


class Index:
    """Inverted index of items in blocks, weights scaled so that a passage hits an item at a sum of 1."""

    def __init__(self, rows: list[tuple[int, str]], share: float = SHARE, whole: Statistics | None = None):
        split = sorted(((i, terms(t)) for i, t in rows if terms(t)), key=lambda r: (len(r[1]), r[0]))
        self.terms: dict[bytes, int] = {}
        self.items: list[Item] = []
        for i, ws in split:
            at = np.array([self.terms.setdefault(w, len(self.terms)) for w in ws])
            cut = max(len(ws) - ANSWER_WORDS, 0) if len(ws) > ANSWER_WORDS else 0
            self.items.append(Item(i, at, Counter(at[:cut].tolist() or at.tolist()), Counter(at[cut:].tolist()),
                                   {tuple(at[k:k + 5].tolist()) for k in range(max(1, len(at) - 4))}))
        n, v = len(self.items), len(self.terms)
        if whole is None:
            whole = Statistics(n, sum(len(x.words) for x in self.items) / max(n, 1), max((len(x.words) for x in self.items), default=1),
                               Counter(w for _, ws in split for w in set(ws)))
        self.longest, total, mean = whole.longest, whole.items, whole.mean
        df = {t: whole.df[w] for w, t in self.terms.items()}
        term, item, weight = [], [], []
        for k, x in enumerate(self.items):
            own = {t: math.log(1 + (total - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(x.words) / mean))
                   for t, c in Counter(x.words.tolist()).items()}
            goal = share * sum(own.values())
            term += own
            item += [k] * len(own)
            weight += [w / goal for w in own.values()]
        term, item, weight = np.array(term, np.int64), np.array(item, np.int64), np.array(weight, float)
        self.n_blocks = -(-n // BLOCK_ITEMS)
        # postings in order of term, then item; each run of a term inside a block of items has its largest weight
        order = np.lexsort((item, term))
        term, self.item, self.weight = term[order], item[order], weight[order]
        run = np.flatnonzero(np.concatenate(([True], (np.diff(term) != 0) | (np.diff(self.item // BLOCK_ITEMS) != 0)))) if len(term) else np.zeros(0, int)
        self.run_at = np.concatenate((run, [len(term)]))
        self.run_block = self.item[run] // BLOCK_ITEMS
        self.run_max = np.maximum.reduceat(self.weight, run) if len(run) else np.zeros(0)
        self.runs_of = np.searchsorted(term[run], np.arange(v + 1))
        self.top = np.zeros(v + 1)  # largest weight of a term; the last entry stands for words of no item
        np.maximum.at(self.top, term, self.weight)

    def search(self, texts: list):
        """(row, item, word position, score, question overlap, answer overlap): the best passage of each row and item."""
        if not self.items:
            return []
        none, size = len(self.terms), max(32, self.longest)
        lookup, found, lo = self.terms.get, [], 0
        while lo < len(texts):
            hi, part, n = lo, [], 0
            while hi < len(texts) and n < CHUNK_WORDS:
                ws = terms(texts[hi])
                part.append(np.fromiter(map(lookup, ws, repeat(none)), np.int64, len(ws)))
                n += len(ws)
                hi += 1
            # passages of 2 * size words, starting every ``size`` words: any item's span lies in one
            doc_at = np.cumsum([0] + [len(x) for x in part])
            starts = [np.arange(a, max(a + 1, z - size), size) if z > a else np.zeros(0, int) for a, z in zip(doc_at, doc_at[1:])]
            row = np.repeat(np.arange(len(part)), [len(x) for x in starts])
            if len(row):
                starts = np.concatenate(starts)
                found += [(lo + int(row[q]), k, int(starts[q] - doc_at[row[q]]), *rest) for q, k, *rest in self._passages(
                    np.concatenate(part), starts, np.minimum(starts + 2 * size, doc_at[row + 1]))]
            lo = hi
        best: dict[tuple, tuple] = {}
        for r, k, at, score, q, a in found:
            key = r, self.items[k].item_id
            if key not in best or score > best[key][1]:
                best[key] = at, score, q, a
        return [(*key, *rest) for key, rest in sorted(best.items())]

    def _passages(self, at: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Hits (passage, item number, score, overlaps) of the passages [start, end) of a long list of term numbers."""
        none = len(self.terms)
        total = np.concatenate(([0.0], np.cumsum(self.top[at])))
        keep = np.flatnonzero(total[ends] - total[starts] >= 1)  # a bound of what any item can reach
        if not len(keep):
            return
        places, owner = _ranges(starts[keep], ends[keep])
        known = at[places] < none
        pair = np.unique(owner[known] * none + at[places[known]])  # distinct terms of each passage
        passage, term = pair // none, pair % none
        # bounds of blocks, then exact scores of the items of blocks that can reach 1
        runs, of = _ranges(self.runs_of[term], self.runs_of[term + 1])
        bound = np.bincount(passage[of] * self.n_blocks + self.run_block[runs], self.run_max[runs], len(keep) * self.n_blocks)
        live = bound[passage[of] * self.n_blocks + self.run_block[runs]] >= 1 - 1e-9
        runs, of = runs[live], of[live]
        posts, entry = _ranges(self.run_at[runs], self.run_at[runs + 1])
        key, back = np.unique(passage[of[entry]] * len(self.items) + self.item[posts], return_inverse=True)
        score = np.bincount(back, self.weight[posts], len(key))
        for x, sc in zip(key[score >= 1 - 1e-9].tolist(), score[score >= 1 - 1e-9].tolist()):
            p, k = keep[x // len(self.items)], x % len(self.items)
            q, a = self._verify(self.items[k], at[starts[p]:ends[p]].tolist())
            if q >= OVERLAP and a >= OVERLAP:
                yield p, k, sc, q, a

    def _verify(self, item: Item, passage: list[int]) -> tuple[float, float]:
        """Share of the question's and of the answer's words in the passage; zero without enough common shingles."""
        held = {tuple(passage[k:k + 5]) for k in range(max(1, len(passage) - 4))}
        if len(item.words) >= 5 and len(item.shingles & held) < SHINGLE_OVERLAP * len(item.shingles):
            return 0.0, 0.0
        have = Counter(passage)
        share = lambda part: sum(min(c, have[t]) for t, c in part.items()) / sum(part.values())
        return share(item.question), share(item.answer)


def _search(index: Index):
    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = [(ids[r], *hit) for r, *hit in index.search(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(HIT)], schema=HIT)
    return run


def _terms(batches):
    for b in batches:
        split = [terms(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("part"), pa.array([len(ws) for ws in split], pa.int64()),
                                          pa.array([sorted(set(ws)) for ws in split], pa.list_(pa.binary()))], names=["part", "n_words", "terms"])


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, max_chars: int = MAX_INDEX_CHARS) -> DataFrame:
    """(doc_id, item_id, word_at, score, question_overlap, answer_overlap) per document row and item it leaks.

    The answer of an item is its last ``ANSWER_WORDS`` words, the question what stands before (the whole item
    if it has no more). Every passage of every document is a query; upper bounds skip passages and blocks of
    items that cannot reach ``share`` of an item's own BM25 score, nothing else is skipped. Benchmarks are far
    smaller than the corpus: an index of at most ``max_chars`` of item text goes to every task, a larger
    benchmark is searched by as many passes over the documents as it has such parts.

    Null or empty texts and items match nothing. Repeated document rows are reported each; items that repeat
    an item_id are searched as separate items and reported once with the best score. Of a document's passages with equal
    scores the first is reported. Long texts are searched whole. An empty table on either side gives no rows.
    Document frequencies, mean length and longest item are those of all items, so scores do not depend on the parts.
    """
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL AND item_id IS NOT NULL").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(chars / max_chars))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    split = materialise(items.mapInArrow(_terms, "part bigint, n_words bigint, terms array<binary>").where("n_words > 0"), "items")
    size = split.agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"), F.max("n_words").alias("longest")).first()
    each = split.select("part", F.explode("terms").alias("term"))
    df = materialise(each.groupBy("part", "term").agg(F.count(F.lit(1)).alias("here")), "terms")
    df = df.select("part", "term").join(df.groupBy("term").agg(F.sum("here").alias("df")), "term")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    ddl = "doc_id bigint, item_id bigint, word_at bigint, score double, question_overlap double, answer_overlap double"
    found = None
    for p in range(parts):
        rows = [(r.item_id, r.text) for r in items.where(F.col("part") == p).collect()]  # bounded by max_chars, as are their terms
        own = {bytes(r.term): r.df for r in df.where(F.col("part") == p).collect()}
        index = Index(rows, share, Statistics(size.n, (size.words or 0) / max(size.n, 1), size.longest or 1, own))
        shared = docs.sparkSession.sparkContext.broadcast(index)
        mine = docs.mapInArrow(lambda batches, shared=shared: _search(shared.value)(batches), ddl)
        found = mine if found is None else found.union(mine)
    return found
