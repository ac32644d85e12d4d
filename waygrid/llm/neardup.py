"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find grouping."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, materialise

WORDS = 5
PERCENT = 85
HASHES = 120
MISS = 1e-6                 # chance that a pair at the threshold shares no band, and that its estimate is refused
BLOCK = 2048                # documents of a group that one task compares with each other,
BLOCK_CHARS = 16_000_000    # and their characters
CHUNK = 200_000             # shingles whose permutations are held at once
MEMO = 500_000

SIG = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def banding(percent: int) -> tuple[int, int]:
    """(slots of a band, slots that a pair must agree in): the widest bands and the highest bar that lose a pair
    at ``percent`` at most once in 1 / ``MISS``.
    """
    p = percent / 100
    wide = [r for r in range(1, HASHES + 1) if HASHES % r == 0 and (1 - p ** r) ** (HASHES // r) <= MISS]
    if not wide:
        raise ValueError(f"{HASHES} slots cannot find pairs at {percent} percent")
    lost, agree = 0.0, 0
    while agree < HASHES and (lost := lost + math.comb(HASHES, agree) * p ** agree * (1 - p) ** (HASHES - agree)) <= MISS:
        agree += 1
    return max(wide), agree


class Shingler:
    """Distinct hashes of the five-word shingles of a text; a shorter text is one shingle."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash
        ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \x20\x09-\x0D only
        if not ws:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(ws).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
        n = len(ws) - WORDS + 1
        if n < 1:
            n, width = 1, len(ws)
        else:
            width = WORDS
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = mix(out * _GOLD + h[k:k + n])
        return np.unique(out)


def super_minhash(elements: np.ndarray, owner: np.ndarray, n_docs: int, m: int = HASHES) -> np.ndarray:
    """SuperMinHash of many sets at once: float64 (n_docs, m); a document without elements keeps infinities.

    Step j gives every element the rank j in its own random permutation and a random fraction; a slot
    keeps the least rank plus fraction. Once all slots of a document hold less than j + 1 no later step
    can change it, and it stops.
    """
    h = np.full(n_docs * m, np.inf)
    perm = np.tile(np.arange(m, dtype=np.uint8), (len(elements), 1))
    active, state = np.arange(len(elements)), elements.copy()
    for j in range(m):
        state = mix(state + _GOLD)
        frac = (state >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
        k = j + (mix(state ^ _M2) % np.uint64(m - j)).astype(np.int64)
        pj, pk = perm[active, j], perm[active, k]
        perm[active, j], perm[active, k] = pk, pj
        np.minimum.at(h, owner[active] * m + pk, j + frac)
        open_docs = h.reshape(n_docs, m).max(axis=1) > j + 1
        stay = open_docs[owner[active]]
        if not stay.any():
            break
        active, state = active[stay], state[stay]
    return h.reshape(n_docs, m)


def _signatures(batches):
    shingle = Shingler()
    for b in batches:
        ids, sets = b.column("doc_id").to_pylist(), [shingle(t.as_py()) for t in b.column("text")]
        lo = 0
        while lo < len(sets):
            hi, total = lo, 0
            while hi < len(sets) and (hi == lo or total + len(sets[hi]) <= CHUNK):
                total += len(sets[hi])
                hi += 1
            part = sets[lo:hi]
            owner = np.repeat(np.arange(len(part)), [len(s) for s in part])
            h = _sliced(np.concatenate(part), owner, len(part))
            sig = mix(h.view(np.uint64)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[lo:hi], pa.int64()), pa.array([len(s) for s in part], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in part], pa.binary()),
                pa.array([r.tobytes() if len(s) else None for r, s in zip(sig, part)], pa.binary())], schema=SIG)
            lo = hi


def _sliced(elements: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Signatures of a set are the minima over its slices, so a huge one needs no huge table."""
    if len(elements) <= CHUNK:
        return super_minhash(elements, owner, n)
    parts = [super_minhash(elements[i:i + CHUNK], owner[i:i + CHUNK], n) for i in range(0, len(elements), CHUNK)]
    return np.minimum.reduce(parts)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, sig): null ``sig`` for documents without words."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _signatures, "doc_id bigint, n_shingles bigint, digest binary, sig binary")


class Forest:
    """Union-find over 0..n-1 with every label kept current, so that whole slices can be tested at once."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def apart(self, x: int, ys: np.ndarray) -> np.ndarray:
        return ys[self.label[ys] != self.label[x]]

    def join(self, x: int, y: int) -> bool:
        lx, ly = self.label[x], self.label[y]
        if lx != ly:
            self.label[self.label == ly] = lx
        return bool(lx != ly)


def in_blocks(rows: DataFrame, key: str, node: str, counts: DataFrame) -> DataFrame:
    """Deal the rows of every ``key`` into pairs of blocks (i, j), so that any two rows of a key share one of them;
    ``side`` says whether a row is of block i or j. ``counts`` has the number of blocks ``_b`` of each key; keys
    that it lacks are left out.
    """
    mine = F.pmod(F.xxhash64(node, F.lit(7)), F.col("_b")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    return (rows.join(counts, key).withColumn("_mine", mine).withColumn("_other", other)
            .withColumn("i", F.least("_mine", "_other")).withColumn("j", F.greatest("_mine", "_other"))
            .withColumn("side", F.when(F.col("_mine") == F.col("i"), 0).otherwise(1)).drop("_b", "_mine", "_other"))


def block_counts(rows: DataFrame, key: str, chars=None) -> DataFrame:
    """Blocks of keys with two rows or more: at most ``BLOCK`` rows and about ``BLOCK_CHARS`` characters each."""
    n, size = F.count(F.lit(1)), F.sum(chars) if chars is not None else F.lit(0)
    return rows.groupBy(key).agg(n.alias("_n"), F.ceil(F.greatest(n / BLOCK, size / BLOCK_CHARS)).cast("int").alias("_b")).where(
        "_n > 1").drop("_n")


def _groups(batches, keys: list[str]):
    """Runs of rows with equal keys of a sorted stream, as tables; runs of one row are left out."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        cut = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            cut |= v[1:] != v[:-1]
        ends = np.concatenate(([0], np.flatnonzero(cut) + 1))
        for a, z in zip(ends.tolist(), ends[1:].tolist()):
            if z - a > 1:
                yield t.slice(a, z - a)
        rest = t.slice(int(ends[-1])).combine_chunks()
    if rest is not None and rest.num_rows > 1:
        yield rest


def _edges(pairs):
    for k in range(0, len(pairs), 10_000):
        part = pairs[k:k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], schema=PAIR)


def _alike(agree: int):
    """In buckets: a spanning forest of the pairs whose signatures agree in ``agree`` slots or more."""
    def run(batches):
        pairs: list[tuple] = []
        for t in _groups(batches, ["band", "i", "j"]):
            ids, side = t.column("node").to_pylist(), t.column("side").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
            one_block = side.max() == 0
            forest = Forest(len(ids))
            for x in range(len(ids)):
                ys = np.arange(x + 1, len(ids)) if one_block else np.flatnonzero(side != side[x])
                ys = forest.apart(x, ys[ys > x])
                for y in ys[(sig[ys] == sig[x]).sum(axis=1) >= agree].tolist():
                    if forest.join(x, y):
                        pairs.append((ids[x], ids[y]))
            if len(pairs) >= 10_000:
                yield from _edges(pairs)
                pairs = []
        yield from _edges(pairs)
    return run


def _linked(percent: int):
    """In candidate clusters: a spanning forest of the pairs whose full sets pass, by counting along shingle lists."""
    def run(batches):
        shingle, pairs = Shingler(), []
        for t in _groups(batches, ["cluster", "i", "j"]):
            ids, side = t.column("node").to_pylist(), t.column("side").to_numpy()
            sets = [shingle(x.as_py()) for x in t.column("text")]
            one_block = side.max() == 0
            sizes = np.array([len(s) for s in sets])
            values, code = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(code, kind="stable")
            holders, at = owner[order], np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(values)))))
            first = np.concatenate(([0], np.cumsum(sizes)))
            forest = Forest(len(ids))
            for x in range(len(ids)):
                ys = np.arange(x + 1, len(ids)) if one_block else np.flatnonzero(side != side[x])
                ys = forest.apart(x, ys[ys > x])
                if not len(ys):
                    continue
                both = np.zeros(len(ids), np.int64)
                for c in code[first[x]:first[x + 1]].tolist():
                    both[holders[at[c]:at[c + 1]]] += 1  # a set holds a shingle once
                for y in ys[100 * both[ys] >= percent * (sizes[ys] + sizes[x] - both[ys])].tolist():
                    if forest.join(x, y):
                        pairs.append((ids[x], ids[y]))
            if len(pairs) >= 10_000:
                yield from _edges(pairs)
                pairs = []
        yield from _edges(pairs)
    return run


def _by_group(rows: DataFrame, key: str, run) -> DataFrame:
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "node").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of (doc_id, text).

    Documents with equal sets meet in a grouped minimum and go on as one. Signatures, in bands as ``percent`` asks, name
    buckets; in a bucket, blocks of bounded size are compared and only a spanning forest of the pairs that
    may pass leaves the task. Its components are candidate clusters, small because chance collisions fail
    the estimate; every linked pair lies in one. Their full sets are compared, again in blocks, and the
    links' components are the result. Nothing is capped and no task emits all pairs of a group.

    Documents without words, or with a null text, have an empty set and are linked with nothing. Rows that
    repeat a doc_id are one document. A null doc_id has no component and is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sigs = materialise(signatures(docs), "signatures")
    reps = sigs.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("sig").alias("sig"))
    reps = materialise(reps, "sets")
    rows, agree = banding(percent)
    width = 2 * rows
    band = F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 1 + k * width, width)) for k in range(HASHES // rows)]))
    banded = reps.select("node", band.alias("band"))
    members = in_blocks(banded, "band", "node", block_counts(banded, "band")).join(reps.select("node", "sig"), "node")
    alike = _by_group(members, "band", _alike(agree))
    clusters = materialise(components(alike).withColumnRenamed("component", "cluster"), "clusters")
    texts = materialise(clusters.join(docs.withColumnRenamed("doc_id", "node"), "node").groupBy("cluster", "node", F.xxhash64("text"))
                        .agg(F.first("text").alias("text")).select("cluster", "node", "text"), "texts")
    blocks = in_blocks(texts, "cluster", "node", block_counts(texts, "cluster", F.length("text")))
    links = _by_group(blocks, "cluster", _linked(percent))
    equal = sigs.where("doc_id IS NOT NULL AND n_shingles > 0").join(reps.select("digest", "node"), "digest").select(
        F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    found = components(links.union(equal)).withColumnsRenamed({"node": "doc_id", "component": "_found"})
    out = sigs.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    own = F.coalesce("_found", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
