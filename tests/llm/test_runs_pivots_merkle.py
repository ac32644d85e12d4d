import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import CLASH, frame
from waygrid.llm import merkle, periodic, pivots
from waygrid.llm.queries import QUERIES


# ------------------------------------------------------------------ periodic runs
def plain_runs(ws):
    n, out = len(ws), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and ws[j] == ws[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, length, q) for (a, length), q in out.items())


def plain_collapsed(ws, runs):
    return " ".join(w for i, w in enumerate(ws) if not any(s + q <= i < s + n for s, n, q in runs))


def run_texts(rng, n):
    out = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3 + "a", "x " * 30_000, "Z" * 60_000, "é ü " * 9]
    # every 5-gram comes twice in a period: neighbouring 5-grams alone would miss it
    half = "0000001000011000101000111001001011001101001111010101110110111111"
    out.append(" ".join(half * 5))
    for _ in range(n):
        ws = [str(rng.randrange(rng.choice([1, 2, 3, 40]))) for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 3)):
            a, q = rng.randint(0, len(ws)), rng.randint(1, 14)
            ws[a:a] = ws[a:a + q] * rng.randint(2, 7)
        out.append(rng.choice([" ", "\n", " \t"]).join(ws))
    return out


def test_runs_against_every_lag(spark):
    rng = random.Random(4)
    rows = list(enumerate(run_texts(rng, 300))) + [(None, "b c " * 6), (3, "b c " * 6), (3, "b c " * 6)]
    got = periodic.find_runs(frame(spark, rows)).collect()
    seen = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got)
    want = []
    for d, t in rows:
        ws = (t or "").encode().split()
        ws = [w.decode() for w in ws]
        runs = plain_runs(ws) if len(ws) < 10_000 else [(0, len(ws), 1)]
        want.append((str(d), len(ws), runs, plain_collapsed(ws, runs) if len(ws) < 10_000 else ws[0]))
    assert seen == sorted(want)
    assert sum(len(r.runs) > 1 for r in got) > 20
    assert periodic.find_runs(frame(spark, [])).count() == 0


def test_longest_run_is_compared_exactly(spark):
    runs = [(0, 10 ** 9 + 1, 10 ** 8), (5, 10 ** 9 + 2, 10 ** 8), (6, 10 ** 9 + 2, 10 ** 8), (7, 6, 1)]
    df = spark.createDataFrame([(1, runs), (2, []), (3, runs[3:] + [(9, 12, 2)])], f"id bigint, runs {periodic.RUNS}")
    got = {r.id: r.best and tuple(r.best) for r in df.select("id", periodic.longest(F.col("runs")).alias("best")).collect()}
    assert got == {1: runs[1], 2: None, 3: runs[3]}


def test_planted_run(spark):
    words = [f"w{i % 7}x{i}" for i in range(90)]
    rows = [(d, " ".join(words[:d % 91])) for d in range(300)] + [(10 ** 15, "a\n b"), (None, "a b"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in df.select("*", periodic.with_planted_run(F.col("doc_id"), F.col("text")).alias("t")).collect():
        ws = (r.text or "").split()
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is None or h % 10 or not ws:
            assert r.t == r.text
        else:
            g, n = h // 10, len(ws)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            assert r.t == " ".join(ws[i if i < a else a + (i - a) % p] for i in range(n))


# ------------------------------------------------------------------ vectors
VEC = "vec_id bigint, label int, embedding array<float>"


def plain_links(rows, cosine=0.98):
    unit = []
    for _, label, e in rows:
        x = None if e is None or not len(e) or any(c is None for c in e) else np.array(e, float)
        ok = x is not None and label is not None and np.isfinite(x).all() and x.any()
        unit.append(x / np.linalg.norm(x) if ok else None)
    near = lambda i, j: (i != j and unit[i] is not None and unit[j] is not None and rows[i][1] == rows[j][1]
                         and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine)
    links = [[j for j in range(len(rows)) if near(i, j)] for i in range(len(rows))]
    out = []
    for i, (v, _, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        out.append((v, len(links[i]), low, v is None or v == low))
    return out


def vectors(rng, n, dim=24):
    rows, base = [], rng.normal(size=(n // 4, dim))
    for k in range(n):
        x = base[k % len(base)] if k % 3 else base[0]
        noise = rng.normal(size=dim) * rng.choice([0, .05, .12, .2, 1.0])
        rows.append((1000 - k, int(rng.integers(0, 3)), np.float32(x + noise).tolist()))
    return rows


def test_pivot_index_against_all_pairs(spark, monkeypatch):
    rows = vectors(np.random.default_rng(5), 400)
    rows += [(7, None, rows[0][2]), (8, 1, None), (9, 1, []), (10, 1, [0.0] * 24), (11, 1, [float("nan")] + [1.0] * 23), (12, 1, [None] + [1.0] * 23),
             (13, 1, [1.0, 0.0]), (14, 1, [2.0, 0.0]), (15, 1, [3e38] * 24), (16, 1, [1e-38] * 24), (17, 1, [float("inf")] * 24), (None, 0, rows[3][2]),
             (None, 1, [-1.0] * 24), (5, 2, rows[9][2]), (5, 2, [0.5] + [0.0] * 23), (5, 2, [0.5] + [-0.0] * 23)]
    df = spark.createDataFrame(rows, VEC).withColumns({c: F.lit("x") for c in CLASH + ("cluster", "vec", "dim", "copies")})
    order = lambda rs: sorted(tuple(r) for r in map(tuple, rs) for r in [tuple(str(c) for c in r)])
    want = order(plain_links(rows))
    assert sum(int(w[1]) for w in want) > 500
    for pivot_count, list_rows, block in ((2048, 8192, 32_000_000), (4, 3, 2_000)):  # few points, blocks of a few rows
        monkeypatch.setattr(pivots, "LIST_ROWS", list_rows)
        monkeypatch.setattr(pivots, "BLOCK_BYTES", block)
        assert order(pivots.near_duplicates(df, pivots=pivot_count).collect()) == want
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_lone_pairs(spark):
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, w = unit(rng.normal(size=(3000, 64))), rng.normal(size=(3000, 64))
    w = unit(w - (w * a).sum(1, keepdims=True) * a)
    b = 0.9805 * a + np.sqrt(1 - 0.9805 ** 2) * w   # just above the threshold, where it is hardest
    rows = [(2 * k, 0, a[k].tolist()) for k in range(3000)] + [(2 * k + 1, 0, b[k].tolist()) for k in range(3000)]
    got = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"))
    found = got.where("n_links = 1 AND component_id = vec_id - vec_id % 2").count() / 6000
    assert found >= 0.98 and got.where("n_links > 1").count() == 0


# ------------------------------------------------------------------ manifest
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, siblings of every leaf as (side, digest or None) level by level)."""
    level, at, proofs = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for p, i in zip(proofs, at):
            j = i ^ 1
            p.append((i & 1, level[j] if j < len(level) else None))
        level, at = [sha(*level[i:i + 2]) for i in range(0, len(level), 2)], [i // 2 for i in at]
    return level[0], proofs


def plain_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    digest = lambda r: sha(*map(part, r))
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    trees = {g: plain_tree([digest(r) for r in groups[g]]) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names])
    for g, top in zip(names, tops):
        for r, proof in zip(groups[g], trees[g][1]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = digest(r[:3] + (r[3] + 1,) + r[4:]) if tampered else digest(r)
            for right, other in proof + top:
                h = sha(h) if other is None else sha(other, h) if right else sha(h, other)
            sides = "".join(other for _, other in proof + top if other)
            out.append((str(r[0]), digest(r), trees[g][0], root, sha(sides), h, h == root))
    return sorted(out)


@pytest.mark.parametrize("height", [1, 2, 3, 12])
def test_manifest_against_a_plain_tree(spark, height):
    rng = random.Random(height)
    rows = [(rng.randrange(500), rng.choice(["a", None]), rng.choice(["en", "en", "en", "de", "", None, "é"]), rng.choice([5, None]), rng.choice(["", "é x", None, "y" * 999]))
            for _ in range(70)] + [(None, None, "en", 3, "t")] * 2 + [(9, "s", "lone", 1, "z")]
    rows += rows[:6]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").withColumns(
        {c: F.lit("x") for c in CLASH + ("grp", "pos", "n", "check", "part", "number")})
    changed = merkle.leaf(**{f: F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col(f) + 1).otherwise(F.col(f)) if f == "n_chars" else F.col(f)
                             for f in merkle.FIELDS})
    manifest = merkle.build(df, check=changed, height=height)
    got = sorted((str(r.key), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.audit(manifest).collect())
    assert got == plain_manifest(rows) and {r[-1] for r in got} == {True, False}
    assert all(r.verified for r in merkle.audit(merkle.build(df, height=height)).select("verified").collect())


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    manifest = merkle.build(df)
    assert manifest.root is None and merkle.audit(manifest).count() == 0


def test_van_emde_boas_layout():
    def order(root, levels):
        if levels == 1:
            return [root]
        top, (d, i) = levels // 2, root
        return order(root, top) + [x for k in range(2 ** top) for x in order((d + top, i * 2 ** top + k), levels - top)]
    for height in range(1, 11):
        for place, (d, i) in enumerate(order((0, 0), height)):
            assert merkle.addresses(height, d, np.array([i]))[0] == place


def test_new_queries_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    for name, of in (("op11_periodic_runs", "documents"), ("op12_pivot_permutation", "embeddings"), ("op13_merkle_manifest", "documents")):
        assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{of}.parquet").count()
