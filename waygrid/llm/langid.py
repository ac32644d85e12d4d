"""Language of words and documents: a linear-chain CRF over words, decoded by forward-backward."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLE_PER_LANG = 400   # labelled texts of a language that training reads, at most
FEATURES = 1 << 16      # hashed feature space
LEXICON = 400           # frequent words of a language
STEPS, RATE, DECAY = 12, 0.5, 1e-6
SEQ_WORDS = 48          # words of a training sequence, switching language a few times
MEMO = 400_000
BATCH_WORDS = 500_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L), in lower case. ``WORD`` also takes the likes of ² and Ⅷ; those part words."""
    found = WORD.findall((text or "").lower())
    if found and not "".join(found).isalpha():
        found = [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]
    return found


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: crc32 of the id as text divisible by 5; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def features(word: str, lexicons: list[set]) -> list[int]:
    """Hashed affixes, character n-grams and lexicon marks of a lower-case word."""
    padded = f"^{word}$"
    names = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
    names += [f"n{padded[i:i + k]}" for k in (2, 3) for i in range(len(padded) - k + 1)]
    names += [f"l{k}" for k, lex in enumerate(lexicons) if word in lex]
    return [zlib.crc32(n.encode()) % FEATURES for n in names]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray      # (FEATURES, L)
    transitions: np.ndarray  # (L, L), log scale
    lexicons: list[set]

    def __post_init__(self):
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs)), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Rows of scores, one per word; a word's score is computed once per task and memory of it is bounded."""
        if len(self.memo) > MEMO:
            self.memo = {}
        for w in set(words).difference(self.memo):
            at = self.memo[w] = len(self.memo)
            if at >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at] = self.weights[features(w, self.lexicons)].sum(axis=0)
        return self.rows[np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Posterior of every label at every word of many sequences, laid one after another in ``scores``.

    ``lengths`` must not increase. With ``pairs`` also the expected number of each transition.
    """
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    move = np.exp(transitions - transitions.max())
    starts, n = np.cumsum(lengths) - lengths, int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(1, n + 1), side="right")  # sequences longer than t
    alpha = np.empty_like(emit)
    a = None
    for t in range(n):
        at = starts[:alive[t]] + t
        a = emit[at] if t == 0 else (a[:alive[t]] @ move) * emit[at]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[at] = a
    post, expected = alpha.copy(), np.zeros_like(move)
    beta = np.ones((alive[0], emit.shape[1])) if n else None
    for t in range(n - 2, -1, -1):
        k = alive[t + 1]
        at = starts[:k] + t
        ahead = emit[at + 1] * beta[:k]
        back = ahead @ move.T
        if pairs:
            joint = alpha[at][:, :, None] * move * ahead[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[:k] = back / back.sum(axis=1, keepdims=True)
        p = alpha[at] * beta[:k]
        post[at] = p / p.sum(axis=1, keepdims=True)
    return (post, expected) if pairs else post


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Model:
    """Train on (lang, text): lexicons from word counts, then weights and transitions together, by the gradient of
    the chain's likelihood on sequences spliced from documents of different languages."""
    rng = np.random.default_rng(seed)
    texts = sorted(texts)
    langs = sorted({lang for lang, _ in texts})
    docs = defaultdict(list)
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in texts:
        ws = words_of(text)
        if ws:
            docs[lang].append(ws)
            counts[lang].update(ws)
    total = Counter()
    for lang in langs:
        size = max(1, sum(counts[lang].values()))
        total.update({w: c / size for w, c in counts[lang].items()})
    lexicons = [{w for w, c in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]
                 if c / max(1, sum(counts[lang].values())) >= 0.6 * total[w]} for lang in langs]
    model = Model(langs, np.zeros((FEATURES, len(langs)), np.float32), np.zeros((len(langs), len(langs))), lexicons)
    have = [k for k, lang in enumerate(langs) if docs[lang]]
    if len(have) < 2:
        return model
    # sequences of runs of 6 to 24 words of one document each
    sequences, labels = [], []
    for _ in range(1200 * len(have)):
        ws, ls = [], []
        while len(ws) < SEQ_WORDS:
            k = have[rng.integers(len(have))]
            doc = docs[langs[k]][rng.integers(len(docs[langs[k]]))]
            run, at = int(rng.integers(6, 25)), int(rng.integers(max(1, len(doc) - 6)))
            ws += doc[at:at + run]
            ls += [k] * len(doc[at:at + run])
        sequences.append(ws[:SEQ_WORDS])
        labels.append(ls[:SEQ_WORDS])
    known = {w: i for i, w in enumerate(sorted({w for ws in sequences for w in ws}))}
    feats = [features(w, lexicons) for w in known]
    size = np.array([len(f) for f in feats])
    flat, first = np.concatenate(feats).astype(np.int64), np.concatenate(([0], np.cumsum(size)))
    word_of = np.repeat(np.arange(len(feats)), size)
    at, gold = np.array([[known[w] for w in ws] for ws in sequences]), np.array(labels)
    w, t = np.zeros((FEATURES, len(langs))), model.transitions
    w2, t2 = np.full(w.shape, 1e-2), np.full(t.shape, 1e-2)
    for _ in range(STEPS):
        order = rng.permutation(len(at))
        for part in np.array_split(order, 8):
            words_scores = np.add.reduceat(w[flat], first[:-1], axis=0)
            ids, y = at[part].ravel(), gold[part].ravel()
            post, expected = forward_backward(words_scores[ids], np.full(len(part), SEQ_WORDS), t, pairs=True)
            error = -post
            error[np.arange(len(y)), y] += 1
            by_word = np.zeros((len(feats), len(langs)))
            np.add.at(by_word, ids, error)
            grad = np.stack([np.bincount(flat, by_word[word_of, k], FEATURES) for k in range(len(langs))], axis=1) / len(part) - DECAY * w
            seen = np.zeros(t.shape)
            np.add.at(seen, (gold[part][:, :-1].ravel(), gold[part][:, 1:].ravel()), 1)
            grad_t = (seen - expected) / len(part)
            w2 += grad ** 2
            t2 += grad_t ** 2
            w += RATE * grad / np.sqrt(w2)
            t += RATE * grad_t / np.sqrt(t2)
    return Model(langs, w.astype(np.float32), t, lexicons)


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on a bounded sample of (doc_id, text, lang): at most ``per_lang`` labelled, not held-out texts a language.

    Those are the distinct texts of the language with the smallest 64-bit hashes. A rate that follows each language's
    count leaves about twice as many to be ranked, so nothing large is sorted. Repeated ids or rows take no one's place.
    """
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", F.xxhash64("text", F.lit("sample")).alias("hash"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0)), [])
    limit = lambda n: 2 ** 63 - 1 if n <= 2 * per_lang else int(2 ** 64 * (2 * per_lang / n)) - 2 ** 63
    below = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(limit(n)))])
    some = rows.where(F.col("hash") <= F.element_at(below, F.col("lang"))).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "text"))
    return fit([(r.lang, r.text) for r in some.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("lang", "text").collect()])


def _posteriors(model: Model, texts: list):
    """Per text (words, posteriors); texts go through the chain together, longest first, in bounded batches."""
    found = [words_of(t) for t in texts]
    out: list = [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(found[i]))
    while order:
        part, n = [], 0
        while order and (not part or n + len(found[order[0]]) <= BATCH_WORDS):
            part.append(order.pop(0))
            n += len(found[part[-1]])
        if not n:
            break
        part = [i for i in part if found[i]]
        lengths = np.array([len(found[i]) for i in part])
        post = forward_backward(model.emissions([w for i in part for w in found[i]]), lengths, model.transitions)
        for i, p in zip(part, np.split(post, np.cumsum(lengths)[:-1])):
            out[i] = p
    return found, out


def _documents(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            found, posts = _posteriors(model, b.column("text").to_pylist()) if model.langs else ([], [None] * len(b))
            pred, score, switches = [], [], []
            for p in posts:
                if p is None:
                    pred.append("und"); score.append(0.0); switches.append(0)
                    continue
                mean = p.mean(axis=0)
                k = int(mean.argmax())
                best = p.argmax(axis=1)
                pred.append(model.langs[k]); score.append(float(mean[k])); switches.append(int((best[1:] != best[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(switches, pa.int64())], names=["doc_id", "held_out", "lang_pred", "score", "n_switches"])
    return run


def _words(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            found, posts = _posteriors(model, b.column("text").to_pylist()) if model.langs else ([], [None] * len(b))
            for doc, ws, p in zip(b.column("doc_id").to_pylist(), found, posts):
                if p is not None:
                    best = p.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(ws), pa.int64()), pa.array(np.arange(len(ws))), pa.array(ws, pa.string()),
                         pa.array([model.langs[k] for k in best], pa.string()), pa.array(p.max(axis=1), pa.float64())],
                        names=["doc_id", "word_at", "word", "lang", "score"])
    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_switches) per row: the label with the largest mean posterior over words.

    Null texts and texts without a letter get ``und`` and score 0, as does everything if nothing was learned.
    Only the text is an input. Texts are read whole; of equal means the first language by name wins. Repeated rows are
    judged alike; an empty table gives no rows; no shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(_documents(docs.sparkSession.sparkContext.broadcast(model)),
                           "doc_id bigint, held_out boolean, lang_pred string, score double, n_switches bigint")


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, word_at, word, lang, score) of every word: the labels of code-switched text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _words(docs.sparkSession.sparkContext.broadcast(model)), "doc_id bigint, word_at bigint, word string, lang string, score double")
