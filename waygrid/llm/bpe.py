"""Byte-level BPE by a global shuffle of distinct words: each word is encoded once, texts are reassembled by position."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise

RANKS = "byte_bpe_50k.tiktoken"
BLOCK_CHARS = 32_000_000  # texts whose words are listed together
EMIT_BYTES = 4_000_000    # ids that a task gathers before it hands them on
KEEP_WORDS = 1_000_000  # encoded words a task remembers at once
ROW_TOKENS = 200_000      # positions of texts that share a row
ROW = pa.schema([("block", pa.int64()), ("seq", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("part", pa.int32()), ("payload", pa.binary())])
ROW_DDL = "block bigint, seq bigint, doc_ids array<bigint>, part int, payload binary"
IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def _pack(*parts: np.ndarray | bytes) -> bytes:
    """Buffers, each compressed alone; an array of integers below 2**32 as four buffers, lowest bytes first,
    because its upper bytes hardly vary."""
    out = []
    for x in parts:
        for raw in [x] if isinstance(x, bytes) else [p.tobytes() for p in x.astype("<u4").view(np.uint8).reshape(-1, 4).T]:
            zipped = pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)
            out += [len(raw).to_bytes(8, "little"), len(zipped).to_bytes(8, "little"), zipped]
    return b"".join(out)


def _unpack(packed: bytes, arrays: int) -> list:
    """The first ``arrays`` arrays of ``_pack``, and what else it holds as bytes."""
    raws, at = [], 0
    while at < len(packed):
        raw, zipped = int.from_bytes(packed[at:at + 8], "little"), int.from_bytes(packed[at + 8:at + 16], "little")
        raws.append(pa.decompress(packed[at + 16:at + 16 + zipped], decompressed_size=raw, codec="zstd", asbytes=True))
        at += 16 + zipped
    planes = [np.stack([np.frombuffer(r, np.uint8) for r in raws[4 * k:4 * k + 4]], axis=1) for k in range(arrays)]
    return [np.ascontiguousarray(x).view("<u4").ravel() for x in planes] + raws[4 * arrays:]


def pack_words(numbers: np.ndarray, ws: list[bytes]) -> bytes:
    """Ascending numbers of words, and the words."""
    return _pack(np.diff(numbers, prepend=0), np.fromiter(map(len, ws), np.uint32, len(ws)), b"".join(ws))


def unpack_words(packed: bytes) -> tuple[np.ndarray, list[bytes]]:
    steps, sizes, raw = _unpack(packed, 2)
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.cumsum(steps), [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def pack_texts(lengths: np.ndarray, at: np.ndarray) -> bytes:
    """Lengths and word numbers of texts: a byte each for the most frequent words, the others apart."""
    return _pack(lengths, at[at >= 255] - 255, np.minimum(at, 255).astype(np.uint8).tobytes())


def unpack_texts(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    lengths, rest, first = _unpack(packed, 2)
    at = np.frombuffer(first, np.uint8).astype(np.uint32)
    at[at == 255] += rest
    return lengths, at


def word_part(word: bytes, parts: int) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(word) % parts


def _explode(pattern: str, parts: int, block_chars: int):
    """Texts to rows of positions (part -1), and each block's distinct words dealt out by word hash."""
    def run(batches):
        import regex
        from pyspark import TaskContext
        find = regex.compile(pattern).findall
        task = TaskContext.get().partitionId()
        block = chars = 0
        places: dict[str, int] = {}
        docs: list[tuple] = []

        def close():
            nonlocal places, docs, chars, block
            # numbers are dealt out again by falling frequency, so that positions are small and compress well
            raw = [w.encode("utf-8", "surrogatepass") for w in places]
            seen = np.bincount(np.concatenate([at for _, at in docs]), minlength=len(raw))
            order = np.argsort(-seen, kind="stable")
            number = np.empty(len(raw), np.uint32)
            number[order] = np.arange(len(raw), dtype=np.uint32)
            name, out, lo = task << 32 | block, [], 0
            while lo < len(docs):
                hi, n = lo, 0
                while hi < len(docs) and n < ROW_TOKENS:
                    n += len(docs[hi][1])
                    hi += 1
                some = docs[lo:hi]
                out.append((name, lo, [d for d, _ in some], -1, pack_texts(np.array([len(at) for _, at in some]), number[np.concatenate([at for _, at in some])])))
                lo = hi
            of = np.fromiter((word_part(raw[i], parts) for i in order), np.int64, len(raw))
            for p in np.unique(of).tolist():
                mine = np.flatnonzero(of == p)
                out.append((name, p, None, p, pack_words(mine, [raw[i] for i in order[mine]])))
            places, docs, chars = {}, [], 0
            block += 1
            for k in range(0, len(out), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k:k + 16]), ROW)], schema=ROW)

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ws = find(text.as_py() or "")
                for w in set(ws).difference(places):
                    places[w] = len(places)
                docs.append((doc, np.fromiter(map(places.__getitem__, ws), np.uint32, len(ws))))
                chars += sum(map(len, ws))
                if chars >= block_chars:
                    yield from close()
        if docs:
            yield from close()
    return run


def load_ranks(name: str) -> dict[bytes, int]:
    import public_tokenizers
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encode_words(ranks_name: str, pattern: str):
    """Rows of distinct words, sorted by part, to rows of their ids. A word of several blocks is encoded once."""
    def run(batches):
        import tiktoken
        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_name), special_tokens={})
        encode = enc._core_bpe.encode_single_piece
        known: dict[bytes, np.ndarray] = {}
        part = None
        for b in batches:
            done = []
            for block, seq, p, packed in zip(b.column("block").to_pylist(), b.column("seq").to_pylist(), b.column("part").to_pylist(), b.column("payload")):
                if p != part or len(known) > KEEP_WORDS:
                    part, known = p, {}
                numbers, ws = unpack_words(packed.as_py())
                ids = []
                for w in ws:
                    got = known.get(w)
                    if got is None:
                        got = known[w] = encode(w)
                    ids.append(got)
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
                done.append((block, seq, None, p, _pack(np.diff(numbers, prepend=0), sizes, flat)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), ROW)], schema=ROW)
    return run


class _Block:
    """The ids of a block's words, by word number."""

    def __init__(self):
        self.parts, self.flat = [], None

    def add(self, packed: bytes):
        steps, sizes, flat = _unpack(packed, 3)
        self.parts.append((np.cumsum(steps), sizes, flat))

    def ids(self, at: np.ndarray) -> np.ndarray:
        if self.flat is None:
            number, sizes, flat = (np.concatenate(x) for x in zip(*self.parts))
            self.sizes, self.starts = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            self.sizes[number], self.starts[number] = sizes, np.cumsum(sizes) - sizes
            self.flat, self.parts = flat, []
        n = self.sizes[at]
        return self.flat[np.arange(n.sum()) + np.repeat(self.starts[at] - (np.cumsum(n) - n), n)]


def _reassemble(batches):
    """Rows sorted by block, its words before its texts, to the ids of the texts: gathered by position."""
    name, block, done, held = None, None, [], 0
    for b in batches:
        for here, docs, part, packed in zip(b.column("block").to_pylist(), b.column("doc_ids").to_pylist(), b.column("part").to_pylist(), b.column("payload")):
            if here != name:
                name, block = here, _Block()
            if part >= 0:
                block.add(packed.as_py())
                continue
            lengths, at = unpack_texts(packed.as_py())
            for doc, mine in zip(docs, np.split(at, np.cumsum(lengths)[:-1])):
                done.append((doc, block.ids(mine).astype("<u4").tobytes() if len(mine) else b""))
                held += len(done[-1][1])
                if held > EMIT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), IDS)], schema=IDS)
                    done, held = [], 0
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), IDS)], schema=IDS)


def _rows(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None, parts: int | None = None,
          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Texts as word positions and words with their ids, sorted by block: what ``_reassemble`` reads."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if pattern is None:
        import public_tokenizers
        pattern = public_tokenizers.PATTERN
    rows = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_explode(pattern, parts, block_chars), ROW_DDL), "pretokens")
    by_word = rows.where("part >= 0").repartition("part").sortWithinPartitions("part", "block")
    word_ids = by_word.mapInArrow(_encode_words(ranks, pattern), ROW_DDL)
    return rows.where("part < 0").union(word_ids).repartition("block").sortWithinPartitions("block", F.col("part") < 0, "seq")


def encode(docs: DataFrame, ranks: str = RANKS, **params) -> DataFrame:
    """(doc_id, ids) of every row of (doc_id, text); params: pattern, parts, block_chars.

    ``ids``: little-endian unsigned 32-bit integers.

    Texts are split by ``pattern``; every block of texts lists its distinct words once and keeps the
    texts as word positions. The words of all blocks are shuffled by word, encoded once, and sent back to
    their blocks, where positions become ids. Blocks are bounded in characters (but for one longer text),
    so no task grows with the input; ``parts`` of the word space follow the session's shuffle partitions.
    Null texts and texts without a match have no ids; repeated rows each get theirs; special strings are
    ordinary text.
    """
    return _rows(docs, ranks, **params).mapInArrow(_reassemble, "doc_id bigint, ids binary")


def _decode(ranks_name: str):
    def run(batches):
        ranks = load_ranks(ranks_name)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        for b in batches:
            texts = [None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])
    return run


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Add ``decoded``, the bytes of the ids. The token table is bounded by the vocabulary, so every task joins it in memory."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(ranks), "doc_id bigint, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks: str = RANKS, **params) -> DataFrame:
    """``decode(encode(docs))`` with both last steps in one worker."""
    back = _decode(ranks)
    return _rows(docs, ranks, **params).mapInArrow(lambda batches: back(_reassemble(batches)), "doc_id bigint, ids binary, decoded binary")
