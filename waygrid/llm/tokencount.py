"""Token counts of whole texts; huge ones by overlapping chunks spliced at stable common boundaries."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MODEL = "piece_bpe_32k.model"
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
LIMIT = 4096


class Counter:
    """Counts as the sentencepiece library does, holding at most a few chunks of a text at once."""

    def __init__(self, model_file: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()))
        # proof that no merge crosses from a character to a following blank: no piece holds that pair
        self.stable = not any(re.search("[^▁]▁", p) for p in pieces)

    def starts(self, text: str) -> list[int]:
        """Character offsets at which the tokens of ``text`` begin."""
        return [begin for begin, _ in self.sp.encode(text, return_type="offset_mapping")["offsets"]]

    def _boundary(self, text: str, lo: int, hi: int, left: set[int], right: set[int]) -> int:
        """A place in (lo, hi) where both encodings begin a token and no token can cross; -1 if none."""
        if not self.stable:
            return -1
        for m in re.finditer(r"(?<=[^ ▁]) ", text[lo + 1:hi]):
            at = lo + 1 + m.start()
            if at in left and at in right:
                return at
        return -1

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.sp.encode(text))
        total, begin, width = 0, 0, self.chunk  # tokens before ``begin`` are counted
        overlap = self.overlap
        head = self.starts(text[:width])
        origin = 0  # where the chunk of ``head`` starts in the text
        while origin + width < len(text):
            # the next chunk starts ``overlap`` before the end of this one
            follow = origin + width - overlap
            if follow <= begin:
                # the overlap reached what is settled already: widen this chunk instead
                width, overlap = 2 * width, self.overlap
                head = self.starts(text[origin:origin + width])
                continue
            ahead = self.starts(text[follow:follow + self.chunk])
            at = self._boundary(text, follow, origin + width, {origin + s for s in head}, {follow + s for s in ahead})
            if at < 0:
                overlap *= 2  # alignment failed
                continue
            total += sum(begin <= origin + s < at for s in head)
            begin, origin, width, overlap, head = at, follow, self.chunk, self.overlap, ahead
        return total + sum(begin <= origin + s for s in head)


def _counts(model: str, chunk: int, overlap: int):
    def run(batches):
        import public_tokenizers
        counter = Counter(public_tokenizers.path(model), chunk, overlap)
        for b in batches:
            texts = b.column("text").to_pylist()
            small = [t if t is not None and len(t) <= chunk else "" for t in texts]
            counts = [len(x) for x in counter.sp.encode(small, num_threads=1, return_type="numpy")]
            counts = [counter.count(t) if t is not None and len(t) > chunk else n for t, n in zip(texts, counts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of (doc_id, text), without special tokens.

    A null text counts as empty: zero bytes and tokens. Repeated rows are counted alike. No shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(_counts(model, chunk, overlap), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
