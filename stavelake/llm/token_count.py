"""Token counts with overlap resynchronisation for huge documents.

A text of up to ``chunk`` characters is encoded whole.  A longer one is encoded in chunks that overlap; two neighbours
are spliced at a boundary that both have and that is proven stable:

* it is a boundary between pre-tokens (not only tokens) in both encodings.  Pre-tokens are matched from left to right,
  and merges never cross them, so what follows a common boundary is the same in both;
* it lies at least ``margin`` characters before the left chunk's end, where ``margin`` exceeds the longest added token,
  so that neither a cut special string nor the look-ahead at the chunk's end can have made it.

The left chunk is right up to there by induction (the first starts where the text does).  If the overlap has no such
boundary it is widened twofold, up to the whole rest of the text.

Defined results: null and empty texts have no tokens; rows that repeat are counted each; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavelake.llm.common import lean, resident

CHUNK, OVERLAP = 1 << 16, 1 << 9


class Counter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.sentencepiece = path.endswith(".model")
        if self.sentencepiece:
            import sentencepiece

            self.tok = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.margin = max([1, *map(len, added)]) + 4
        #: Chunks need a tokenizer that neither rewrites text nor looks left; others take every text whole.
        self.splices = self.tok.normalizer is None and "ByteLevel" in type(self.tok.pre_tokenizer).__name__

    def whole(self, texts: list[str]) -> list[int]:
        if self.sentencepiece:
            return [len(x) for x in self.tok.encode(texts, num_threads=1)]
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def boundaries(self, text: str) -> tuple[dict[int, int], int]:
        """Tokens before each boundary between pre-tokens, by its character, and all tokens."""
        e = self.tok.encode(text, add_special_tokens=False)
        found, words, offsets = {}, e.word_ids, e.offsets
        for k in range(1, len(words)):
            if words[k] != words[k - 1] or words[k] is None:
                if offsets[k][0] >= offsets[k - 1][1]:
                    found[offsets[k][0]] = k
        return found, len(words)

    def long(self, text: str, chunk: int, overlap: int) -> int:
        total, begin, skip = 0, 0, 0
        # begin: of the left chunk; skip: its tokens that earlier chunks have counted
        while True:
            stop = begin + chunk
            if stop >= len(text):
                return total + self.whole([text[begin:]])[0] - skip
            left, _ = self.boundaries(text[begin:stop])
            over = overlap
            while True:
                nxt = max(begin + 1, stop - over)
                right, _ = self.boundaries(text[nxt : nxt + chunk])
                limit = stop - self.margin
                common = [b for b in right if b + nxt < limit and b + nxt - begin in left]
                if common:
                    b = common[len(common) // 2]
                    total += left[b + nxt - begin] - skip
                    skip, begin = right[b], nxt
                    break
                if nxt == begin + 1:  # no boundary at all: a larger chunk
                    chunk *= 2
                    break
                over *= 2

    def count(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        if self.sentencepiece or not self.splices:
            return self.whole(texts)
        out = self.whole([t if len(t) <= chunk else "" for t in texts])
        for i, t in enumerate(texts):
            if len(t) > chunk:
                out[i] = self.long(t, chunk, overlap)
        return out


def counter(path: str) -> Counter:
    return resident(("counter", path), lambda: Counter(path))


def count_tokens(docs: DataFrame, tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs`` (doc_id, text); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in batches:
            keys, col, sizes, counts, held, n = batch.column(0), batch.column(1), [], [], [], 0
            for i in range(batch.num_rows):
                text = col[i].as_py() or ""
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                held.append(text)
                n += len(text)
                if n > 1 << 20:
                    counts += count(held, chunk, overlap)
                    held, n = [], 0
            counts += count(held, chunk, overlap)
            yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", F.col("text")).mapInArrow(lean(run, keep=True), "doc_id long, n_bytes long, n_tokens long")
