"""Document fingerprints by content-defined chunking.

A rolling gear hash runs over the UTF-8 bytes.  Chunks are cut with normalised masks: from ``LEAST`` bytes up to
``NORMAL`` at places where the strict mask is zero, from there to ``MOST`` where the loose mask is, at ``MOST`` else.  The
hash looks back 32 bytes only, so an edit moves the cuts near it and none further on.  A chunk's digest is 48 bits of
BLAKE2b; a fingerprint lists the distinct chunks in order of digest as ``digest:bytes`` joined by commas.  Likeness is the
larger containment: bytes of the chunks that both have, over the bytes of the smaller fingerprint's chunks.  Chunks that
touch the end of a text, and would be cut elsewhere in a longer one, count like any other.

Defined results: null and empty texts have the empty fingerprint; the likeness of two empty ones is 1, of an empty and
another 0; rows that repeat are kept, and ties of doc_id are ordered by the hash of their texts; a null doc_id comes last in
descending order; of an only row the next one is itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavelake.llm.common import lean
from stavelake.operators.corpus import exact_rank

LEAST, NORMAL, MOST = 32, 96, 512
STRICT, LOOSE = 8, 5  # bits that must be zero
WINDOW = 32
#: Ranges of rows, at most.
RANGES = 100_000
#: Stands for a null doc_id; its negative is in range.
NULL_ID = 1 - (1 << 63)
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, sum over the last 32 bytes b_j back of GEAR[b_j] << j, modulo 2^32."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero((h >> np.uint32(32 - LOOSE)) == 0) + 1
    strict = loose[(h[loose - 1] >> np.uint32(32 - STRICT)) == 0].tolist()
    loose = loose.tolist()
    out, begin, i, j = [], 0, 0, 0
    ni, nj = len(strict), len(loose)
    while n - begin > LEAST:
        first, normal, last = begin + LEAST, begin + NORMAL, min(begin + MOST, n)
        while i < ni and strict[i] < first:
            i += 1
        if i < ni and strict[i] < normal and strict[i] <= last:
            cut = strict[i]
        else:
            while j < nj and loose[j] < normal:
                j += 1
            cut = loose[j] if j < nj and loose[j] <= last else last
        out.append(cut)
        begin = cut
    if begin < n:
        out.append(n)
    return out


def chunks(text: str) -> dict[str, int]:
    """Bytes of each distinct chunk by digest."""
    data, begin, found = text.encode("utf-8", "surrogatepass"), 0, {}
    blake = hashlib.blake2b
    for cut in cuts(data):
        found[blake(data[begin:cut], digest_size=6).hexdigest()] = cut - begin
        begin = cut
    return found


def spelled(found: dict[str, int]) -> str:
    return ",".join([f"{k}:{found[k]}" for k in sorted(found)])


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    return sum([a[k] for k in a.keys() & b.keys()]) / min(sum(a.values()), sum(b.values()))


def edited(text: str, after: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of ``after``."""
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


def _bounds(rows: DataFrame, rows_in_range: int) -> list[tuple[int, int]]:
    """(-key, hash) of the first of each range of about ``rows_in_range`` distinct rows, in order; at most ``RANGES`` of them."""
    ids = rows.select((-F.col("key_")).alias("down_"), "hash_").distinct()
    n = ids.count()
    each = max(rows_in_range, -(-n // RANGES))
    heads = exact_rank(ids, ["down_", "hash_"]).filter(F.col("rank") % each == 0)
    return sorted((r["down_"], r["hash_"]) for r in heads.select("down_", "hash_").collect())


def with_next(docs: DataFrame, rows_in_range: int = 4000) -> DataFrame:
    """(range_, lent_, down_, hash_, n_, text): rows dealt to ranges of descending doc_id, each followed by the first row of the
    next range (the last by the very first), which is lent.

    The shuffle moves each text once.  Order is by doc_id and the hash of the text, so many texts of one doc_id spread over
    ranges; equal rows of a batch become one with their number ``n_``.  Tasks know the first row of each range, two numbers for
    a range and ``RANGES`` of them at most.
    """
    rows = docs.select(F.greatest(F.coalesce("doc_id", F.lit(NULL_ID)), F.lit(NULL_ID)).alias("key_"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash_", F.xxhash64("text"))
    heads = _bounds(rows, rows_in_range)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range_", "lent_", "down_", "hash_", "n_", "text"]
        for batch in batches:
            order = list(zip((-batch.column(0).to_numpy()).tolist(), batch.column(1).to_pylist(), strict=True))
            first, n = {}, Counter(order)
            for i, key in enumerate(order):
                first.setdefault(key, i)
            place = {key: bisect_right(heads, key) - 1 for key in first}
            own = [(place[k], 0, *k, n[k], i) for k, i in first.items()]
            own += [((place[k] - 1) % len(heads), 1, *k, 1, i) for k, i in first.items() if heads[place[k]] == k]
            spot, lent, down, hashes, count, at = zip(*own, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spot, pa.int32()), pa.array(lent, pa.int32()), pa.array(down, pa.int64()), pa.array(hashes, pa.int64()), pa.array(count, pa.int64()), batch.column(2).take(pa.array(at))], names
            )

    dealt = rows.select("key_", "hash_", "text").mapInArrow(lean(deal), "range_ int, lent_ int, down_ long, hash_ long, n_ long, text string")
    return dealt.repartitionById(max(len(heads), 1), "range_").sortWithinPartitions("range_", "lent_", "down_", "hash_")


def fingerprint_documents(docs: DataFrame, rows_in_range: int = 4000) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and likenesses."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = None, [], 0  # held: range, key, text and chunks of the row that waits for its next

        def emit(down: int, text: str, own: dict[str, int], after: str, next_: dict[str, int], times: int) -> None:
            new = edited(text, after)
            found = chunks(new)
            sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            rows.extend([(None if -down == NULL_ID else -down, len(text), sha, spelled(own), spelled(found), likeness(own, found), likeness(own, next_))] * times)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            spot, lent, downs, n, texts = (batch.column(i) for i in (0, 1, 2, 4, 5))
            for i in range(batch.num_rows):
                r, is_lent, text = spot[i].as_py(), lent[i].as_py(), texts[i].as_py()
                if held is not None and held[0] != r:
                    held = None  # its lent row came last
                if is_lent and held is None:
                    continue
                own = chunks(text)
                if held is not None:
                    emit(*held[1:], text, own, 1)
                    size += len(held[2])
                held = None if is_lent else (r, downs[i].as_py(), text, own)
                left = n[i].as_py() - 1  # equal rows follow one another
                while left and held is not None:
                    part = min(left, max(1, (4 << 20) // (len(text) + 1)))
                    emit(*held[1:], text, own, part)
                    size, left = size + part * len(text), left - part
                    if size > 4 << 20:
                        yield flush()
                        rows, size = [], 0
                if size > 4 << 20:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, rows_in_range).mapInArrow(lean(run), schema)
