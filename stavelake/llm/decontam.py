"""Benchmark decontamination by latent semantic retrieval.

Documents are scanned twice, however many items there are: once to learn, once to search.

1. A passage is ``PASSAGE`` cells of ``CELL`` words.  Words are hashed to ``BUCKETS``.  One pass over all documents counts
   the passages of each bucket and of each word of the items, and multiplies the passages' Gram matrix with a sparse random
   matrix of signs; all are sums over passages, added up by slices.  As TF-IDF weights are a diagonal scaling, the scaling
   comes after, and one pass gives the randomised singular vectors (Nyström's form) of the TF-IDF matrix.
2. The likeness of two stretches of text is the cosine for the inner product  p'q + LATENT (U'p)'(U'q):  the items' words one
   by one, and in the space of the leading singular vectors U, where words that occur in the same company are close.  A
   window is as many cells as an item needs; every window of every document is compared with every item (products of
   dense matrices, a block of ``ITEMS`` items at a time), and cosines of ``CANDIDATE`` or more are candidates.
3. Each candidate is checked on words: the longest common subsequence of item and neighbourhood.  ``COPY`` of the item or
   more is a copy.  If the item's answer is there too (what follows "answer:", else its last sentence), ``PARAPHRASE`` or more
   is a paraphrase, and so is ``LOOSE`` or more where the best stretch as long as the item has a cosine of ``NEAR`` or more:
   other words of the same company, or the same words in another order.

Words of items and documents are runs of letters, digits and underscores in lower case; in scripts without spaces each letter
is a word.  Words are compared by 64 bits of hash.  Words that no passage has do not count in a cosine,
and a word that repeats counts once a cell.  The model lies in the
shared folder, where every worker reads it; blocks of items beyond ``KEEP`` are read again for each group of texts.

No shuffle of texts, no pairs.  Defined results: null and empty texts hold nothing; null, empty and wordless items are
never found; items that repeat are reported each; rows that repeat are reported each; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.llm.common import lean, release, settled, storage, trim, work_dir

ITEMS, CELL, PASSAGE, BUCKET_BITS = 256, 16, 2, 14
BUCKETS = 1 << BUCKET_BITS
RANK, OVERSAMPLE, SIGNS = 48, 16, 2
LATENT, CANDIDATE, NEAR = 4.0, 0.3, 0.7
COPY, PARAPHRASE, LOOSE, ANSWER = 0.7, 0.6, 0.4, 0.8
SLICE = 256
#: Words of a text that are searched together, and of texts in a chunk; characters of texts cut into words together.
SEGMENT, CHUNK, PIECE = 1 << 15, 1 << 15, 1 << 19
#: Blocks of items that a worker keeps, and characters of texts for which it reads the others.
KEEP, GROUP = 16, 1 << 25
#: Words of more items of a block than this are summed by products of dense matrices, and so are buckets of more passages.
WIDE_ITEMS, WIDE_PASSAGES = 16, 32
WORD = re.compile(r"\w+")
#: Letters of scripts without spaces: Thai to Myanmar, Khmer, kana and Han.
UNSPACED = "฀-႟ក-៿々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
WIDE = re.compile(rf"[^\W{UNSPACED}]+|(?=\w)[{UNSPACED}]")

_rng = np.random.default_rng(4)
LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, MIX = 0xA0761D6478BD642F, np.uint64(0xE7037ED1A0B428DB)
IN_WORD = np.array([WORD.match(chr(c)) is not None for c in range(256)])


# --- words -----------------------------------------------------------------------------------------------------


def words_of(text: str | None) -> list[str]:
    """The words of a text; what ``Words`` hashes."""
    return WIDE.findall((text or "").lower())


def _narrow(word: str) -> bytes:
    """A byte for each character, or a spelling of its own for words with other characters."""
    try:
        return word.encode("latin-1")
    except UnicodeEncodeError:
        return b"\xff" + word.encode("utf-16-be", "surrogatepass").hex().encode()


def _spelled(text: str) -> bytes:
    low = text.lower()
    try:
        return low.encode("latin-1")
    except UnicodeEncodeError:
        return b" ".join(map(_narrow, WIDE.findall(low)))


class Words:
    """Hashes of the words of many texts at once."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.multiply.accumulate(self.up), np.multiply.accumulate(self.down)

    def _hashed(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first byte) of each word: the sum of LETTER[b_k] BASE^(i-k), from running sums."""
        raw = np.frombuffer(data, np.uint8)
        self._powers(len(raw) + 1)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = IN_WORD[raw]
        edges = np.flatnonzero(np.diff(inside))
        begin, end = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(LETTER[raw] * self.down[: len(raw)], out=sums[1:])
        h = (sums[end] - sums[begin]) * self.up[begin]
        h ^= h >> np.uint64(32)
        h *= MIX
        return h ^ (h >> np.uint64(29)), begin

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, places where each text's begin, and the end)."""
        spelled = [_spelled(t or "") for t in texts]
        found, firsts, total = [], [], 0
        k = 0
        while k < len(spelled):
            part, size = [], 0
            while k < len(spelled) and (not part or size + len(spelled[k]) < PIECE):
                part.append(spelled[k])
                size += len(spelled[k]) + 1
                k += 1
            if size > 2 * PIECE:  # one long text
                firsts.append(total)
                for h in map(self._hashed, _cut(part[0])):
                    found.append(h[0])
                    total += len(h[0])
                continue
            h, begin = self._hashed(b"\n".join(part))
            starts = np.cumsum([0, *(len(p) + 1 for p in part[:-1])])
            firsts += (np.searchsorted(begin, starts) + total).tolist()
            found.append(h)
            total += len(h)
        return np.concatenate(found) if found else np.empty(0, np.uint64), np.array([*firsts, total], np.int64)


def _cut(data: bytes) -> Iterator[bytes]:
    """Pieces of a long text, cut between words."""
    outside, at = re.compile(rb"[" + re.escape(bytes(np.flatnonzero(~IN_WORD).tolist())) + rb"]"), 0
    while at < len(data):
        m = outside.search(data, min(at + PIECE, len(data)))
        end = m.end() if m else len(data)
        yield data[at:end]
        at = end


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Vocabulary:
    """Places of words in a sorted array of hashes, -1 for others; a table of leading bits answers most."""

    BITS = 20

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.some = np.zeros(1 << self.BITS, bool)
        self.some[self._lead(hashes)] = True

    def _lead(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(8)) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.some[self._lead(h)])
        if len(self.hashes) and len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            good = self.hashes[at] == h[maybe]
            out[maybe[good]] = at[good]
        return out


# --- learning --------------------------------------------------------------------------------------------------


def signs(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sparse random matrix: ``SIGNS`` columns of each bucket, and +1 or -1 there."""
    rng = np.random.default_rng(14)
    return np.argsort(rng.random((BUCKETS, width)), axis=1)[:, : min(SIGNS, width)], rng.choice([-1.0, 1.0], (BUCKETS, min(SIGNS, width)))


def dense_signs(width: int) -> np.ndarray:
    columns, value = signs(width)
    out = np.zeros((BUCKETS, width))
    np.put_along_axis(out, columns, value, axis=1)
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]]


def gather(docs: DataFrame, vocabulary: np.ndarray, width: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Passages; for each bucket and for each word of ``vocabulary`` (sorted hashes) the passages that hold it; the Gram
    matrix of passages (buckets, 0/1) times ``signs(width)``.

    There are at most four partial sums for each core of the cluster, each of fixed size.
    """
    known = len(vocabulary)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, look = Words(), Vocabulary(vocabulary)
        columns, value = signs(width)
        count, terms, total, passages = np.zeros(BUCKETS, np.int64), np.zeros(known, np.int64), np.zeros((BUCKETS, width), np.float32), 0
        size = CELL * PASSAGE

        def add(h: np.ndarray, passage: np.ndarray) -> None:
            n = int(passage[-1]) + 1
            found = look(h)
            held = found >= 0
            if held.any():
                terms.__iadd__(np.bincount(_distinct(passage[held] * known + found[held]) % known, minlength=known))
            key = _distinct(passage * BUCKETS + bucket_of(h))
            row, bucket = key >> BUCKET_BITS, key & (BUCKETS - 1)
            here = np.bincount(bucket, minlength=BUCKETS)
            count.__iadd__(here)
            z = np.zeros(n * width)
            for k in range(columns.shape[1]):
                z += np.bincount(row * width + columns[bucket, k], weights=value[bucket, k], minlength=n * width)
            z = z.astype(np.float32).reshape(n, width)
            often = np.flatnonzero(here > WIDE_PASSAGES)
            number = np.full(BUCKETS, -1)
            number[often] = np.arange(len(often))
            at = number[bucket]
            there = np.zeros((len(often), n), np.float32)
            there[at[at >= 0], row[at >= 0]] = 1
            total[often] += there @ z
            row, bucket = row[at < 0], bucket[at < 0]
            if len(row):
                order = np.argsort(bucket.astype(np.uint16), kind="stable")
                heads = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
                total[bucket[order][heads]] += np.add.reduceat(z[row[order]], heads, axis=0)

        for texts in _texts(batches, CHUNK * 6):
            h, firsts = words(texts)
            n = np.diff(firsts)
            each = -(-n // size)
            base = np.cumsum(each) - each
            passage = (np.arange(len(h)) - np.repeat(firsts[:-1], n)) // size + np.repeat(base, n)
            passages += int(each.sum())
            begin = 0
            while begin < len(h):  # a long text goes in parts
                end = len(h) if len(h) - begin < 2 * CHUNK else int(np.searchsorted(passage, passage[begin + CHUNK]))
                add(h[begin:end], passage[begin:end] - passage[begin])
                begin = end
        slices = range(0, BUCKETS, SLICE)
        yield pa.RecordBatch.from_pydict(
            {
                "slice": pa.array([k // SLICE for k in slices], pa.int32()),
                "passages": pa.array([passages] * len(slices), pa.int64()),
                "count": pa.array([count[k : k + SLICE].tobytes() for k in slices], pa.binary()),
                "total": pa.array([total[k : k + SLICE].tobytes() for k in slices], pa.binary()),
            }
        )
        parts = range(0, known, 4096)
        yield pa.RecordBatch.from_pydict(
            {
                "slice": pa.array([-1 - k // 4096 for k in parts], pa.int32()),
                "passages": pa.array([passages] * len(parts), pa.int64()),
                "count": pa.array([terms[k : k + 4096].tobytes() for k in parts], pa.binary()),
                "total": pa.array([b""] * len(parts), pa.binary()),
            }
        )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for k, passages, count, total in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                new = [passages, np.frombuffer(count, np.int64), np.frombuffer(total, np.float32).astype(np.float64)]
                if k == at:
                    held = [a + b for a, b in zip(held, new, strict=True)]
                else:
                    if held:
                        yield row(at, held)
                    at, held = k, new
        if held:
            yield row(at, held)

    def row(k: int, held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "passages": [held[0]], "count": [held[1].tobytes()], "total": [held[2].tobytes()]})

    schema = "slice int, passages long, count binary, total binary"
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    parts = docs.select("text").coalesce(tasks).mapInArrow(lean(sums), schema).repartition("slice").sortWithinPartitions("slice").mapInArrow(lean(add_up), schema)
    n, count, terms, total = 0, np.zeros(BUCKETS, np.int64), np.zeros(known, np.int64), np.zeros((BUCKETS, width))
    for r in parts.toLocalIterator():  # rows of fixed number for the buckets, and one for 4096 words of the items
        n, found = r["passages"], np.frombuffer(r["count"], np.int64)
        if r["slice"] < 0:
            k = (-1 - r["slice"]) * 4096
            terms[k : k + 4096] = found
        else:
            k = r["slice"] * SLICE
            count[k : k + SLICE] = found
            total[k : k + SLICE] = np.frombuffer(r["total"], np.float64).reshape(-1, width)
    return n, count, terms, total


def _texts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[str | None]]:
    held, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            held.append(text.as_py())
            size += len(held[-1] or "")
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def leading_vectors(weights: np.ndarray, total: np.ndarray, rank: int) -> np.ndarray:
    """The leading singular vectors (buckets x rank) of the weighted matrix, from its Gram matrix times ``dense_signs``."""
    # M = D G D, Y = M (D^-1 test) = D total; M ~ Y (Z'Y)^+ Y' with Z = D^-1 test
    y = weights[:, None] * total
    core = (dense_signs(total.shape[1]) / weights[:, None]).T @ y
    values, rotation = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(initial=0), 0) * 1e-9
    if not good.any() or not rank:
        return np.zeros((len(weights), 1))
    half = y @ (rotation[:, good] / np.sqrt(values[good]))
    return np.linalg.svd(half, full_matrices=False)[0][:, :rank]


@dataclass
class Model:
    """What all blocks of items share."""

    vocabulary: np.ndarray  # hashes of the items' words, sorted
    terms: np.ndarray  # their weights: inverse passage frequency, 0 for words that no passage has
    buckets: np.ndarray  # weights of the buckets
    vectors: np.ndarray  # buckets x rank, weighted, and a last row of zeros
    reach: int  # words around a window that a check touches, at most
    blocks: list[str] = field(default_factory=list)  # files


@dataclass
class Block:
    ids: list
    words: list[list[int]]
    answers: list[list[int]]
    rows: np.ndarray  # places in the vocabulary, ascending
    gains: np.ndarray  # rows x items: squared weight times occurrences in the item
    wide: np.ndarray  # rows: number among those of many items, or -1
    many: np.ndarray  # gains of those
    heads: np.ndarray  # of the other rows' stretches in (items, values)
    items: np.ndarray
    values: np.ndarray
    latent: np.ndarray  # rank x items
    norms: np.ndarray  # items
    cells: np.ndarray  # items: cells of a window


def last_part(text: str) -> str:
    """The answer: what follows "answer:", else the last sentence."""
    marked = re.split(r"\banswer\s*:", text.lower())
    return marked[-1] if len(marked) > 1 else next((s for s in reversed(re.split(r"[.!?]\s+|[.!?]$", text.lower().strip())) if WORD.search(s)), "")


def item_rows(benchmark: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray, np.ndarray]]]:
    """Blocks of at most ``ITEMS`` items with words, in order of id and text: (id, words, words of the answer)."""
    words, held = Words(), []
    for r in benchmark.select("item_id", "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        own = words([r["text"]])[0]
        if len(own):
            held.append((r["item_id"], own, words([last_part(r["text"])])[0]))
            if len(held) == ITEMS:
                yield held
                held = []
    if held:
        yield held


def cells_of(n: int) -> int:
    """Cells of a window that holds ``n`` words wherever they start."""
    return -(-n // CELL) + 1


def learn(docs: DataFrame, benchmark: DataFrame) -> str | None:
    """Learns the model, and writes it and the blocks of items to a folder; its path, or None without items."""
    parts = [(np.unique(np.concatenate([w for _, w, _ in rows])), max(len(w) for _, w, _ in rows)) for rows in item_rows(benchmark)]
    if not parts:
        return None
    vocabulary = np.unique(np.concatenate([v for v, _ in parts]))
    longest = max(n for _, n in parts)
    n, count, found, total = gather(docs, vocabulary, RANK + OVERSAMPLE)
    weigh = lambda c: np.log((n + 1) / (c + 1)) + 0.1
    buckets, terms = weigh(count), np.where(found > 0, weigh(found), 0.0)
    vectors = np.pad(buckets[:, None] * leading_vectors(buckets, total, RANK), ((0, 1), (0, 0)))
    model = Model(vocabulary, terms.astype(np.float32), buckets.astype(np.float32), vectors.astype(np.float32), CELL * cells_of(longest) + 2 * longest)
    folder = work_dir(docs.sparkSession, "decontamination")
    store, base = storage(folder)
    store.create_dir(base, recursive=True)

    def write(name: str, what: object) -> str:
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(pickle.dumps(what))
        return f"{folder}/{name}"

    for k, rows in enumerate(item_rows(benchmark)):
        model.blocks.append(write(f"block-{k:05d}", make_block(model, rows)))
    write("model", model)
    return folder


def make_block(model: Model, rows: list[tuple[int | None, np.ndarray, np.ndarray]]) -> Block:
    places = np.unique(np.searchsorted(model.vocabulary, np.concatenate([w for _, w, _ in rows])))
    counts = np.zeros((len(places), len(rows)))
    latent = np.zeros((model.vectors.shape[1], len(rows)))
    for k, (_, own, _) in enumerate(rows):
        first = np.arange(0, len(own), CELL)
        own = own[(found := in_cells(own, first, np.minimum(first + CELL, len(own))))[2][found[1]]]
        at = np.searchsorted(places, np.searchsorted(model.vocabulary, own))
        np.add.at(counts[:, k], at, 1)
        there = model.terms[places[at]] > 0
        latent[:, k] = model.vectors[bucket_of(own[there])].sum(0)
    gains = counts * (model.terms[places] ** 2)[:, None]
    norms = np.sqrt((gains * counts).sum(0) + LATENT * (latent**2).sum(0))
    cells = np.array([cells_of(len(own)) for _, own, _ in rows])
    listed = lambda k: [r[k].tolist() for r in rows]
    gains = gains.astype(np.float32)
    often = (gains > 0).sum(1) > WIDE_ITEMS
    few = np.where(often[:, None], 0, gains)
    row, item = np.nonzero(few)
    heads = np.searchsorted(row, np.arange(len(places) + 1))
    return Block([r[0] for r in rows], listed(1), listed(2), places, gains, np.where(often, np.cumsum(often) - 1, -1), gains[often], heads, item, few[row, item], latent.astype(np.float32), norms.astype(np.float32), cells)


def _load(path: str) -> object:
    store, place = storage(path)
    with store.open_input_stream(place, compression=None) as f:
        return pickle.loads(f.read())


# --- search ----------------------------------------------------------------------------------------------------


def common(a: Sequence, b: Sequence, masks: dict | None = None) -> int:
    """Length of the longest common subsequence, bit-parallel; ``masks`` are those of ``a``, if known."""
    masks = masks_of(a) if masks is None else masks
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def masks_of(a: Sequence) -> dict:
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def _running(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) + 1, *x.shape[1:]), x.dtype)
    np.cumsum(x, axis=0, out=out[1:])
    return out


def in_cells(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells x ``CELL``: places of words, whether there is one, and whether it is the first of its kind in its cell."""
    at = start[:, None] + np.arange(CELL)
    there = at < end[:, None]
    at = np.minimum(at, len(h) - 1)
    word, once = h[at], there.copy()
    for k in range(1, CELL):
        once[:, k:] &= word[:, k:] != word[:, :-k]
    return at, there, once


class Chunk:
    """Words of some texts in cells; a text of more than ``SEGMENT`` words is in several segments that overlap."""

    def __init__(self, model: Model, look: Vocabulary, h: np.ndarray, spans: list[tuple[int, int, int]]):
        """``spans``: (text, first word, end) of each segment."""
        self.text = np.array([s[0] for s in spans])
        sizes = np.array([b - a for _, a, b in spans])
        self.h = np.concatenate([h[a:b] for _, a, b in spans])
        self.begin = np.cumsum(sizes) - sizes  # of each segment, in words
        self.end = self.begin + sizes
        cells = -(-sizes // CELL)
        self.segment = np.repeat(np.arange(len(spans)), cells)  # of each cell
        first = np.cumsum(cells) - cells
        self.start = self.begin[self.segment] + (np.arange(len(self.segment)) - first[self.segment]) * CELL  # of each cell, in words
        self.last = (first + cells)[self.segment]  # end of its segment, in cells
        self.known, self.place = len(model.vocabulary), look(self.h)
        self.bucket = bucket_of(self.h)
        at, there, once = in_cells(self.h, self.start, np.r_[self.start[1:], len(self.h)])
        self.once = once[there]  # of each word: a word that repeats counts once a cell
        own = model.terms[np.maximum(self.place, 0)]
        self.weight = np.where(self.place >= 0, own, model.buckets[self.bucket]) * self.once
        self.latent = _running(model.vectors[np.where(once, self.bucket[at], BUCKETS)].sum(1))
        self.energy = _running(np.where(once, self.weight[at] ** 2, 0).sum(1))
        self.cell, slot = np.nonzero(once & (self.place[at] >= 0))  # of each word that an item has
        self.hits = self.place[at[self.cell, slot]]

    def grid(self, block: Block) -> np.ndarray:
        """Running sums over cells of each item's gain."""
        cells, items = len(self.segment), len(block.ids)
        row, cell = self.hits, self.cell
        if len(block.rows) < self.known:  # other blocks have words of their own
            row = np.minimum(np.searchsorted(block.rows, row), len(block.rows) - 1)
            good = block.rows[row] == self.hits
            row, cell = row[good], cell[good]
        wide = block.wide[row]
        n = (block.heads[row + 1] - block.heads[row])[wide < 0]
        one = np.repeat(np.flatnonzero(wide < 0), n)
        at = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + block.heads[row[one]]
        out = np.zeros((cells + 1, items), np.float32)
        out[1:] = np.bincount(cell[one] * items + block.items[at], weights=block.values[at], minlength=cells * items).reshape(cells, items)
        if len(block.many):
            counts = np.bincount(cell[wide >= 0] * len(block.many) + wide[wide >= 0], minlength=cells * len(block.many))
            out[1:] += counts.reshape(cells, -1).astype(np.float32) @ block.many
        return np.cumsum(out, axis=0, out=out)


class Searcher:
    """Searches texts for all items of a model's folder."""

    def __init__(self, folder: str):
        self.model: Model = _load(f"{folder}/model")
        self.look, self.words = Vocabulary(self.model.vocabulary), Words()
        self.kept = [self._block(p) for p in self.model.blocks[:KEEP]]
        self.group = GROUP if len(self.model.blocks) > KEEP else CHUNK * 6
        self.segment = max(SEGMENT, 4 * self.model.reach)

    def _block(self, path: str) -> tuple[Block, list[dict]]:
        block = _load(path)
        return block, [masks_of(w) for w in block.words]

    def blocks(self) -> Iterator[tuple[Block, list[dict]]]:
        yield from self.kept
        yield from map(self._block, self.model.blocks[KEEP:])

    def candidates(self, chunk: Chunk, block: Block) -> Iterator[tuple[int, int, float]]:
        """(cell, item, cosine) of the windows that may hold the item."""
        running, n = chunk.grid(block), len(chunk.segment)
        low = np.arange(n)
        for cells in np.unique(block.cells):
            own = np.flatnonzero((block.cells == cells) & (block.norms > 0))
            high = np.minimum(low + cells, chunk.last)
            latent = chunk.latent[high] - chunk.latent[:-1]
            norm = np.sqrt(chunk.energy[high] - chunk.energy[:-1] + LATENT * (latent**2).sum(1))
            product = running[:, own][high] - running[:-1, own] + LATENT * (latent @ block.latent[:, own])
            bound = np.maximum(norm, 1e-6)[:, None] * block.norms[own]
            cell, item = np.nonzero(product >= CANDIDATE * bound)
            yield from zip(cell.tolist(), own[item].tolist(), (product[cell, item] / bound[cell, item]).tolist(), strict=True)

    def nearest(self, chunk: Chunk, block: Block, item: int, lo: int, hi: int) -> float:
        """The best cosine of a stretch of words within lo..hi that is as long as the item."""
        n = min(len(block.words[item]), hi - lo)
        places = chunk.place[lo:hi]
        row = np.minimum(np.searchsorted(block.rows, places), len(block.rows) - 1)
        gain = np.where(chunk.once[lo:hi] & (block.rows[row] == places), block.gains[row, item], 0)
        latent = _running(self.model.vectors[chunk.bucket[lo:hi]] * chunk.once[lo:hi, None])
        latent = latent[n:] - latent[:-n]
        sums = lambda x: (r := _running(x.astype(np.float64)))[n:] - r[:-n]
        product = sums(gain) + LATENT * (latent @ block.latent[:, item])
        norm = np.sqrt(sums(chunk.weight[lo:hi] ** 2) + LATENT * (latent**2).sum(1))
        return float((product / np.maximum(norm, 1e-6)).max() / block.norms[item])

    def check(self, chunk: Chunk, block: Block, masks: list[dict], cell: int, item: int) -> tuple[float, bool, str | None]:
        """Share of the item in the longest common subsequence, whether its answer is there, and the verdict."""
        own, answer, s = block.words[item], block.answers[item], chunk.segment[cell]
        at = chunk.start[cell]
        lo, hi = max(chunk.begin[s], at - len(own)), min(chunk.end[s], at + CELL * block.cells[item] + len(own))
        near = chunk.h[lo:hi].tolist()
        share = common(own, near, masks[item]) / len(own)
        there = bool(answer) and share >= LOOSE and common(answer, near) >= ANSWER * len(answer)
        if share >= COPY:
            return share, there, "copy"
        good = there and (share >= PARAPHRASE or self.nearest(chunk, block, item, int(lo), int(hi)) >= NEAR)
        return share, there, "paraphrase" if good else None

    def search(self, texts: Sequence[str | None]) -> Iterator[tuple[int, int | None, float, float, bool, str]]:
        """(text, item_id, cosine, share, answer, verdict), the best of each text and item."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and size < self.group:
                size += len(texts[end] or "")
                end += 1
            for t, *found in self._search(texts[begin:end]):
                yield begin + t, *found
            begin = end

    def _search(self, texts: Sequence[str | None]) -> Iterator[tuple[int, int | None, float, float, bool, str]]:
        h, firsts = self.words(texts)
        spans: list[list[tuple[int, int, int]]] = [[]]
        size = 0
        for t, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
            while a < b:
                stop = b if b - a <= self.segment else a + self.segment
                spans[-1].append((t, a, stop))
                size += stop - a
                if size >= CHUNK:
                    spans.append([])
                    size = 0
                if stop == b:
                    break
                a = stop - self.model.reach // CELL * CELL - CELL
        chunks = [Chunk(self.model, self.look, h, part) for part in spans if part] if len(self.model.blocks) <= KEEP else None
        for number, (block, masks) in enumerate(self.blocks()):
            best: dict[tuple[int, int], tuple] = {}
            for chunk in chunks or (Chunk(self.model, self.look, h, part) for part in spans if part):
                for cell, item, cosine in self.candidates(chunk, block):
                    share, there, verdict = self.check(chunk, block, masks, cell, item)
                    key = int(chunk.text[chunk.segment[cell]]), item
                    if verdict and best.get(key, (0, 0))[:2] < (share, cosine):
                        best[key] = share, cosine, there, verdict
            for (t, item), (share, cosine, there, verdict) in best.items():
                yield t, block.ids[item], cosine, share, there, verdict


SCHEMA = "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean, verdict string"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it holds as a copy or a paraphrase."""
    folder = learn(docs, benchmark)
    if folder is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    names = ["doc_id", "item_id", "cosine", "lcs_share", "answer_found", "verdict"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(folder)
        for batch in batches:
            keys = batch.column(0)
            out = [(keys[t].as_py(), *found) for t, *found in searcher.search(batch.column(1).to_pylist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return settled(docs.select("doc_id", "text").mapInArrow(lean(run), SCHEMA), "leaks", folder)


def leak_free(docs: DataFrame, benchmark: DataFrame) -> Column:
    """A condition on ``docs``: its text holds no benchmark item."""
    folder = learn(docs, benchmark)

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        searcher = Searcher(folder)
        try:
            for part in parts:
                texts = [t if isinstance(t, str) else None for t in part]
                held = {t for t, *_ in searcher.search(texts)}
                yield pd.Series([i not in held for i in range(len(texts))])
        finally:
            del searcher
            trim()

    return clean("text") if folder else F.lit(True)
