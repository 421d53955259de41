"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Texts are lower-cased and cut at white space; a text of fewer than ``n`` words has itself as its only n-gram.  Equal
normalised texts form a class.  A signature has one byte for each MinHash; a band is a stretch of them, and rows and bands
are chosen for the wanted recall at the threshold.

1. Classes meet in buckets, one for each band and its bytes; what is shuffled is (bucket, class) numbers.  A bucket with
   the same members as one of an earlier band has nothing to add and goes.
2. In each bucket signatures are compared, block by block.  A pair is judged in the first band that it shares and nowhere
   else, and goes on if its signatures agree in as many places as all but ``DOUBT`` of pairs at the threshold do.  A class
   goes on with a bucket in which it has such a partner.
3. Only texts of those classes are shuffled, to blocks of their buckets, and every pair that goes on is verified on the
   full n-gram sets by sparse products.

No pair is a row: a task returns, for each class, its number of links, and a spanning forest of the links it found.  Buckets
of any size spread over tasks, a task for each pair of blocks.

Defined results: null and empty texts form one class without links; rows that repeat a doc_id and a text are one document,
unlike texts of one doc_id are documents each; a null doc_id takes part by its text, with class_id null where all of the
class are null, and group_id where all of the group are; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavelake.llm.common import discard, groups_of, lean, may_hold, packed, stored
from stavelake.llm.graph import connected_components

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 192
#: Share of pairs at the threshold whose signatures may agree in too few places.
DOUBT = 1e-6
SALTS = 64
#: Classes in a block of signatures; classes and characters in a block of texts.
SCREEN_CLASSES = 1024
BLOCK_CLASSES, BLOCK_CHARS = 256, 4 << 20
KEY_BITS = 48

_rng = np.random.default_rng(5)
LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows for which some number of bands finds pairs at ``threshold`` with ``recall``."""
    best = None
    for rows in range(1, most_hashes + 1):
        if threshold**rows < 1e-9:
            break
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no bands and rows reach this recall")
    return best


def least_agreement(threshold: float, hashes: int, doubt: float = DOUBT) -> int:
    """The most places in which a pair at ``threshold`` agrees with a chance of at least 1 - ``doubt``."""
    below, c = 0.0, 0
    while c < hashes:
        below += math.comb(hashes, c) * threshold**c * (1 - threshold) ** (hashes - c)
        if below > doubt:
            break
        c += 1
    return c


class Shingler:
    """Hashes of n-grams of many texts at once, and MinHash signatures."""

    def __init__(self, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES):
        self.n = n
        self.bands, self.rows = bands_for(threshold, recall, most_hashes)
        self.least = least_agreement(threshold, self.bands * self.rows)
        rng = np.random.default_rng(6)
        k = self.bands * self.rows
        self.flip = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)
        self.times = (rng.integers(0, 1 << 31, k, dtype=np.uint64) * 2 + 1).astype(np.uint32)
        self.powers = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers[0]) < n:
            up, down = np.full(n, BASE), np.full(n, BASE_INVERSE)
            up[0] = down[0] = 1
            self.powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.powers

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """n-gram hashes of normalised texts, one after the other with repeats, and the first place of each text's.

        The hash of bytes i..j is the sum of LETTER[b_k] BASE^(i-k), a difference of running sums times a power.
        """
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        up, down = self._powers(len(data) + 1)
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(LETTER[data] * down[: len(data)], out=sums[1:])
        ends = np.flatnonzero((data == 32) | (data == 10))  # of words; an empty text has an empty word
        begins = np.r_[0, ends[:-1] + 1]
        last = np.flatnonzero(data[ends] == 10)  # the last word of each text
        sizes = np.diff(np.r_[-1, last])
        grams = np.maximum(sizes - self.n + 1, 1)
        firsts = np.cumsum(grams) - grams
        at = np.arange(grams.sum()) - np.repeat(firsts, grams) + np.repeat(last + 1 - sizes, grams)
        to = np.minimum(at + self.n - 1, np.repeat(last, grams))
        h = (sums[ends[to]] - sums[begins[at]]) * up[begins[at]]
        h ^= h >> np.uint64(31)
        h *= MIX
        return h ^ (h >> np.uint64(29)), firsts

    def signatures(self, hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """A row of bytes for each text, ``rows`` to a band."""
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(firsts), self.bands * self.rows), np.uint8)
        for k in range(out.shape[1]):
            out[:, k] = np.minimum.reduceat((short ^ self.flip[k]) * self.times[k], firsts) & np.uint32(255)
        return out

    def buckets(self, signatures: np.ndarray) -> np.ndarray:
        """The bucket of each text in each band: the band, and ``KEY_BITS`` bits of its bytes."""
        by_band = signatures.reshape(len(signatures), self.bands, self.rows)
        acc = np.full(by_band.shape[:2], 1, np.uint64)
        for k in range(self.rows):
            acc = (acc ^ by_band[:, :, k]) * MIX
            acc ^= acc >> np.uint64(29)
        return ((acc >> np.uint64(64 - KEY_BITS)) | np.arange(self.bands, dtype=np.uint64) << np.uint64(KEY_BITS)).view(np.int64)


def normalised(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def signature_rows(docs: DataFrame, shingler: Shingler) -> DataFrame:
    """(doc_id, raw, key, chars, signature): hash of the text, key of the normalised text; texts without words have no
    signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, column = batch.column(0).to_pylist(), batch.column(1)
            begin = 0
            while begin < len(keys):
                texts, size, end = [], 0, begin
                while end < len(keys) and size < 1 << 19:
                    texts.append(normalised(column[end].as_py()))
                    size += len(texts[-1]) + 1
                    end += 1
                signed = shingler.signatures(*shingler.hashes(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[begin:end], pa.int64()),
                        batch.column(2).slice(begin, end - begin),
                        pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([s.tobytes() if t else None for s, t in zip(signed, texts, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "raw", "key", "chars", "signature"],
                )
                begin = end

    return docs.select("doc_id", "text", F.xxhash64("text").alias("raw")).mapInArrow(lean(run), "doc_id long, raw long, key binary, chars long, signature binary")


def _matrix(signatures: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)


def bucket_rows(classes: DataFrame, shingler: Shingler) -> DataFrame:
    """(bucket, cid) of every class in every band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = shingler.buckets(_matrix(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), shingler.bands))], ["bucket", "cid"])

    return classes.filter("signature is not null").select("cid", "signature").mapInArrow(lean(run), "bucket long, cid long")


def in_blocks(members: DataFrame, blocks: str, *keep: str) -> DataFrame:
    """(bucket, i, j, cid, block, ...): the members of each bucket, dealt to ``blocks`` blocks, for every pair of blocks."""
    placed = members.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(1)), F.col(blocks)).cast("int"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))).select(
        "bucket", F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j"), "cid", "block", *keep
    )


def by_block(blocks: DataFrame, finish: Callable[[list, int, bool], list[tuple]], schema: str, names: list[str]) -> DataFrame:
    """Runs ``finish`` (rows of cid, block and more; bucket; across two blocks) on every pair of blocks with two rows or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (bucket, i, j), rows in groups_of(batches, 3):
            if len(rows) > 1:
                out += finish(rows, bucket, i != j)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return blocks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "cid").mapInArrow(lean(run), schema)


def with_partner(signatures: np.ndarray, block: np.ndarray, band: int, across: bool, shingler: Shingler) -> np.ndarray:
    """Which rows have a partner (of another block, if ``across``) that agrees in enough places and shares no earlier band."""
    found = np.zeros(len(block), bool)
    left = np.flatnonzero(block == block.min()) if across else np.arange(len(block))
    right = np.flatnonzero(block != block.min()) if across else left
    if not len(right):
        return found
    others = signatures[right]
    step = max(1, (8 << 20) // (others.size or 1))
    for k in range(0, len(left), step):
        part = left[k : k + step]
        equal = signatures[part][:, None, :] == others[None, :, :]
        good = equal.sum(2, dtype=np.uint16) >= shingler.least
        if not across:
            good &= part[:, None] < right[None, :]
        a, b = np.nonzero(good)
        first = equal[a, b].reshape(len(a), shingler.bands, shingler.rows).all(2).argmax(1)
        a, b = a[first == band], b[first == band]
        found[part[a]] = found[right[b]] = True
    return found


def screen(blocks: DataFrame, shingler: Shingler) -> DataFrame:
    """(bucket, cid) of the classes that go on with a bucket."""

    def finish(rows: list, bucket: int, across: bool) -> list[tuple]:
        cid, block, signature = zip(*rows, strict=True)
        kept = with_partner(_matrix(signature), np.array(block), bucket >> KEY_BITS, across, shingler)
        return [(bucket, cid[k]) for k in np.flatnonzero(kept)]

    return by_block(blocks.select("bucket", "i", "j", "cid", "block", "signature"), finish, "bucket long, cid long", ["bucket", "cid"]).distinct()


def similar_pairs(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of n-gram sets with Jaccard similarity of at least ``threshold``, by products over shared n-grams."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    joined = np.concatenate(sets)
    rows = np.repeat(np.arange(m), sizes.astype(int))
    _, column, count = np.unique(joined, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    rows, column = rows[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    common = np.zeros((m, m), np.float32)
    width = max(256, (8 << 20) // max(m, 1) // 4)
    for begin in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [begin, begin + width])
        part = np.zeros((m, min(width, int(shared.sum()) - begin)), np.float32)
        part[rows[lo:hi], column[lo:hi] - begin] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    return np.nonzero(np.triu(common >= threshold * union - 1e-9, 1))


def verify(blocks: DataFrame, shingler: Shingler, threshold: float) -> DataFrame:
    """(a, b, n): b null: class a has n links in this pair of blocks; else an edge of the block's spanning forest."""

    def finish(rows: list, bucket: int, across: bool) -> list[tuple]:
        ids, block, signature, texts = zip(*rows, strict=True)
        band = bucket >> KEY_BITS
        h, firsts = shingler.hashes([normalised(t) for t in texts])
        a, b = similar_pairs([np.unique(x) for x in np.split(h, firsts[1:])], threshold)
        if across:
            side = np.array(block)
            a, b = a[side[a] != side[b]], b[side[a] != side[b]]
        signed = _matrix(signature)
        here = np.zeros(len(a), bool)
        for k in range(0, len(a), 1 << 15):  # pairs whose first common band is this one
            x, y = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
            shared = (signed[x] == signed[y]).reshape(len(x), shingler.bands, shingler.rows).all(2)
            here[k : k + (1 << 15)] = shared[:, band] & (shared.argmax(1) == band)
        a, b = a[here], b[here]
        links = np.bincount(np.r_[a, b], minlength=len(ids))
        parent = list(range(len(ids)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out: list = [(ids[k], None, int(links[k])) for k in np.flatnonzero(links)]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[ry] = rx
                out.append((ids[x], ids[y], None))
        return out

    return by_block(blocks.select("bucket", "i", "j", "cid", "block", "signature", "text"), finish, "a long, b long, n long", ["a", "b", "n"])


def jaccard_groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, group_id) of every row: its class of equal normalised texts, the number of other
    classes linked to it, and the least doc_id of its connected group."""
    return _groups(docs, n, threshold, recall).select("doc_id", "class_id", "n_links", "group_id")


def candidates(classes: DataFrame, shingler: Shingler) -> DataFrame:
    """(bucket, cid) of the classes that have a likely partner in a bucket."""
    rows = bucket_rows(classes, shingler)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("cid").alias("all"), F.min("cid").alias("least")).filter("n > 1")
    # members are told apart by their number, the least one and a sum of hashes
    kept = stored(sizes.groupBy("n", "all", "least").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "buckets")
    members = rows.join(kept, "bucket").withColumn("blocks", F.ceil(F.col("n") / SCREEN_CLASSES).cast("int"))
    signed = members.join(classes.select("cid", "signature"), "cid")
    found = screen(in_blocks(signed, "blocks", "signature"), shingler)
    out = stored(found, "screened")
    discard(kept)
    return out


def _groups(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """``jaccard_groups`` with raw, the text's hash, cid, the class's own id, and head, the cid of the group's first class."""
    shingler = Shingler(n, threshold, recall)
    salt = F.pmod(F.xxhash64("doc_id", "raw"), F.lit(SALTS)).cast("int")
    rows = stored(signature_rows(docs, shingler).withColumn("salt", salt), "signatures")
    # the row that stands for its class: of the least doc_id, and among its texts of the least hash
    own = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "raw")))
    one = [F.first(c).alias(c) for c in ("chars", "signature")]
    parts = rows.groupBy("key", "salt").agg(own.alias("m"), F.min("raw").alias("raw"), *one)
    classes = stored(
        parts.groupBy("key").agg(F.min("m").alias("m"), F.min("raw").alias("raw"), *one, F.collect_list("salt").alias("salts")).select(
            "key", F.col("m.doc_id").alias("class_id"), F.coalesce("m.raw", "raw").alias("raw"), "chars", "signature", "salts", F.xxhash64("key").alias("cid")
        ),
        "classes",
    )
    found = candidates(classes, shingler)
    named = found.join(classes.select("cid", "chars", "class_id", "raw", "signature"), "cid")
    weights = named.groupBy("bucket").agg(
        F.greatest(F.ceil(F.count("cid") / BLOCK_CLASSES), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int").alias("blocks")
    )
    placed = stored(named.join(weights, "bucket").select("bucket", "cid", "class_id", "raw", "signature", "blocks"), "placed")
    # only texts of classes that go on are shuffled; copies of one row are one text
    texts = docs.select(F.col("doc_id").alias("class_id"), F.xxhash64("text").alias("raw"), "text")
    known = may_hold(texts.filter("class_id is not null"), placed.filter("class_id is not null"), "class_id", "raw").filter("held__").drop("held__")
    known = known.dropDuplicates(["class_id", "raw"]).join(placed, ["class_id", "raw"])
    nameless = may_hold(texts.filter("class_id is null"), placed.filter("class_id is null"), "raw").filter("held__")
    nameless = nameless.groupBy("raw").agg(F.first("text").alias("text")).join(placed.filter("class_id is null").drop("class_id"), "raw")
    columns = ["bucket", "cid", "blocks", "signature", "text"]
    links_of = stored(verify(in_blocks(known.select(*columns).unionByName(nameless.select(*columns)), "blocks", "signature", "text"), shingler, threshold), "links")
    links = links_of.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n_links"))
    members = connected_components(links_of.filter("b is not null").select("a", "b"))
    first = F.min(F.when(F.col("class_id").isNotNull(), F.struct("class_id", "cid"))).alias("first")
    least = members.select(F.col("node").alias("cid"), "root").join(classes.select("cid", "class_id"), "cid").groupBy("root").agg(first)
    groups = members.select(F.col("node").alias("cid"), "root").join(least, "root").select("cid", F.col("first.class_id").alias("group_id"), F.col("first.cid").alias("head"))
    of_class = classes.select("key", "class_id", "cid", F.explode("salts").alias("salt")).join(links, "cid", "left").join(groups, "cid", "left")
    out = rows.select("doc_id", "raw", "key", "salt").join(of_class, ["key", "salt"]).select(
        "doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"), "raw", "cid", F.coalesce("head", "cid").alias("head")
    )
    out = stored(out, "groups")
    discard(rows, classes, found, placed, links_of, members)
    return out


def one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one document of each connected group of near copies: that with the least doc_id.

    Of rows that repeat a doc_id and a text one stays; rows without a doc_id stay.  Only rows that may go are shuffled.
    """
    docs, unpacked = packed(docs, "doc_id", "text")
    groups = _groups(docs, n, threshold, recall).filter("doc_id is not null")
    goes = (F.col("doc_id") != F.col("group_id")) | (F.col("cid") != F.col("head"))
    ids = [F.col("doc_id").alias("gone__"), F.col("raw").alias("raw__")]
    gone = groups.filter(goes).select(*ids, F.lit(None).cast("long").alias("cid__")).distinct()
    twice = groups.filter(~goes).groupBy("doc_id", "cid").agg(F.count(F.lit(1)).alias("n"), F.collect_set("raw").alias("raws")).filter("n > 1")
    again = twice.select(F.col("doc_id").alias("gone__"), F.explode("raws").alias("raw__"), F.col("cid").alias("cid__"))
    marked = may_hold(docs.withColumns({"gone__": F.col("doc_id"), "raw__": F.xxhash64("text")}), gone.unionByName(again), "gone__", "raw__")
    held = F.col("held__") & F.col("gone__").isNotNull()
    met = marked.filter(held).join(gone.drop("cid__"), ["gone__", "raw__"], "left_anti")
    # rows that only seem held have no cid: all of them stay
    met = met.join(again, ["gone__", "raw__"], "left")
    kept = met.filter("cid__ is not null").dropDuplicates(["gone__", "cid__"]).select(*docs.columns).unionByName(met.filter("cid__ is null").select(*docs.columns))
    return unpacked(kept.unionByName(marked.filter(~held).select(*docs.columns)))
