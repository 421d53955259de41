"""Suffix dedup: removal of every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else.

The suffix array comes in two levels of difference covers.  A cover is a set of sampled positions such that two equal
stretches hold a sampled position at the same distance from their starts.

1. The first cover is defined by content and deals the text to tasks: of each window of ``LENGTH`` bytes, the leftmost
   place whose hash of ``GRAM`` bytes is least, one position in about 80.  Windows with the same sampled position form a
   run, named by the gram there (``g``) and by the string from its first window's start to its last window's end (``c``).
2. Names that occur once fall away: a window whose gram is unique has no equal.  Runs with equal (g, c) have equal
   windows throughout.
3. Runs with equal g but unlike c go to the task of their gram, which sorts their suffixes by the cover modulo 3: it sorts
   sampled triples, recurses on names, merges the remaining suffixes, and compares the prefixes of neighbours.  A gram with
   more than ``HOT`` unlike runs is compared by rows of window names, over all tasks.

A cover modulo 3 over all bytes at once would shuffle two thirds of all positions at each level (figures in the README).
Only the texts that can matter are shuffled: a bitmap of fixed size lets pass those with a repeated name.

Defined results: null and empty texts, and texts shorter than ``LENGTH``, lose nothing; equal texts (repeated rows too) of
``LENGTH`` bytes or more lose everything; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavelake.llm.common import discard, lean, may_hold, packed, stored
from stavelake.llm.difference_cover import repeated_starts

LENGTH, GRAM = 200, 40
#: Unlike runs of one gram that a single task compares.
HOT = 2048
#: Bytes of runs whose suffixes are sorted together, and more up to the end of a gram.
SHARE = 1 << 19
SALTS = 32
NULL_ID = -(1 << 63)

_rng = np.random.default_rng(8)
LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, MIX = 0xC2B2AE3D27D4EB4F, np.uint64(0x9E3779B97F4A7C15)


class Runs:
    """Runs of windows with the same sampled position."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, min(gram, length)
        self.up = self.down = np.empty(0, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 17)
            self.up, self.down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.multiply.accumulate(self.up), np.multiply.accumulate(self.down)

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, windows, g, c) of each run of a text of ``length`` bytes or more."""
        n = len(data)
        self.powers(n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(LETTER[data] * self.down[:n], out=sums[1:])
        k = n - self.gram + 1
        h = (sums[self.gram :] - sums[:k]) * self.up[:k]
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
        span, least, step = self.length - self.gram + 1, h, 1
        while step * 2 <= span:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if span > step:
            least = np.minimum(least[: step - span], least[span - step :])
        # the leftmost least place changes where the window leaves it, or where a lesser one comes in
        moved = (h[: len(least) - 1] == least[:-1]) | (least[1:] != least[:-1])
        first = np.r_[0, np.flatnonzero(moved) + 1]
        count = np.diff(np.r_[first, len(least)])
        end = first + count - 1 + self.length
        c = (sums[end] - sums[first]) * self.up[first] + count.astype(np.uint64)
        c ^= c >> np.uint64(31)
        c *= MIX
        return first, count, least[first], c


def identified(docs: DataFrame) -> DataFrame:
    """(doc, mark, text): doc_id without nulls and a hash of the text, which tell rows with unlike texts apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _batch(rows: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def sampled_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(g, c, doc, mark, place): place is the first window times 2^20 plus the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held, size = Runs(length, gram), [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["g", "c", "doc", "mark", "place"])

        for batch in batches:
            docs, marks, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, doc in enumerate(docs):
                data = texts[i].as_py().encode("utf-8", "surrogatepass")
                if len(data) >= length:
                    first, count, g, c = runs(np.frombuffer(data, np.uint8))
                    held.append((g.view(np.int64), c.view(np.int64), np.full(len(g), doc), np.full(len(g), marks[i]), (first << 20) + count))
                    size += len(g)
                    if size > 100_000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return rows.filter(F.octet_length("text") >= length).mapInArrow(lean(run), "g long, c long, doc long, mark long, place long")


def contexts(rows: DataFrame, needed: DataFrame, length: int) -> DataFrame:
    """(g, doc, mark, first, data): the bytes of each run in ``needed`` (g, doc, mark, place)."""
    lists = needed.groupBy("doc", "mark").agg(F.collect_list(F.struct("g", "place")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, names = [*[pa.int64()] * 4, pa.binary()], ["g", "doc", "mark", "first", "data"]
        out, size = [], 0
        for batch in batches:
            for doc, mark, text, runs in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for r in runs.as_py():
                    first, count = r["place"] >> 20, r["place"] & 0xFFFFF
                    out.append((r["g"], doc.as_py(), mark.as_py(), first, data[first : first + count - 1 + length]))
                    size += count + length
                if size > 8 << 20:
                    yield _batch(out, types, names)
                    out, size = [], 0
        if out:
            yield _batch(out, types, names)

    texts = may_hold(rows, needed, "doc", "mark").filter("held__").drop("held__").dropDuplicates(["doc", "mark"])
    return texts.join(lists, ["doc", "mark"]).select("doc", "mark", "text", "runs").mapInArrow(lean(run), "g long, doc long, mark long, first long, data binary")


def repeated_windows(ctx: DataFrame, length: int) -> DataFrame:
    """(doc, mark, first, windows): stretches of windows that occur twice among the runs of their gram.

    Grams are dealt to tasks; a task sorts the suffixes of its runs, a share at a time, by the difference cover modulo 3 and
    compares the prefixes of neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, names = [pa.int64()] * 4, ["doc", "mark", "first", "windows"]

        def finish(group: list) -> pa.RecordBatch | None:
            out = []
            for (doc, mark, first, _), twice in zip(group, repeated_starts([x[3] for x in group], length), strict=True):
                out += stretches(doc, mark, first, np.flatnonzero(twice).tolist())
            return _batch(out, types, names) if out else None

        group, size, at = [], 0, None
        for batch in batches:
            for g, doc, mark, first, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if g != at and size >= SHARE:  # whole grams only
                    if (made := finish(group)) is not None:
                        yield made
                    group, size = [], 0
                at = g
                group.append((doc, mark, first, data))
                size += len(data)
        if group and (made := finish(group)) is not None:
            yield made

    dealt = ctx.repartition("g").sortWithinPartitions("g")
    return dealt.select("g", "doc", "mark", "first", "data").mapInArrow(lean(run), "doc long, mark long, first long, windows long")


def stretches(doc: int, mark: int, first: int, starts: list[int]) -> Iterator[tuple[int, int, int, int]]:
    k = 0
    for j in range(1, len(starts) + 1):
        if j == len(starts) or starts[j] != starts[j - 1] + 1:
            yield doc, mark, first + starts[k], j - k
            k = j


def repeated_windows_hot(ctx: DataFrame, length: int) -> DataFrame:
    """The same by rows of window names (128 bits), for grams with many unlike runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, mark, first, d in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                out += [(hashlib.blake2b(d[i : i + length], digest_size=16).digest(), doc, mark, first + i) for i in range(len(d) - length + 1)]
            if out:
                yield _batch(out, [pa.binary(), *[pa.int64()] * 3], ["name", "doc", "mark", "first"])

    windows = stored(ctx.select("g", "doc", "mark", "first", "data").mapInArrow(lean(run), "name binary, doc long, mark long, first long"), "windows")
    salted = windows.withColumn("salt", F.pmod(F.xxhash64("doc", "first"), F.lit(64)).cast("int"))
    parts = salted.groupBy("name", "salt").agg(F.count(F.lit(1)).alias("n"))
    twice = parts.groupBy("name").agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).filter("n > 1")
    return salted.join(twice.select("name", F.explode("salts").alias("salt")), ["name", "salt"]).select("doc", "mark", "first", F.lit(1).cast("long").alias("windows"))


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Identified rows, and (doc, mark, spans) of those that lose bytes; spans are (first window, windows), unordered."""
    rows = identified(docs)
    runs = stored(sampled_runs(rows, length, gram), "runs")
    # written, so that the join below deals both sides anew and can split a gram that many rows share
    repeated = stored(runs.groupBy("g").count().filter("count > 1").select("g"), "repeated-grams")
    left = stored(runs.join(repeated, "g"), "repeated-runs")
    # a name may hold most of the rows (a line that fills a text): counted and joined by name and salt
    salted = left.withColumn("salt", F.pmod(F.xxhash64("doc", "place"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("g", "c", "salt").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "mark", "place")).alias("one"))
    names = stored(parts.groupBy("g", "c").agg(F.sum("n").alias("n"), F.min("one").alias("one"), F.collect_list("salt").alias("salts")), "names")
    equal = salted.join(names.filter("n > 1").select("g", "c", F.explode("salts").alias("salt")), ["g", "c", "salt"]).select(
        "doc", "mark", F.expr("shiftright(place, 20)").alias("first"), F.expr("place & 1048575").alias("windows")
    )
    unlike = names.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("n") == 1).alias("single")).filter("k > 1 and single > 0")
    chosen = names.join(unlike.select("g", (F.col("k") > HOT).alias("hot")), "g")
    needed = stored(chosen.select("g", "hot", "one.*"), "unlike-runs")
    ctx = stored(contexts(rows, needed.select("g", "doc", "mark", "place"), length), "contexts")
    hot = needed.filter("hot").select("g").distinct()
    cold = repeated_windows(ctx.join(hot, "g", "left_anti"), length)
    warm = repeated_windows_hot(ctx.join(hot, "g", "left_semi"), length)
    spans = equal.unionByName(cold).unionByName(warm).groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "windows")).alias("spans"))
    made = stored(spans, "spans")
    discard(runs, repeated, left, names, needed, ctx)
    return rows, made


def kept_bytes(data: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, int]:
    """What remains, and the number of maximal removed runs."""
    kept, at, n = [], 0, 0
    end = None
    for first, windows in sorted(spans):
        if end is None or first > end:
            if end is not None:
                at = end
            kept.append(data[at:first])
            n += 1
            end = first + windows - 1 + length
        else:
            end = max(end, first + windows - 1 + length)
    kept.append(data[at if end is None else end :])
    return b"".join(kept), n


def dedup_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows, spans = removed_spans(docs, length, gram)
    rows = may_hold(rows, spans, "doc", "mark")
    doc_id = F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            out = []
            for doc, text, found in zip(*(batch.column(i) for i in range(3)), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                kept, n = kept_bytes(data, [(s["first"], s["windows"]) for s in found.as_py() or []], length)
                out.append((doc.as_py(), len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            if out:
                yield _batch(out, types, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    touched = rows.filter("held__").join(spans, ["doc", "mark"], "left").select(doc_id, "text", "spans").mapInArrow(lean(run), schema)
    clean = rows.filter("not held__").select(
        doc_id, F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")
    )
    return touched.unionByName(clean)


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``text`` cut to what remains (a character that lost some of its bytes goes) and ``n_chars`` of it.
    Texts that lose nothing stay as they are, null or not; all other columns pass."""
    docs, unpacked = packed(docs, "doc_id", "text", "n_chars")
    spans = removed_spans(docs, length, gram)[1]
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.withColumns({"doc__": F.coalesce("doc_id", F.lit(NULL_ID)), "mark__": F.xxhash64(text)})

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if f is None else kept_bytes((t or "").encode("utf-8", "surrogatepass"), [(s["first"], s["windows"]) for s in f], length)[0].decode("utf-8", "ignore")
                for t, f in zip(texts, found, strict=True)
            ],
            dtype=object,
        )

    renamed = spans.select(F.col("doc").alias("doc__"), F.col("mark").alias("mark__"), F.col("spans").alias("spans__"))
    known = may_hold(known, renamed, "doc__", "mark__")
    joined = known.filter("held__").join(renamed, ["doc__", "mark__"], "left")
    done = joined.withColumn("text", F.when(F.col("spans__").isNull(), F.col("text")).otherwise(cut("text", "spans__")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("spans__").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return unpacked(done.select(*docs.columns).unionByName(known.filter("not held__").select(*docs.columns)))
